"""Operator 4, toxicity by multiple-instance learning.

A document is a bag of sentences.  With the logistic of its summed word weights w and a bias b, a
sentence's score is what it adds to a sentence without evidence,

    p = max(0, 1 - (1 + e^b) / (1 + e^(b + w))),

so that any number of sentences that say nothing adds nothing; the document's score is their
noisy-or, 1 - prod(1 - p).  Weights are trained from document labels alone, by gradient descent
through that same noisy-or; in the likelihood of a label a leak allows for documents marked toxic
without a cause in their words.  The fit takes at most `sample_rows` labelled rows with at most
`sample_bytes` of text (bounds of the fit, chosen by hashed doc_id); afterwards the sentence scores
locate what offends.

Only words of the text enter a score: no label, language, source or id does.  Scoring is one
pass over whole texts in Arrow buffers, without a shuffle; the model, `max_words` weights at
most, is broadcast.

Defined results: a null, empty or wordless text has the score of no sentence, 0; a row without
doc_id is scored and counts as trainable only if it has a label, which it cannot have; repeated
rows are scored alike; without both labels among the trainable rows every score is 0; other
columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, chunked, own, prepare, smallest_hashes, span_hashes, spans, table, text_buffer, trim

SAMPLE_ROWS, SAMPLE_BYTES, MAX_WORDS, MIN_ROWS = 12_000, 64 << 20, 3_000, 4
#: How likely a document is marked toxic without cause, in the fit.
LEAK = 0.05
CHUNK, FIT_CHUNK, SLOT_BITS = (1 << 20) - 1, (1 << 20) - 1, 21
#: Bytes of the beginnings of longer words that count as features beside the words: stems.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bytes of words: letters, digits and whatever is not ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n|"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_and_sentences(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word (its own hash, then that of its beginnings, 0 where it has none),
    the row and the running sentence number of each word, byte starts and ends."""
    start, end, row = spans(raw, offs, _WORD)
    stops = np.cumsum(_STOP[raw]) if len(raw) else np.zeros(0, np.int64)
    sentence = stops[start] if len(start) else np.zeros(0, np.int64)
    if len(start):
        new = np.ones(len(start), bool)
        new[1:] = (sentence[1:] != sentence[:-1]) | (row[1:] != row[:-1])
        sentence = np.cumsum(new) - 1
    low = _LOWER[raw]
    found = [span_hashes(low, start, end)]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        h = np.zeros(len(start), U64)
        h[long] = span_hashes(low, start[long], start[long] + n) ^ U64(n)
        found.append(h)
    return np.stack(found), row, sentence, start, end


def lost(weight: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - p) of sentences."""
    return np.maximum(0, np.logaddexp(0, np.clip(weight, -500, 500) + bias) - np.logaddexp(0, bias))


def noisy_or(weight: np.ndarray, bag: np.ndarray, bags: int, bias: float = -np.inf) -> np.ndarray:
    """1 - prod over a bag of (1 - p), in logs; an empty bag has 0."""
    return -np.expm1(-np.bincount(bag, lost(weight, bias), bags)) if len(weight) else np.zeros(bags)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Model:
    """Hash-keyed word weights and a sentence bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.keys, self.weights, self.bias = keys, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The weights of features, summed over the first axis: a weight a word."""
        if hashes.ndim > 1:
            return sum(self.of(h) for h in hashes)
        out = np.zeros(len(hashes))
        if not len(self.keys):
            return out
        i = np.flatnonzero(self.maybe[(hashes & U64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[i]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[i]
        out[i[hit]] = self.weights[at[hit]]
        return out


def fit(texts: list[str] | pa.Array, labels: list[int], *, max_words: int = MAX_WORDS, steps: int = 250, l2: float = 2e-4, rate: float = 0.2, soft: float = 1e-4) -> Model:
    """Adam on the mean log loss of noisy-or document scores; classes weigh alike."""
    y = np.array(labels, float)
    nothing = Model(np.zeros(0, U64), np.zeros(0), -60.0)
    if not len(y) or y.min() == y.max():
        return nothing
    raw, offs = text_buffer(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    n_pos, n_all = y.sum(), len(y)

    def chunks():
        for i, j in chunked(offs, FIT_CHUNK):
            h, row, sen, _, _ = words_and_sentences(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield h, row + i, sen

    def g_statistic(pos: np.ndarray, df: np.ndarray) -> np.ndarray:
        """How telling a feature is; 0 where it is too rare."""
        g = 2 * (pos * np.log(np.maximum(pos, 1e-9) * n_all / (df * n_pos)) + (df - pos) * np.log(np.maximum(df - pos, 1e-9) * n_all / (df * (n_all - n_pos))))
        return np.where(df >= min(MIN_ROWS, n_all), g, 0)

    # documents with a feature, counted by the low bits of its hash, so in fixed memory
    df, pos = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
    low = U64((1 << SLOT_BITS) - 1)
    for h, row, _ in chunks():
        pair = np.unique(np.concatenate([(k[k != 0] & low).astype(np.int64) * n_all + row[k != 0] for k in h]))
        df += np.bincount(pair // n_all, minlength=len(df)).astype(np.int32)
        pos += np.bincount(pair[y[pair % n_all] == 1] // n_all, minlength=len(df)).astype(np.int32)
    some = np.flatnonzero(df)
    score = g_statistic(pos[some].astype(float), df[some].astype(float))
    wanted = np.zeros(len(df), bool)
    wanted[some[np.argsort(-score, kind="stable")[: 2 * max_words]]] = True
    # the exact features behind the most telling slots
    key, doc, sentence, n_sen, bag = [], [], [], 0, []
    for h, row, sen in chunks():
        if not len(row):
            continue
        for k in h:
            at = np.flatnonzero((k != 0) & wanted[(k & low).astype(np.int64)])
            key.append(k[at]), doc.append(row[at]), sentence.append(sen[at] + n_sen)
        bag.append(row[np.flatnonzero(np.diff(sen, prepend=-1))])
        n_sen += int(sen[-1]) + 1
    if not n_sen:
        return nothing
    keys, word = np.unique(np.concatenate(key), return_inverse=True)
    pair = np.unique(word.astype(np.int64) * n_all + np.concatenate(doc))
    exact_df = np.bincount(pair // n_all, minlength=len(keys)).astype(float)
    exact_pos = np.bincount(pair // n_all, y[pair % n_all], len(keys))
    score = g_statistic(exact_pos, np.maximum(exact_df, 1))
    kept = np.argsort(-score, kind="stable")[:max_words]
    kept = np.sort(kept[score[kept] > np.log(n_all)])  # the more documents, the more words are telling by chance
    if not len(kept):
        return nothing
    slot = np.full(len(keys), -1)
    slot[kept] = np.arange(len(kept))
    on = slot[word] >= 0
    w_of, s_of, bag = slot[word][on], np.concatenate(sentence)[on], np.concatenate(bag)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(len(kept)), -7.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        of = np.bincount(s_of, w[w_of], n_sen)
        causes = np.bincount(bag, lost(of, b), len(y)) - np.log1p(-LEAK)
        # d loss / d causes: 1 for the clean, -(1 - p) / p for the toxic; sentences below the blank one have no part
        up = weight * np.where(y == 1, -1 / np.expm1(np.clip(causes, 1e-9, 500)), 1.0)
        active = up[bag] * (of >= 0)
        share = _sigmoid(of + b)
        g = np.bincount(w_of, (active * share)[s_of], len(w)) + l2 * w
        gb = float(active @ (share - _sigmoid(b)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = rate * min(1.0, 2 * (steps - t) / steps)
        w -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + soft)
        b -= 0.5 * lr * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + soft)
    return Model(keys[kept], w, float(b))


def _score(shared, offending: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("hashing")
        model: Model = shared.value
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            n = batch.num_rows
            score, worst, found = np.zeros(n), np.zeros(n), [[] for _ in range(n)]
            for i, j in chunked(offs, CHUNK):
                h, row, sen, start, end = words_and_sentences(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(sen, prepend=-1))
                weight = np.add.reduceat(model.of(h), first)
                bag = row[first]
                score[i:j] = noisy_or(weight, bag, j - i, model.bias)
                p = -np.expm1(-lost(weight, model.bias))
                np.maximum.at(worst, bag + i, p)
                last = np.append(first[1:], len(row)) - 1
                for k in np.flatnonzero(p >= offending).tolist():
                    at = offs[i + bag[k]] - offs[i]
                    found[i + bag[k]].append({"start": int(start[first[k]] - at), "end": int(end[last[k]] - at), "score": float(p[k])})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(score, 0, 1)), pa.array(worst), pa.array(found, SPANS)], ["doc_id", "score", "worst", "spans"]
            )

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, max_words: int = MAX_WORDS) -> Model:
    """Fits on the `sample_rows` trainable labelled rows with the smallest hashes, fewer if their texts
    exceed `sample_bytes`."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # the smallest hashes among the ids alone, so that only their texts are looked at
    chosen = smallest_hashes(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample_rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).checkpoint()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    order = [F.xxhash64("doc_id").alias("at"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")]
    sizes = [r["bytes"] for r in rows.select(*order).orderBy("at", "doc_id", "bytes").limit(sample_rows).collect()]  # numbers only
    n = int(np.searchsorted(np.cumsum(sizes), sample_bytes, "right")) if sizes else 0
    got = rows.select(*order, "text", "toxic").orderBy("at", "doc_id", "bytes", "text").limit(n).select("text", "toxic").toArrow()
    texts, labels_of = pc.fill_null(got["text"], "").combine_chunks(), got["toxic"].to_pylist()
    del got
    try:
        return fit(texts, labels_of, max_words=max_words)
    finally:
        del texts
        trim()


def score(docs: DataFrame, model: Model, *, offending: float = 0.5) -> DataFrame:
    """(doc_id, score, worst: the highest sentence score, spans: UTF-8 byte ranges of offending
    sentences)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, worst double, spans array<struct<start: bigint, end: bigint, score: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared, offending), schema)


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_offending"), "spans"
    )


def _keep(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _score(shared, 2.0)
        for batch in batches:
            (got,) = scores(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])]))
            yield batch.filter(pa.array(got.column(1).to_numpy() < 0.5))

    return run


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index("text")), docs.schema)
