"""Operator 1, packing: best-fit decreasing with a segment tree over remaining capacity.

Documents become token ids with an end id; overlong ones are cut into full windows and a
rest.  What best-fit decreasing does depends on lengths alone, and there are at most `window`
lengths.  So the driver packs the histogram of lengths (at most 2,048 numbers, whatever the
corpus): windows with equal remaining capacity are kept as ranges, a segment tree finds the
smallest capacity that still fits, and a whole range is filled at once.  The outcome is that
of packing piece by piece, as one run of rules (length, ranks, first window, offset) whose
size does not depend on the corpus either; pieces find their window by their rank among the
pieces of their length.

Defined results: a null or empty text is the end id alone; a row without doc_id is packed
like any other; repeated rows are packed once each; an empty table gives no rows; other
columns are ignored."""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, CACHES, chunked, own, parts_for, prepare, spans, table, text_buffer

WINDOW = 2048
END = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words that are no runs of letters, and such runs, whose ids a worker remembers; when full it forgets
#: those not in use.
REMEMBERED, REMEMBERED_RUNS = 200_000, 1_000_000
#: Bytes of text whose different words are looked up together.
CHUNK = 4 << 20


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte, as a rule: printable
    Latin-1 characters stand for themselves, the others take the code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 0x20}


BYTE_SIGNS = _byte_signs()


#: Lines of lower-case Latin letters with or without a mark at their end; any other line gives ('', '').
_LINES = re.compile("(?m)^(?:([a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f]+)([.,;:!?]*)|.+)$")
#: How a vocabulary must normalise and split for words to be encoded apart.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISES = ["NFC", "Replace", "Lowercase"]


def by_words(description: dict) -> bool:
    """Whether a vocabulary never joins across ASCII white space, nor letters with other signs."""
    model, normal, split = (description.get(k) or {} for k in ("model", "normalizer", "pre_tokenizer"))
    first, *rest = split.get("pretokenizers") or [{}]
    return (
        model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and [x.get("type") for x in normal.get("normalizers") or []] == NORMALISES
        and normal["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": SPLITS}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
        and all(not set(t["content"].encode()) & set(b" \t\n\v\f\r") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in description.get("added_tokens") or [])
        and not description.get("truncation")
    )


class WordIds:
    """Ids of texts as little-endian bytes.  Where the vocabulary goes by words, each distinct word of
    a part of the texts is looked up once, and each run of letters is encoded once and remembered; such
    runs are encoded together in one text and told apart by their end-of-word ids.  With any other
    vocabulary whole texts are encoded."""

    _of: dict[str, "WordIds"] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        # the same merges without normaliser and splitting, for runs that need neither
        described = json.loads(self.encoder.to_str())
        self.apart = by_words(described)
        if not self.apart:
            self.encoder.no_truncation()
            return
        bare = described | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    @classmethod
    def at(cls, path: str) -> "WordIds":
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _singly(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Ids of lower-case runs of Latin letters."""
        joined = " ".join(runs)
        if not joined.isascii():
            joined = joined.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(runs):
            raise ValueError("the vocabulary does not end every run of letters")
        blob, at = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [blob[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, words: pa.Array) -> list[bytes]:
        """Ids of different words, all at once: one text of a word a line, taken apart by one pattern."""
        cores, n = self.cores, len(words)
        # Latin letters are composed already and have lower cases of one letter each (but U+0130)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words), pa.scalar(b"\n", words.type))[0].as_py()
        runs, tails = zip(*_LINES.findall(lines.decode().lower()), strict=True) if n else ((), ())
        used = {"", *tails}
        for tail in used.difference(cores):
            cores[tail] = self._singly([tail])[0] if tail else b""
        used.update(runs)
        new = list(used.difference(cores))
        if len(cores) + len(new) > REMEMBERED_RUNS:  # what the present texts use is likely to come again
            cores = self.cores = {c: cores[c] for c in used if c in cores}
        plain = [c for c in new if c.isascii()]
        for some in (plain, [c for c in new if not c.isascii()] if len(plain) < len(new) else []):
            for i in range(0, len(some), 5000):
                cores.update(zip(some[i : i + 5000], self._letters(some[i : i + 5000]), strict=True))
        ids = list(map(add, map(cores.__getitem__, runs), map(cores.__getitem__, tails)))
        at = [i for i, c in enumerate(runs) if not c]
        odd, known = words.take(pa.array(at, pa.int64())).to_pylist(), self.known
        new = [w for w in odd if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {w: known[w] for w in odd if w in known}
        for i in range(0, len(new), 5000):
            known.update(zip(new[i : i + 5000], self._singly([w.decode() for w in new[i : i + 5000]]), strict=True))
        for i, w in zip(at, odd, strict=True):
            ids[i] = known[w]
        return ids

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null counts as empty); a part of the texts is held at once."""
        if not self.apart:
            for i in range(0, len(texts), 500):
                yield from self._singly(pc.fill_null(texts.slice(i, 500), "").to_pylist())
            return
        raw, offs = text_buffer(texts)
        for i, j in chunked(offs, CHUNK):
            part, ends = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            start, end, row = spans(part, ends, ~BLANK)
            stops = np.zeros(len(start) + 1, np.int64)
            np.cumsum(end - start, out=stops[1:])
            bare = part[~BLANK[part]]
            words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(stops), pa.py_buffer(bare)]).dictionary_encode()
            collecting = gc.isenabled()
            gc.disable()  # a great many small objects, none of them in cycles
            try:
                blobs = pa.array(self._learn(words.dictionary), pa.large_binary()).take(words.indices)
            finally:
                if collecting:
                    gc.enable()
            _, at, data = blobs.buffers()
            stops = np.frombuffer(at, np.int64)[: len(start) + 1][np.searchsorted(row, np.arange(j - i + 1))].tolist() if len(start) else [0] * (j - i + 1)
            every = memoryview(data or b"")
            yield from (bytes(every[a:b]) for a, b in zip(stops, stops[1:], strict=False))


CACHES["packing"] = WordIds._of.clear


def cut(path: str, window: int = WINDOW, end: int = END):
    """The task that turns (doc_id, text) into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("packing")
        ids, tail = WordIds.at(path), end.to_bytes(4, "little")
        for b in batches:
            cols: list[list[int | None]] = [[], [], [], [], []]
            for doc, blob in zip(b.column(0).to_pylist(), ids.of(b.column(1)), strict=True):
                blob += tail
                n = len(blob) // 4
                for start in range(0, n, window):
                    piece = blob[4 * start : 4 * (start + window)]
                    for c, v in zip(cols, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Capacities:
    """Segment tree over remaining capacity 0..size: how many windows have it, and the
    smallest capacity that is at least `need` and not empty."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        i = capacity + self.leaves
        while i:
            self.sums[i] += windows
            i //= 2

    def tightest(self, need: int) -> int | None:
        i = need + self.leaves
        if not self.sums[i]:
            while i > 1 and not (i % 2 == 0 and self.sums[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.sums[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of `histogram[length]` pieces.  A rule (length, rank, count, first
    window, pieces per window, offset) places the pieces ranked rank .. rank + count - 1."""
    rules, tree, open_at, n_windows = [], Capacities(window), defaultdict(list), 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fit = window, window // length
                first, have = n_windows, -(-left // fit)
                n_windows += have
            else:
                fit = room // length
                first, have = open_at[room].pop()
                tree.add(room, -have)
            used = min(have, -(-left // fit))
            if used < have:
                open_at[room].append((first + used, have - used))
                tree.add(room, have - used)
            count = min(left, used * fit)
            rules.append((length, rank, count, first, fit, window - room))
            full, some = divmod(count, fit)
            for at, windows, taken in ((first, full, fit), (first + full, 1 if some else 0, some)):
                if windows:
                    rest = room - taken * length
                    open_at[rest].append((at, windows))
                    tree.add(rest, windows)
            rank, left = rank + count, left - count
    return rules


def _place(rules: np.ndarray):
    """Adds sequence_id and offset to pieces whose last column is their rank."""
    starts = rules[:, 0] * (1 << 44) + rules[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            r = rules[np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1]
            nth = rank - r[:, 1]
            cols = [*b.columns[:5], pa.array(r[:, 3] + nth // r[:, 4]), pa.array(r[:, 5] + nth % r[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, vocabulary: str | None = None, window: int = WINDOW, end: int = END, full_lot: int = 500_000) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    # one pass over the texts; what stays is a few numbers for each piece
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut(vocabulary or public_vocabulary(), window, end), PIECES).withColumn("nth", F.monotonically_increasing_id()).checkpoint()
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    total = sum(counts.values())
    # ranks within a length by hashed lots, as one length may hold a third of all pieces
    lots = max(256, total // 100_000)
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lots)))
    sizes = dealt.groupBy("length", "lot").count()
    # a lot this full holds copies of a row, id and all; they are spread by where they stand
    full = sizes.where(F.col("count") > full_lot).select("length", "lot", F.ceil(F.col("count") / full_lot).alias("parts")).checkpoint()
    if full.limit(1).count():  # total / full_lot of them at most
        dealt = dealt.join(full, ["length", "lot"], "left").withColumn("lot", F.col("lot") + lots * F.coalesce(F.pmod("nth", "parts"), F.lit(0))).drop("parts")
        sizes = dealt.groupBy("length", "lot").count()
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("length", "lot", (F.sum("count").over(before) - F.col("count")).alias("base"))
    within = Window.partitionBy("length", "lot").orderBy("doc_id", "start", "ids_crc32", "nth")
    ranked = (
        dealt.repartition(parts_for(spark, total, 500_000), "length", "lot")
        .withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["length", "lot"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).cast("long").alias("rank"))
    )
    rules = np.array(sorted(plan(counts, window)) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    return ranked.mapInArrow(_place(rules), PIECES + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
