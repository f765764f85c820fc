"""Operator 2, substring dedup with a count-min prefilter.

A window is `width` consecutive words of one document.  Windows whose word sequence starts
anywhere else too are repeated, and every word they cover is removed.

1. Every task counts its windows in a partition sketch: `DEPTH` rows of saturating counters,
   sent as sorted, gap-coded cells, block by block.  Blocks are summed; what is left of the
   merged sketch is one bit a cell, "counted twice or more".  Counters never underestimate.
2. A second pass sends on only windows whose cells are all at two or more, by two independent
   hashes of 64 and 32 bits, neither of them a polynomial: a task asks once about each of them, and says of what it has itself met twice that it is
   repeated, so a passage in a third of all rows costs one line a task.  Exact grouping by
   hash answers which are repeated; none is lost, as the sketch only overestimates.
3. The answers meet the documents by a hash of the row, and the covered words go.

The sketch has eight bits a window up to `max_bits` (128 MB, the bound of what is broadcast);
beyond that it is fuller and lets more windows through to the exact pass, which needs nothing
but the shuffle: about 7 % of unrepeated windows at 1 GB of text, 90 % at 10 GB, all from 30 GB on,
unless `max_bits` grows too.  All else is streamed or blocked by bytes; rows that are equal, doc_id
included, are spread over several lots, each with all answers.

Defined results: null or empty texts have no words; fewer words than a window: nothing goes;
rows with equal doc_id and text are copies of one another, so what they share goes from each;
a null doc_id is allowed; other columns pass through `dedup` unchanged; no rows, no result."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BLANK, U64, chunked, mix, own, parts_for, prepare, sequences, spans, table, text_buffer, word_hashes

WIDTH = 35
DEPTH = 2
MAX_BITS = 1 << 30
BLOCK = 1 << 22
#: Bytes of text hashed at once, and windows gathered before a task sends them.
CHUNK, FLUSH = (1 << 19) - 1, 1_500_000
#: Bytes of the merged sketch that the driver takes at once.
FETCH = 4 << 20
_SEED = [U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)]


def windows_of(raw: np.ndarray, offs: np.ndarray, width: int, check: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window: two independent hashes (64 and 32 bits; the second is empty without
    `check`), its row and its first word's number there."""
    start, end, row = spans(raw, offs, ~BLANK)
    if len(start) < width:
        z = np.zeros(0, np.int64)
        return z.view(U64), z.astype(np.uint32), z, z
    at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    h1 = sequences(word_hashes(raw, start, end, 0x243F6A8885A308D3), width, 0xD1342543DE82EF95)[at]
    h2 = at[:0].astype(np.uint32)
    if check:
        h2 = (sequences(word_hashes(raw, start, end, 0x13198A2E03707344), width, 0xAF251AF3B0F025B5)[at] >> U64(32)).astype(np.uint32)
    return h1, h2, row[at], at - first[row[at]]


def _all_windows(batches: Iterator[pa.RecordBatch], column: int, width: int, check: bool = True):
    """(batch, h1, h2, row in batch, word) by chunks of text."""
    own("signs")
    for b in batches:
        raw, offs = text_buffer(b.column(column))
        for i, j in chunked(offs, CHUNK):
            h1, h2, row, at = windows_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width, check)
            yield b, h1, h2, row + i, at


def _cells(h1: np.ndarray, level: int, log_width: int) -> np.ndarray:
    return mix(h1 ^ _SEED[level]) >> U64(64 - log_width)


def _planes(a: np.ndarray) -> bytes:
    """Byte planes, so that high bytes that hardly vary compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def _encode(cells: np.ndarray, twice: np.ndarray) -> bytes:
    gaps = np.diff(cells, prepend=U64(0)).astype(np.uint32)
    return len(cells).to_bytes(4, "little") + zstandard.compress(_planes(gaps) + np.packbits(twice).tobytes(), 1)


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    data = zstandard.decompress(blob[4:])
    return np.cumsum(_from_planes(data[: 4 * n], np.uint32, n), dtype=np.int64), np.unpackbits(np.frombuffer(data[4 * n :], np.uint8), count=n)


def _sketch(width: int, log_width: int):
    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(parts)
        parts.clear()  # here and below: what was put together is not held twice
        for level in range(DEPTH):
            cells = np.sort(_cells(h, level, log_width))
            head = np.ones(len(cells), bool)
            head[1:] = cells[1:] != cells[:-1]
            at = np.flatnonzero(head)
            twice = np.diff(at, append=len(cells)) > 1
            cells = cells[at]
            blocks = np.arange(0, (1 << log_width) + 1, min(BLOCK, 1 << log_width), dtype=U64)
            edges = np.searchsorted(cells, blocks)
            keep = [k for k in range(len(blocks) - 1) if edges[k] < edges[k + 1]]
            blobs = [_encode(cells[edges[k] : edges[k + 1]] - blocks[k], twice[edges[k] : edges[k + 1]]) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([level * (len(blocks) - 1) + k for k in keep], pa.int32()), pa.array(blobs, pa.binary())], ["block", "cells"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for _, h1, _, _, _ in _all_windows(batches, 0, width, check=False):
            parts.append(h1)
            n += len(h1)
            if n >= FLUSH:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return run


def _merge(size: int):
    """Sums the partition sketches of each block (rows come sorted by block); a bit a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, counts = block, np.zeros(size, np.uint8)
                cells, twice = _decode(blob)
                counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)
        if now is not None:
            yield done()

    return run


def _pack(h1: np.ndarray, h2: np.ndarray, key: np.ndarray, at: np.ndarray, state: np.ndarray) -> bytes:
    """state 1: an answer is wanted, 2: known to be repeated, asked on behalf of nobody."""
    order = np.lexsort((at, key)) if len(key) else np.zeros(0, np.int64)
    cols = [h1[order], h2[order], key[order], at[order].astype(np.uint32), state[order].astype(np.uint8)]
    return len(order).to_bytes(4, "little") + zstandard.compress(b"".join(_planes(c) if len(c) else b"" for c in cols), 1)


_KINDS = (U64, np.uint32, np.int64, np.uint32, np.uint8)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, out, i = int.from_bytes(blob[:4], "little"), [], 0
    data = zstandard.decompress(blob[4:]) if n else b""
    for kind in _KINDS:
        size = np.dtype(kind).itemsize * n
        out.append(_from_planes(data[i : i + size], kind, n) if n else np.zeros(0, kind))
        i += size
    return out


def _answer(key: np.ndarray, at: np.ndarray) -> bytes:
    order = np.lexsort((at, key))
    return len(order).to_bytes(4, "little") + zstandard.compress(_planes(key[order]) + _planes(at[order].astype(np.uint32)), 1)


def _read_answer(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    data = zstandard.decompress(blob[4:])
    return _from_planes(data[: 8 * n], np.int64, n), _from_planes(data[8 * n :], np.uint32, n)


def _grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs of hashes together, and whether each begins a group."""
    order = np.argsort(h1)
    for _ in range(2):
        a, b = h1[order], h2[order]
        near, other = a[1:] == a[:-1], b[1:] != b[:-1]
        if not (near & other).any():
            break
        order = np.lexsort((h2, h1))  # windows that share the longer hash alone
    head = np.ones(len(order), bool)
    head[1:] = ~near | other
    return order, head


class Lots:
    """Deals keys to lots by their remainder; what concerns a heavy key goes to each of the
    `parts` lots that its rows are spread over, from `first` on."""

    def __init__(self, lots: int, heavy: list[tuple[int, int]] = ()) -> None:
        self.lots, self.heavy = lots, {}
        for key, parts in sorted(heavy):
            self.heavy[key] = (lots, parts)
            lots += parts
        self.every, self.keys = lots, np.array(sorted(self.heavy), np.int64)

    def deal(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(lot, places of its keys)"""
        lot = (keys.view(U64) % U64(self.lots)).astype(np.int64)
        heavy = np.isin(keys, self.keys) if len(self.keys) else np.zeros(len(keys), bool)
        light = np.flatnonzero(~heavy)
        order = light[np.argsort(lot[light], kind="stable")]
        heads = np.flatnonzero(np.diff(lot[order], prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True) if len(heads) else ():
            yield int(lot[order[a]]), order[a:b]
        for key in np.unique(keys[heavy]).tolist():
            first, parts = self.heavy[key]
            mine = np.flatnonzero(keys == key)
            for k in range(first, first + parts):
                yield k, mine


def _ask(width: int, log_width: int, shared, lots: Lots):
    """Second pass: rows (lot, known, data).  known: an answer for documents; else questions."""
    by_hash = Lots(lots.lots)

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, key, at = (np.concatenate(p) for p in zip(*parts, strict=True))
        parts.clear()
        order, head = _grouped(h1, h2)
        h1, h2, key, at = h1[order], h2[order], key[order], at[order]
        first = np.flatnonzero(head)
        size = np.diff(first, append=len(h1))
        many = size > 1
        known = np.repeat(many, size)
        del order, head, size
        rows: list[tuple[int, bool, bytes]] = []
        state = np.where(many, 2, 1)
        # a witness needs no document
        ask1, ask2, who, where = h1[first], h2[first], np.where(many, 0, key[first]), np.where(many, 0, at[first])
        # nothing in these loops may touch all windows: there are as many lots as the table is large
        for k, i in by_hash.deal(ask1.view(np.int64)):
            rows.append((k, False, _pack(ask1[i], ask2[i], who[i], where[i], state[i])))
        del h1, h2, ask1, ask2, who, where, state
        mine = np.flatnonzero(known)
        mine = mine[np.lexsort((at[mine], key[mine]))]  # equal rows say the same
        new = (np.diff(key[mine], prepend=0) != 0) | (np.diff(at[mine], prepend=-1) != 0)
        if len(mine):
            new[0] = True
        key, at = key[mine[new]], at[mine[new]]
        for k, i in lots.deal(key):
            rows.append((k, True, _answer(key[i], at[i])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())],
            ["lot", "known", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, parts, n = shared.value, [], 0
        for b, h1, h2, row, at in _all_windows(batches, 1, width):
            keep = np.arange(len(h1))
            for level in range(DEPTH):
                cell = _cells(h1[keep], level, log_width)
                keep = keep[(bits[level][(cell >> U64(3)).astype(np.int64)] >> (7 - (cell & U64(7))).astype(np.uint8)) & 1 == 1]
            if len(keep):
                parts.append((h1[keep], h2[keep], b.column(0).to_numpy()[row[keep]], at[keep]))
                n += len(keep)
            if n >= FLUSH:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return run


def _group(lots: Lots):
    """Exact grouping: what is asked twice, or known to a task, is repeated.  Rows come sorted
    by lot; known answers pass."""

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h1, h2, key, at, state = (np.concatenate(p) for p in zip(*map(_unpack, blobs), strict=True))
        blobs.clear()
        order, head = _grouped(h1, h2)
        total = np.add.reduceat(state[order].astype(np.int64), np.flatnonzero(head)) if len(order) else np.zeros(0, np.int64)
        wanted = order[(total[np.cumsum(head) - 1] > 1) & (state[order] == 1)]
        key, at = key[wanted], at[wanted]
        rows = [(k, _answer(key[i], at[i])) for k, i in lots.deal(key)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["lot", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("grouping")
        now, blobs = None, []
        for b in batches:
            known = b.column(1)
            yield pa.RecordBatch.from_arrays([pc.filter(b.column(0), known), pc.filter(b.column(2), known)], ["lot", "data"])
            asked = b.filter(pc.invert(known))
            for lot, blob in zip(asked.column(0).to_pylist(), asked.column(2).to_pylist(), strict=True):
                if lot != now and blobs:
                    yield from settle(blobs)
                    blobs = []
                now = lot
                blobs.append(blob)
        if blobs:
            yield from settle(blobs)

    return run


def _strip(width: int, text_at: int):
    """Rows sorted by lot, answers first: removes the covered words of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("stripping")
        now, keys, ats, open_ = None, np.zeros(0, np.int64), np.zeros(0, np.uint32), []
        for b in batches:
            lots, keep, out = b.column(0).to_pylist(), [], ([], [], [])
            data, ids = b.column(1), b.column(3)
            texts = pc.struct_field(b.column(2), text_at)
            for i, lot in enumerate(lots):
                if lot != now:
                    now, open_, keys = lot, [], np.zeros(0, np.int64)
                if data[i].is_valid:
                    open_.append(data[i].as_py())
                    continue
                if open_:
                    keys, ats = (np.concatenate(p) for p in zip(*map(_read_answer, open_), strict=True))
                    order = np.lexsort((ats, keys))
                    keys, ats, open_ = keys[order], ats[order], []
                text = texts[i].as_py() or ""
                words = text.encode().split()
                n, key = len(words), ids[i].as_py()
                lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                gone = 0
                if lo < hi:
                    edge = np.zeros(n + width + 1, np.int32)
                    np.add.at(edge, ats[lo:hi], 1)
                    np.add.at(edge, ats[lo:hi].astype(np.int64) + width, -1)
                    covered = np.cumsum(edge)[:n] > 0
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                keep.append(i)
                for o, v in zip(out, (n, gone, b" ".join(words).decode()), strict=True):
                    o.append(v)
            doc = b.column(2).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, *, width: int = WIDTH, max_bits: int = MAX_BITS, lot_bytes: int = 8 << 20, copies: int = 2000, most_parts: int = 65_536) -> DataFrame:
    """(doc: struct of all columns of `docs`, n_words, n_removed, kept: the words left).

    Texts and questions are dealt to lots of about `lot_bytes`, a shuffle has `most_parts` partitions
    at most, and a task takes its lots one by one.  Of the rows with equal text and doc_id a lot
    takes about `copies`."""
    spark = docs.sparkSession
    keyed = docs.select(F.struct("*").alias("doc")).select("doc", F.xxhash64("doc.text", "doc.doc_id").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("doc.text").cast("long")).alias("bytes"))
    stats = counts.agg(F.sum(F.col("n") * F.coalesce("bytes", F.lit(0))), F.sum("n"), F.max("n")).first()
    total, n_rows = stats[0] or 0, stats[1] or 0
    want = max(1 << 16, 8 * (total // 6))  # about a window for six bytes
    log_width = max(10, min((want - 1).bit_length(), max_bits.bit_length() - 1) - (DEPTH - 1).bit_length())
    size = min(BLOCK, 1 << log_width)
    per_level = (1 << log_width) // size
    usual, heavy = max(64, -(-total // lot_bytes)), []
    copies = max(copies, n_rows // 10_000)
    if (stats[2] or 0) > copies:  # 10,000 keys at most
        heavy = [(r["key"], -(-r["n"] // copies)) for r in counts.where(F.col("n") > copies).collect()]
    lots = Lots(usual, heavy)
    parts = min(most_parts, parts_for(spark, lots.every, 1))

    sketches = docs.select("text").mapInArrow(_sketch(width, log_width), "block int, cells binary")
    merged = (
        sketches.repartition(max(1, min(DEPTH * per_level, parts_for(spark, 0, 1) * 4)), "block")
        .sortWithinPartitions("block")
        .mapInArrow(_merge(size), "block int, bits binary")
    )
    bits = np.zeros((DEPTH, max(1, (1 << log_width) // 8)), np.uint8)
    # max_bits / 8 bytes at most: merged by all tasks at once, fetched a few MB at a time, then deleted
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/sketch-{uuid.uuid4().hex}"
    try:
        merged.write.parquet(folder)
        for r in spark.read.schema("block int, bits binary").parquet(folder).coalesce(-(-bits.nbytes // FETCH)).toLocalIterator():
            level, k = divmod(r["block"], per_level)
            bits[level, k * size // 8 : (k + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    shared = spark.sparkContext.broadcast(bits)
    del bits  # workers read the broadcast file; the driver needs no copy

    asked = keyed.select("key", "doc.text").mapInArrow(_ask(width, log_width, shared, lots), "lot int, known boolean, data binary")
    answers = asked.repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(_group(lots), "lot int, data binary")
    # unsigned remainder, as in Lots
    lot = F.expr(f"cast(pmod((shiftrightunsigned(key, 1) % {usual}) * 2 + (key & 1), {usual}) as int)")
    if heavy:
        spread = spark.createDataFrame([(k, *lots.heavy[k]) for k, _ in heavy], "key long, first int, parts int")
        keyed = keyed.join(F.broadcast(spread), "key", "left")
        lot = F.coalesce((F.col("first") + F.pmod(F.monotonically_increasing_id(), "parts")).cast("int"), lot)
    rows = keyed.select(lot.alias("lot"), F.lit(None).cast("binary").alias("data"), "doc", "key")
    none = answers.select("lot", "data", F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"), F.lit(None).cast("long").alias("key"))
    both = none.union(rows).repartition(parts, "lot").sortWithinPartitions("lot", F.col("data").isNull())
    out = T.StructType().add("doc", rows.schema["doc"].dataType).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return both.mapInArrow(_strip(width, docs.columns.index("text")), out)


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN rep USING (h), range(0, 35) t(k)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, ws, coalesce(len(ps), 0) AS n_removed,
         list_filter(ws, lambda x, j: ps IS NULL OR NOT list_contains(ps, j)) AS k
  FROM w LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""
