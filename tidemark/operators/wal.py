"""Log replay, group commit, fragments and token buckets."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.fold import SLAB_ROWS, ordered_fold, running, slab_cuts

# Fixed values of the record format.
BLOCK_BYTES, HEADER_BYTES = 32768, 7


def replay(log: DataFrame, bad: Column, by: str = "k", order: str = "ts") -> DataFrame:
    """Records before the first bad one of each log (C11, C12): the cut is one aggregation."""
    cut = log.where(bad).groupBy(by).agg(F.min(order).alias("__tm_cut"))
    return log.join(cut, by, "left").where(F.col("__tm_cut").isNull() | (F.col(order) < F.col("__tm_cut"))).drop("__tm_cut")


def group_commit(records: DataFrame, most: int, delay: int) -> DataFrame:
    """(k, ts, at) -> `batch`: a batch ends at `most` records or `delay` after its first."""

    def step(s, _, at):  # batch, records in it, its first time
        if s[0] < 0 or s[1] >= most or at - s[2] >= delay:
            s[:] = s[0] + 1, 0, at
        s[1] += 1
        return s[0]

    return ordered_fold(records.select("k", "ts", "at"), "k", ["ts", "at"], lambda: [-1, 0, 0], step, "batch", "bigint").select("k", "ts", "batch")


def token_bucket(requests: DataFrame, burst: int, rate: int) -> DataFrame:
    """(k, ts, cost) -> `granted`: `rate` tokens a unit of ts, `burst` at most."""

    def step(s, ts, cost):  # tokens, when they were counted
        s[:] = min(burst, s[0] + (ts - (ts if s[1] is None else s[1])) * rate), ts
        ok = s[0] >= cost
        if ok:
            s[0] -= cost
        return ok

    return ordered_fold(requests.select("k", "ts", "cost"), "k", ["ts", "cost"], lambda: [burst, None], step, "granted", "boolean").select("k", "ts", "granted")


FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def fragments(records: DataFrame) -> DataFrame:
    """(k, ts, bytes) -> the physical records that a log `k` writes, in order (C9): (k, ts, piece, kind, block,
    offset, length, skip).  Every piece has a header of its own and ends within its block; where less
    than a header is left of a block it is filled with `skip` zeros.  Where a record lies depends on
    all before it, so a log is one task's time, though not its memory."""
    piece = "struct<piece: bigint, kind: int, block: bigint, offset: bigint, length: bigint, skip: bigint>"

    def step(s, _, left):  # block, offset in it
        out, n, first, left = [], 0, True, left or 0
        while first or left:
            skip = 0
            if BLOCK_BYTES - s[1] < HEADER_BYTES:
                skip, s[0], s[1] = BLOCK_BYTES - s[1], s[0] + 1, 0
            length = min(left, BLOCK_BYTES - s[1] - HEADER_BYTES)
            left -= length
            kind = (FULL if not left else FIRST) if first else MIDDLE if left else LAST
            out.append({"piece": n, "kind": kind, "block": s[0], "offset": s[1], "length": length, "skip": skip})
            s[1] += HEADER_BYTES + length
            n, first = n + 1, False
        return out

    done = ordered_fold(records.select("k", "ts", "bytes"), "k", ["ts"], lambda: [0, 0], step, "pieces", f"array<{piece}>")
    return done.select("k", "ts", F.explode("pieces").alias("p")).select("k", "ts", "p.*")


def _place(s: list, left: int) -> list[tuple[int, int, int]]:
    """The pieces (kind, position, length) of a record of `left` bytes; s: block and offset in it."""
    out, first = [], True
    while first or left:
        if BLOCK_BYTES - s[1] < HEADER_BYTES:
            s[:] = s[0] + 1, 0
        length = min(left, BLOCK_BYTES - s[1] - HEADER_BYTES)
        left -= length
        kind = (FULL if not left else FIRST) if first else MIDDLE if left else LAST
        out.append((kind, s[0] * BLOCK_BYTES + s[1], length))
        s[1] += HEADER_BYTES + length
        first = False
    return out


def cut_payloads(records: DataFrame) -> DataFrame:
    """(k, ts, payload: binary, ..) -> the physical records with their bytes: (k, pos, kind, payload, crc, ..),
    pos counted from 0 in each log, crc the CRC-32C of kind and payload (C9, S6); other columns of a
    record are those of each of its pieces.

    Read once in order, as in `fragments`: a batch's pieces lie one after another where its
    payloads lay, so only the bounds between them are made."""
    extra = [c for c in records.columns if c not in ("k", "ts", "payload")]
    names = ["k", "pos", "kind", "payload", *extra]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key, s = object(), [0, 0]
        for b in batches:
            whole = pc.fill_null(b.column(1).cast(pa.binary()), b"")
            ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
            of, pieces = [], []
            for i, (k, size) in enumerate(zip(b.column(0).to_pylist(), np.diff(ends).tolist(), strict=True)):
                if k != key:
                    key, s = k, [0, 0]
                placed = _place(s, size)
                pieces += placed
                of += [i] * len(placed)
            kind, pos, length = np.array(pieces, np.int64).reshape(-1, 3).T
            bounds = np.concatenate([ends[:1], ends[0] + np.cumsum(length)]).astype(np.int32)
            payload = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(bounds), whole.buffers()[2]])
            other = [b.column(i).take(pa.array(of, pa.int64())) for i in (0, *range(2, 2 + len(extra)))]
            yield pa.RecordBatch.from_arrays([other[0], pa.array(pos), pa.array(kind.astype(np.int32)), payload, *other[1:]], names)

    kinds = {f.name: f for f in records.schema.fields}
    schema = T.StructType([kinds["k"], T.StructField("pos", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("payload", T.BinaryType()), *[kinds[c] for c in extra]])
    placed = _dealt(records).sortWithinPartitions("k", "ts").select("k", "payload", *extra).mapInArrow(run, schema)
    return placed.select("k", "pos", "kind", "payload", _checksum().alias("crc"), *extra)


def _dealt(rows: DataFrame) -> DataFrame:
    """By log, into as many parts as the session says: they would be merged by their compressed size, and
    payloads to be sorted may be many times as large."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")


def _checksum() -> Column:
    return crc32c(F.concat(F.unhex(F.lpad(F.hex("kind"), 2, "0")), F.coalesce("payload", F.unhex(F.lit("")))))


def _joined(checked: DataFrame) -> DataFrame:
    """(k, pos, kind, payload, ok) -> (k, pos, payload) of `reassemble`, each log read once in order."""

    def run(batches):
        import pyarrow as pa

        key, dead, first, parts = object(), False, None, []
        for b in batches:
            out, payload = [], b.column(3)
            for i, (k, pos, kind, ok) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                if k != key:
                    key, dead, first, parts = k, False, None, []
                if dead:
                    continue
                if not ok or (kind in (MIDDLE, LAST)) != (first is not None):
                    dead, first, parts = True, None, []
                    continue
                first = pos if first is None else first
                parts.append(payload[i].as_py())
                if kind in (FULL, LAST):
                    out.append((k, first, b"".join(parts)))
                    first, parts = None, []
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), pa.array(columns[1], b.column(1).type), pa.array(columns[2], pa.binary())], ["k", "pos", "payload"])

    schema = T.StructType([checked.schema["k"], checked.schema["pos"], T.StructField("payload", T.BinaryType())])
    return _dealt(checked).sortWithinPartitions("k", "pos").mapInArrow(run, schema)


def most_pieces(size: Column) -> Column:
    """How many pieces a record of `size` bytes has at most."""
    return F.floor(F.coalesce(size, F.lit(0)) / (BLOCK_BYTES - HEADER_BYTES)) + 2


def reassemble(pieces: DataFrame, slab_rows: int = SLAB_ROWS, longest: int | None = None) -> DataFrame:
    """(k, pos, kind, payload, crc) -> (k, pos: of its first piece, payload) of the records before the
    first piece that is corrupt or out of turn (C10, C11); an unfinished last record is left out.

    Logs of at most `slab_rows` pieces are read once in order.  A longer one would be one task's time:
    whether a piece is in turn follows from the one before it, so all but the joining of a record's
    pieces is then running totals.  `longest`: what no log has more pieces than, if that is known; they
    are counted otherwise."""
    sound = F.coalesce(_checksum() == F.col("crc"), F.lit(False)) & F.coalesce(F.col("kind").between(FULL, LAST), F.lit(False))
    if longest is None:
        longest = pieces.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    if longest <= slab_rows:
        return _joined(pieces.select("k", "pos", "kind", F.coalesce("payload", F.unhex(F.lit(""))).alias("payload"), sound.alias("ok")))
    at = F.col("pos")
    cuts = slab_cuts(pieces, at, slab_rows)
    rows = pieces.withColumn("__tm_ok", sound)
    rows = running(rows, ["k"], ["pos"], F.col("kind"), "last", at, "__tm_before", own=False, cuts=cuts)
    inside = F.coalesce(F.col("__tm_before").isin(FIRST, MIDDLE), F.lit(False))
    rows = rows.withColumn("__tm_ok", F.col("__tm_ok") & (F.col("kind").isin(MIDDLE, LAST) == inside))
    good = replay(rows, ~F.col("__tm_ok"), "k", "pos")
    opens = F.when(F.col("kind").isin(FULL, FIRST), F.col("pos"))
    good = running(good, ["k"], ["pos"], opens, "last", at, "__tm_first", cuts=cuts)
    parts = F.array_sort(F.collect_list(F.struct("pos", "payload")))  # of one record
    done = good.groupBy("k", "__tm_first").agg(parts.alias("p"), F.max(F.col("kind").isin(FULL, LAST)).alias("whole")).where("whole")
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, F.coalesce(x["payload"], F.unhex(F.lit("")))))
    return done.select("k", F.col("__tm_first").alias("pos"), joined.alias("payload"))


#: Bytes that one step of a checksum takes.
_CHUNK = 64


@cache
def _crc_tables():
    """Of CRC-32C from 0, which is linear: what each byte of a chunk adds to its checksum, by place, and
    what a checksum's four bytes become after a chunk of zeros."""
    import numpy as np

    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):  # the Castagnoli polynomial, reflected
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)

    def on(crc):  # a byte of zeros
        return one[crc & 0xFF] ^ (crc >> np.uint32(8))

    places = [one]
    for _ in range(_CHUNK - 1):
        places.insert(0, on(places[0]))
    far = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
    for _ in range(_CHUNK):
        far = [on(x) for x in far]
    return places, far


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of bytes, null of null (S6), since the built-in CRC-32 has another polynomial: chunks of a
    batch's rows at once, each by its bytes' places, and then a row's chunks one after another."""
    import numpy as np

    rows = [(i, x) for i, x in enumerate(data) if x is not None]
    out = np.zeros(len(data), np.int64)
    if rows:
        # zeros in front change nothing; beginning with all ones is to complement the first four bytes
        rows.sort(key=lambda r: -len(r[1]))
        size = np.array([len(x) for _, x in rows], np.int64)
        chunks = (np.maximum(size, 4) + _CHUNK - 1) // _CHUNK
        raw = np.frombuffer(bytearray().join(x.rjust(n * _CHUNK, b"\0") for (_, x), n in zip(rows, chunks.tolist(), strict=True)), np.uint8)
        last = np.cumsum(chunks)
        begin = last * _CHUNK - size
        for i in range(4):
            raw[begin[size > i] + i] ^= 0xFF
        places, far = _crc_tables()
        each = np.zeros(len(raw) // _CHUNK, np.uint32)
        for at in range(0, len(each), 8192):  # what the processor's cache holds
            here = each[at : at + 8192]
            for table, byte in zip(places, np.ascontiguousarray(raw.reshape(-1, _CHUNK)[at : at + 8192].T), strict=True):
                here ^= table.take(byte, mode="wrap")
        crc, first = np.zeros(len(rows), np.uint32), last - chunks
        for i in range(int(chunks[0])):  # rows of more chunks come first
            n = int(np.searchsorted(-chunks, -i))
            c = crc[:n]
            crc[:n] = far[0][c & 0xFF] ^ far[1][c >> 8 & 0xFF] ^ far[2][c >> 16 & 0xFF] ^ far[3][c >> 24] ^ each[first[:n] + i]
        # of fewer than four bytes some ones are left over, moved down by the bytes there were
        left = np.where(size < 4, np.uint32(0xFFFFFFFF) >> (8 * np.minimum(size, 3)).astype(np.uint32), 0).astype(np.uint32)
        out[[i for i, _ in rows]] = crc ^ left ^ np.uint32(0xFFFFFFFF)
    return pd.Series(out).where(data.notna().reset_index(drop=True))
