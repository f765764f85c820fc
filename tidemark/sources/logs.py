"""Readers of change logs: Parquet, newline-delimited JSON batches, and binary log files."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.operators.wal import BLOCK_BYTES, HEADER_BYTES, crc32c, reassemble

BATCH = "ts bigint, entries array<struct<op: int, k: bigint, v: string>>"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {"ts", "entries": [{"op", "k", "v"}]} with a declared schema."""
    return spark.read.schema(BATCH).json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {"lsn", "checksum", "payload"}: adds `ok`, whether the payload has its CRC-32C."""
    rows = spark.read.schema("lsn bigint, checksum bigint, payload string").json(path)
    return rows.withColumn("ok", F.coalesce(crc32c(F.col("payload").cast("binary")) == F.col("checksum"), F.lit(False)))


def log_pieces(data: bytes) -> list[tuple[int, int, bytes, int]]:
    """Physical records (pos, kind, payload, crc) of a log file: blocks of 32 kB, headers of checksum (4
    bytes), length (2) and kind (1), little-endian; zeros fill a block.  A file that ends within
    a record gives a last piece of kind 0, which no reader takes."""
    out, at = [], 0
    while at < len(data):
        left = BLOCK_BYTES - at % BLOCK_BYTES
        if left < HEADER_BYTES:
            at += left
            continue
        if at + HEADER_BYTES > len(data):
            break
        crc, length, kind = struct.unpack_from("<IHB", data, at)
        if not length and not kind:
            at += left
            continue
        end = at + HEADER_BYTES + length
        if end > len(data) or HEADER_BYTES + length > left:
            out.append((at, 0, b"", 0))
            break
        out.append((at, kind, data[at + HEADER_BYTES : end], crc))
        at = end
    return out


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, payload) of the whole records of binary log files, each up to its first damaged,
    misplaced or cut one (C10, C11).  A file is read by one task, which holds it."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(name, *p) for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in log_pieces(data)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["k", "pos", "kind", "payload", "crc"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    pieces = files.mapInArrow(run, "k string, pos long, kind int, payload binary, crc long")
    return reassemble(pieces).withColumnRenamed("k", "file")


def recover(spark: SparkSession, path: str) -> DataFrame:
    """Versions (file, ts: the record's place, seq, op, k, v) of the batches in binary log files, in the
    order that replaying applies them (C11, C12); a record that is no batch has no rows."""
    rows = read_log_files(spark, path).withColumn("entries", versions.decode_batch(F.col("payload")))
    return rows.select("file", F.col("pos").alias("ts"), F.posexplode("entries").alias("seq", "e")).select("file", "ts", F.col("seq").cast("long").alias("seq"), "e.op", "e.k", "e.v")
