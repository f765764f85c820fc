"""Hybrid logical clocks (48 bits of milliseconds, 16 bits of a counter) and key codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import SLAB_ROWS, running, slab_cuts


def hlc_now(events: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(node, id, ms) in id order -> `hlc` (S3): stamps rise strictly, at least to the physical time;
    more than 65,536 in a millisecond carry into the wall part.

    A stamp is max(ms << 16, the one before + 1), so less its row's number it is a running maximum."""
    at = F.col("id")
    cuts = slab_cuts(events, at, slab_rows)
    rows = running(events, ["node"], ["id"], F.lit(1).cast("long"), "sum", at, "__tm_n", cuts=cuts)
    rows = running(rows, ["node"], ["id"], F.shiftleft(F.col("ms").cast("long"), 16) - F.col("__tm_n"), "max", at, "hlc", cuts=cuts)
    return rows.withColumn("hlc", F.col("hlc") + F.col("__tm_n")).drop("__tm_n")


def wall_of(hlc: Column) -> Column:
    return F.shiftrightunsigned(hlc, 16)


def logical_of(hlc: Column) -> Column:
    return hlc.bitwiseAND(F.lit(65535).cast("long"))


def hlc_merge(received: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(node, id, ms, remote_wall, remote_logical) -> the clock after all receipts (S4): the wall part
    is the largest of own, remote and physical; the counter follows whichever it came from, and
    carries into the wall part.

    Each receipt makes the stamp max(own, remote, ms << 16 less one) + 1: the last stamp is the largest
    of what each receipt would make it by itself and the receipts after it."""
    ahead = running(received.select("node", "id", "ms", "remote_wall", "remote_logical"), ["node"], [F.desc("id")], F.lit(1).cast("long"), "sum", F.col("id"), "__tm_left", newest_first=True, slab_rows=slab_rows)
    remote = F.shiftleft(F.col("remote_wall").cast("long"), 16) + F.col("remote_logical")
    made = F.greatest(remote, F.shiftleft(F.col("ms").cast("long"), 16) - 1, F.lit(0).cast("long")) + F.col("__tm_left")
    return ahead.groupBy("node").agg(F.max(made).alias("c")).select("node", wall_of(F.col("c")).alias("wall"), logical_of(F.col("c")).alias("logical"))


def encode_key(key: Column, ts: Column) -> Column:
    """key ++ big-endian(~ts) as binary: newest first under byte order."""
    return F.concat(key, F.unhex(F.lpad(F.hex(F.bitwise_not(ts)), 16, "0")))


def decode_key(encoded: Column) -> Column:
    """struct(key, ts); shorter than eight bytes: the whole is the key and ts 0."""
    n = F.length(encoded)
    ts = F.bitwise_not(F.conv(F.hex(F.substring(encoded, n - 7, F.lit(8))), 16, -10).cast("long"))
    short = n < 8
    return F.struct(F.when(short, encoded).otherwise(F.substring(encoded, F.lit(1), n - 8)).alias("key"), F.when(short, F.lit(0).cast("long")).otherwise(ts).alias("ts"))
