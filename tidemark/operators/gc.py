"""Version garbage collection and compaction output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import DELETE


def mvcc_gc(log: DataFrame, horizon: int, deepest: bool = True) -> DataFrame:
    """Keeps every version at or after the horizon and each key's newest before it; older ones
    go, and at the deepest level so does that newest if it is a tombstone (C3, N2).

    The floor version is an aggregation with map-side combine, so a hot key is not sorted."""
    old = log.where(F.col("ts") < horizon)
    floor = old.groupBy("k").agg(F.max(F.struct("ts", "seq", "op")).alias("f")).select("k", "f.ts", "f.seq", "f.op")
    if deepest:
        floor = floor.where(F.col("op") != DELETE)
    kept = old.join(floor.select("k", "ts", "seq"), ["k", "ts", "seq"], "left_semi")
    return log.where(F.col("ts") >= horizon).unionByName(kept)


def compact(log: DataFrame, horizon: int, *, deepest: bool = True, per_file: int = 1000, key_block: int = 16) -> DataFrame:
    """What compaction writes: collected versions in (k, ts desc) order with an output file each,
    cut every `per_file` rows within a block of keys (C2, N5)."""
    rows = mvcc_gc(log, horizon, deepest).withColumn("block", F.floor(F.col("k") / key_block).cast("long"))
    order = Window.partitionBy("block").orderBy("k", F.desc("ts"), F.desc("seq"))
    return rows.withColumn("part", F.floor((F.row_number().over(order) - 1) / per_file).cast("long"))
