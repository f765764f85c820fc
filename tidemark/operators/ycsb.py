"""Key-value benchmark workloads as data: keys, mixes and read-modify-write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of reads (percent) and what the rest does, by workload.
MIXES = {"A": (50, "update"), "B": (95, "update"), "C": (100, "update"), "D": (95, "insert"), "F": (50, "rmw")}


def key(i: Column) -> Column:
    """`user` and twelve digits."""
    return F.concat(F.lit("user"), F.lpad(i.cast("string"), 12, "0"))


def operation(draw: Column, workload: str) -> Column:
    """The operation for a draw in 0..99."""
    reads, other = MIXES[workload]
    return F.when(draw < reads, "read").otherwise(other)


def flip_first(value: Column) -> Column:
    """Hex of the value with its first byte complemented."""
    return F.concat(F.lpad(F.hex(255 - F.ascii(value)), 2, "0"), F.hex(F.substring(value, 2, 1 << 30)))


def zipf(id_: Column, n: int, s: float = 1.1, seed: int = 1) -> Column:
    """A key number in 0..n-1 with probability near (1 + i)^-s, from a hash of the id: the same data on
    any partitioning (Z7)."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_), 11).cast("double") / F.lit(float(1 << 53))
    at = F.pow(u * ((n + 1.0) ** (1 - s) - 1) + 1, F.lit(1 / (1 - s))) - 1
    return F.least(F.floor(at), F.lit(n - 1)).cast("long")


def generate(spark, ops: int, keys: int, workload: str, value_bytes: int = 256) -> DataFrame:
    """(id, k, operation, value): `ops` operations on `keys` keys; reads have no value, and an insert has a
    key of its own after the loaded ones."""
    draw = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(100))
    rows = spark.range(ops).select("id", operation(draw, workload).alias("operation"))
    rows = rows.withColumn("k", F.when(F.col("operation") == "insert", F.col("id") + keys).otherwise(zipf(F.col("id"), keys)))
    filled = F.rpad(F.hex(F.xxhash64(F.lit(3), "id")), value_bytes, "0")
    return rows.withColumn("value", F.when(F.col("operation") != "read", filled))


def load(spark, keys: int, value_bytes: int = 256) -> DataFrame:
    """(k, loaded): the table before the workload."""
    return spark.range(keys).select(F.col("id").alias("k"), F.rpad(F.hex(F.xxhash64(F.lit(4), "id")), value_bytes, "0").alias("loaded"))


def replay(loaded: DataFrame, ops: DataFrame, *, writes: bool = True, chunk: int = 250_000) -> DataFrame:
    """Every operation with what it sees, the value of its key just before it (`seen`).

    Popular keys are not sorted in one task: operations are cut into chunks of ids, each key is
    ordered within its chunk, and one row a key and chunk carries the last write on to later
    chunks.  Without writes a lookup of the loaded table is all there is."""
    if not writes:
        return ops.join(loaded, "k", "left").withColumnRenamed("loaded", "seen")
    cut = ops.withColumn("chunk", F.floor(F.col("id") / chunk))
    order = Window.partitionBy("k", "chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last("value", ignorenulls=True).over(order))
    ends = cut.where("value is not null").groupBy("k", "chunk").agg(F.max_by("value", "id").alias("v"))
    heads = cut.select("k", "chunk").distinct().join(ends, ["k", "chunk"], "left")
    far = F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = heads.withColumn("far", far).join(loaded, "k", "left").select("k", "chunk", F.coalesce("far", "loaded").alias("far"))
    return near.join(carried, ["k", "chunk"]).select("id", "k", "operation", "value", F.coalesce("near", "far").alias("seen"))


def run(table, ops: DataFrame, ts: int) -> DataFrame:
    """Operations (id, k, operation, value) on a VersionedTable of values (Z7): commits their writes at
    `ts`, in the order of ids, as one durable commit, and returns what each operation sees.  The reads are
    planned on the table before the commit, so they see what each operation would have seen."""
    before = table.view().select("k", F.col("value").alias("loaded"))
    seen = replay(before, ops)
    writes = ops.where("value is not null").select("k", F.lit(ts).cast("long").alias("ts"), F.col("id").alias("seq"), F.lit(1).alias("op"), "value")
    table.append(writes)
    return seen
