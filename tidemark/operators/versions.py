"""Reads and merges of versioned rows (k, ts, seq, op, ...).

Latest-per-key is one aggregation with map-side combine (`max_by` of a struct), never a window
over a hot key; deletion is read from `op`, never from a null payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fold import SLAB_ROWS, running, slab_cuts, slab_of
from tidemark.schema import DELETE, PUT


def newest(log: DataFrame, keys: list[str] | None = None, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Newest version per key, tombstones kept (rows W8, M2)."""
    keys = keys or ["k"]
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__tm")
    return log.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__tm.{c}").alias(c) for c in rest])


def latest_view(log: DataFrame) -> DataFrame:
    """Live rows: newest versions that are no tombstones."""
    return newest(log).where(F.col("op") == PUT)


def snapshot_read(log: DataFrame, at: int) -> DataFrame:
    """Live rows as of `at`; the bound is applied before the newest is chosen."""
    return latest_view(log.where(F.col("ts") <= at))


def range_scan(rows: DataFrame, start, end, key: str = "k") -> DataFrame:
    """Rows with start <= key < end in key order; the bounds reach the scan."""
    return rows.where((F.col(key) >= start) & (F.col(key) < end)).orderBy(key)


def snapshot_range_scan(log: DataFrame, start, end, at: int) -> DataFrame:
    """A range at a snapshot, both filters below the aggregation."""
    return latest_view(log.where((F.col("k") >= start) & (F.col("k") < end) & (F.col("ts") <= at))).orderBy("k")


def point_get(log: DataFrame, key) -> DataFrame:
    """The live row of one key."""
    return latest_view(log.where(F.col("k") == key))


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted key with `found` and its live version, if any."""
    live = latest_view(log).withColumn("__tm_hit", F.lit(True))
    return wanted.join(live, "k", "left").withColumn("found", F.coalesce("__tm_hit", F.lit(False))).drop("__tm_hit")


def contains_any_version(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted keys with any version, tombstones included."""
    return wanted.join(log.select("k"), "k", "left_semi")


def asof(probes: DataFrame, log: DataFrame, key: str = "k", time: str = "at", slab_rows: int = SLAB_ROWS) -> DataFrame:
    """For each probe (k, at) the newest version at or before it; misses stay with nulls (J2).  In large
    tables a key's versions and probes are sorted in slabs of time, not in one task."""
    rest = [c for c in log.columns if c != key]
    none = F.lit(None).cast(log.select(F.struct(*rest).alias("s")).schema["s"].dataType)
    left = probes.select(key, F.col(time).alias("__tm_t"), F.lit(1).alias("__tm_p"), none.alias("__tm_v"))
    right = log.select(key, F.col("ts").alias("__tm_t"), F.lit(0).alias("__tm_p"), F.struct(*rest).alias("__tm_v"))
    order = ["__tm_t", "__tm_p", F.col("__tm_v.seq")]
    found = running(left.union(right), [key], order, F.col("__tm_v"), "last", F.col("__tm_t"), "__tm_found", slab_rows=slab_rows).where("__tm_p = 1")
    return found.select(key, F.col("__tm_t").alias(time), *[F.col(f"__tm_found.{c}").alias(c) for c in rest])


def seek_lower_bound(keys: DataFrame, targets: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """The first key >= each target, null past the end (R17): a running minimum from the largest down
    over keys and targets together.  Large tables are cut at quantiles, so neither gaps nor crowds
    among the keys matter; `slab_rows` is what one task sorts."""
    k = keys.select("k", F.lit(1).alias("__tm_p"), F.col("k").alias("__tm_k")).where("k is not null").distinct()
    t = targets.select("k", F.lit(0).alias("__tm_p"), F.lit(None).cast(keys.schema["k"].dataType).alias("__tm_k")).where("k is not null").distinct()
    every = k.union(t).withColumn("__tm_all", F.lit(0))
    cuts = slab_cuts(every, F.col("k"), slab_rows)
    slabbed = every.withColumn("__tm_s", slab_of(F.col("k"), cuts))
    within = Window.partitionBy("__tm_s").orderBy(F.desc("k"), F.desc("__tm_p")).rowsBetween(Window.unboundedPreceding, 0)
    here = slabbed.withColumn("__tm_near", F.min("__tm_k").over(within))
    out = here.where("__tm_p = 0")
    if cuts:
        past = Window.partitionBy("__tm_all").orderBy(F.desc("__tm_s")).rowsBetween(Window.unboundedPreceding, -1)
        heads = slabbed.groupBy("__tm_all", "__tm_s").agg(F.min("__tm_k").alias("__tm_h"))  # a row a slab
        out = out.join(heads.select("__tm_s", F.min("__tm_h").over(past).alias("__tm_h")), "__tm_s").withColumn("__tm_near", F.coalesce("__tm_near", "__tm_h"))
    return out.select(F.col("k").alias("target"), F.col("__tm_near").alias("k"))


def version_rank(log: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Versions numbered from the newest, key order ascending, ts descending."""
    return running(log, ["k"], [F.desc("ts"), F.desc("seq")], F.lit(1).cast("long"), "sum", F.col("ts"), "rn", newest_first=True, slab_rows=slab_rows)


def version_order(log: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Each version with the next newer one of the same key (P2, P3): the least stamp among those before
    it in the order."""
    return running(log, ["k"], [F.desc("ts"), F.desc("seq")], F.col("ts"), "min", F.col("ts"), "newer_ts", newest_first=True, own=False, slab_rows=slab_rows)


def shadowed(log: DataFrame) -> DataFrame:
    """Versions that a newer one hides."""
    return log.join(newest(log).select("k", F.struct("ts", "seq").alias("__tm_top")), "k").where(F.struct("ts", "seq") < F.col("__tm_top")).drop("__tm_top")


def _tagged(tiers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.withColumn("idx", F.lit(i)) for i, t in enumerate(tiers)])


def tiered_merge(tiers: list[DataFrame]) -> DataFrame:
    """Ordered merge of tiers, newest tier first; a key's version in an earlier tier hides those of
    later ones, tombstones included (M1, M2).  Adds `idx`.  One shuffle, whatever the tiers."""
    every = _tagged(tiers)
    rest = [c for c in every.columns if c != "k"]
    first = F.struct(-F.col("idx"), F.col("ts"), F.col("seq"))
    return every.groupBy("k").agg(F.max_by(F.struct(*rest), first).alias("__tm")).select("k", *[F.col(f"__tm.{c}").alias(c) for c in rest])


def merge_versions(tiers: list[DataFrame]) -> DataFrame:
    """Merge of tiers that keeps every version: equal physical keys (k, ts, seq) give one row, that of
    the earliest tier, and tombstones stay (M2, M3).  Adds `idx`."""
    every, key = _tagged(tiers), ["k", "ts", "seq"]
    rest = [c for c in every.columns if c not in key]
    return every.groupBy(*key).agg(F.min_by(F.struct(*rest), "idx").alias("__tm")).select(*key, *[F.col(f"__tm.{c}").alias(c) for c in rest])


def tiered_get(tiers: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """Lookup across tiers: the first tier that knows the key decides."""
    hit = tiered_merge([t.join(wanted.select("k").distinct(), "k", "left_semi") for t in tiers])
    return wanted.join(hit.where(F.col("op") == PUT).withColumn("__tm_hit", F.lit(True)), "k", "left").withColumn("found", F.coalesce("__tm_hit", F.lit(False))).drop("__tm_hit")


def merge_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Upserts and deletes onto a base table: append as newer versions, then the latest view."""
    return latest_view(base.unionByName(changes))


def batch_log(batches: DataFrame, deletes_last: bool = False) -> DataFrame:
    """(ts, entries: array<struct<op, k, v>>) as versions, in entry order (W3); `deletes_last` puts
    all puts before all deletes of a batch (W4)."""
    entries = F.col("entries")
    if deletes_last:
        entries = F.concat(F.filter(entries, lambda e: e.op == PUT), F.filter(entries, lambda e: e.op == DELETE))
    return batches.select("ts", F.posexplode(entries).alias("seq", "e")).select("e.k", "ts", F.col("seq").cast("long").alias("seq"), "e.op", "e.v")


def map_batches(batches: DataFrame) -> DataFrame:
    """(ts, entries) with one entry for each key of a batch, as a client's map has (W5): the last; keys keep
    the place of their first."""
    rows = batch_log(batches)
    kept = rows.groupBy("ts", "k").agg(F.min("seq").alias("seq"), F.max_by(F.struct("op", "v"), "seq").alias("e"))
    return kept.select("k", "ts", "seq", "e.op", "e.v")


def memory_size(key: Column, value: Column) -> Column:
    """Bytes of an entry in memory without its random part."""
    return F.lit(32).cast("long") + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))


# ------------------------------------------------------------------ batch codec


def _le(n: Column, width: int = 4) -> Column:
    """A number as little-endian bytes."""
    digits = F.lpad(F.hex(n), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


def _number(data: Column, at: Column, width: int = 4) -> Column:
    digits = F.hex(F.substring(data, at + 1, F.lit(width)))
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).cast("long")


def encode_batch(entries: Column) -> Column:
    """array<struct<op, k: binary, v: binary>> as bytes (W10): the number of entries in four bytes, then
    op in one, key and value each with its length in four before it, all little-endian; a null
    value has length 0."""
    empty = F.unhex(F.lit(""))

    def entry(e: Column) -> Column:
        k, v = F.coalesce(e["k"], empty), F.coalesce(e["v"], empty)
        return F.concat(_le(e["op"].cast("int"), 1), _le(F.octet_length(k)), k, _le(F.octet_length(v)), v)

    return F.aggregate(F.transform(entries, entry), _le(F.size(entries)), lambda a, x: F.concat(a, x))


def decode_batch(data: Column) -> Column:
    """The entries of `encode_batch` (an empty value reads as null, so op tells a deletion); null if the
    bytes end early or the number of entries is more than they can hold."""
    n, size = _number(data, F.lit(0)), F.octet_length(data)
    start = F.struct(F.lit(4).cast("long").alias("at"), F.array().cast("array<struct<op:int,k:binary,v:binary>>").alias("out"), F.lit(True).alias("ok"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        keys = _number(data, at + 1)
        values = _number(data, at + 5 + keys)
        end = at + 9 + keys + values
        ok = s["ok"] & (at + 5 <= size) & (at + 9 + keys <= size) & (end <= size)
        value = F.when(values > 0, F.substring(data, (at + 10 + keys).cast("int"), values.cast("int")))
        entry = F.struct(_number(data, at, 1).cast("int").alias("op"), F.substring(data, (at + 6).cast("int"), keys.cast("int")).alias("k"), value.alias("v"))
        out = F.when(ok, F.concat(s["out"], F.array(entry))).otherwise(s["out"])
        return F.struct(F.when(ok, end).otherwise(at).alias("at"), out.alias("out"), F.coalesce(ok, F.lit(False)).alias("ok"))

    possible = (size >= 4) & (n * 9 + 4 <= size)
    numbers = F.when(possible & (n > 0), F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    return F.when(possible, F.aggregate(numbers, start, step, lambda s: F.when(s["ok"], s["out"])))
