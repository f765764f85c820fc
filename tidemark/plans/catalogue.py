"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bloom, clock, gc, history, lsm, quorum, txn, versions, wal, ycsb
from tidemark.operators.fold import running
from tidemark.operators.graph import reliable
from tidemark.schema import DELETE, FILES_SQL, PUT, TXN_SQL, V_SQL, files, middle, table, txns
from tidemark.schema import versions as log_of
from tidemark.sources.logs import read_wal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _shared(spark) -> str:
    """The folder that the cluster shares, for what a query writes and reads again."""
    reliable(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def requests(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"))


def tiers(spark, d) -> list[DataFrame]:
    """The log cut by age into three tiers, newest first."""
    log, m = log_of(spark, d), 2 * middle(spark, d)
    a, b = m * 4 // 5, m // 2
    return [log.where(F.col("ts") >= a), log.where((F.col("ts") >= b) & (F.col("ts") < a)), log.where(F.col("ts") < b)]


_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS rn FROM v)"
_TIERS = """ti AS (SELECT v.*, CASE WHEN ts >= (2 * h.t) * 4 // 5 THEN 0 WHEN ts >= (2 * h.t) // 2 THEN 1 ELSE 2 END AS idx FROM v, h),
tr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY idx, ts DESC) AS rn FROM ti)"""

def _reset(rows: str, size: str, limit: int, name: str) -> str:
    """SQL of groups whose sums start again: `rows` has grp, rn and `size`."""
    return f"""g AS (SELECT *, CAST(0 AS BIGINT) AS {name}, CAST({size} AS BIGINT) AS filled FROM {rows} WHERE rn = 1 UNION ALL
SELECT o.*, CASE WHEN filled >= {limit} THEN {name} + 1 ELSE {name} END, CASE WHEN filled >= {limit} THEN o.{size} ELSE filled + o.{size} END FROM g JOIN {rows} o ON o.grp = g.grp AND o.rn = g.rn + 1)"""


# ------------------------------------------------------------------ reads


@query(f"WITH {V_SQL}, {_RANKED} SELECT k, ts, v, x FROM r WHERE rn = 1 AND op = 1")
def latest_view(spark, d):
    return versions.latest_view(log_of(spark, d)).select("k", "ts", "v", "x")


_SNAP = f"WITH {V_SQL}, r AS (SELECT v.*, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS rn FROM v, h WHERE ts <= h.t) SELECT k, ts, v, x FROM r WHERE rn = 1 AND op = 1"


@query(_SNAP)
def snapshot_read(spark, d):
    return versions.snapshot_read(log_of(spark, d), middle(spark, d)).select("k", "ts", "v", "x")


@query(_SNAP)
def export_snapshot(spark, d):
    path = f"{_shared(spark)}/export-{uuid.uuid4().hex}"
    versions.snapshot_read(log_of(spark, d), middle(spark, d)).select("k", "ts", "v", "x").write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {V_SQL}, {_RANKED} SELECT k, ts, v, x FROM r WHERE rn = 1 AND op = 1 AND k = 7")
def point_get(spark, d):
    return versions.point_get(log_of(spark, d), 7).select("k", "ts", "v", "x")


@query(f"""WITH {V_SQL}, {_RANKED} SELECT c_custkey AS k, r.k IS NOT NULL AS found, ts, v
FROM customer LEFT JOIN (SELECT * FROM r WHERE rn = 1 AND op = 1) r ON r.k = c_custkey""")
def multi_get_found(spark, d):
    return versions.multi_get(log_of(spark, d), requests(spark, d)).select("k", "found", "ts", "v")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 ORDER BY 1")
def range_scan(spark, d):
    return versions.range_scan(table(spark, d, "orders"), 100, 200, "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(_SNAP + " AND k >= 10 AND k < 60")
def snapshot_range_scan(spark, d):
    return versions.snapshot_range_scan(log_of(spark, d), 10, 60, middle(spark, d)).select("k", "ts", "v", "x")


@query(f"WITH {V_SQL} SELECT p.k, p.ts - 1 AS \"at\", b.ts, b.op, b.v FROM v p ASOF LEFT JOIN v b ON p.k = b.k AND p.ts - 1 >= b.ts")
def asof_read(spark, d):
    log = log_of(spark, d)
    return versions.asof(log.select("k", (F.col("ts") - 1).alias("at")), log).select("k", "at", "ts", "op", "v")


@query(f"WITH {V_SQL}, keys AS (SELECT DISTINCT k FROM v) SELECT c_custkey AS target, (SELECT min(k) FROM keys WHERE k >= c_custkey) AS k FROM customer")
def seek_lower_bound(spark, d):
    return versions.seek_lower_bound(log_of(spark, d), requests(spark, d)).select("target", "k")


@query(f"WITH {V_SQL} SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT k FROM v)")
def contains_any_version(spark, d):
    return versions.contains_any_version(log_of(spark, d), requests(spark, d))


@query(f"WITH {V_SQL} SELECT k, ts, op, v FROM v ORDER BY k, ts")
def raw_scan_with_tombstones(spark, d):
    return log_of(spark, d).orderBy("k", "ts").select("k", "ts", "op", "v")


@query(f"WITH {V_SQL}, {_RANKED} SELECT k, ts, v FROM r WHERE rn = 1 AND op = 1 ORDER BY k")
def ordered_iteration(spark, d):
    return versions.latest_view(log_of(spark, d)).orderBy("k").select("k", "ts", "v")


@query(f"WITH {V_SQL} SELECT k, ts, lag(ts) OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS newer_ts FROM v")
def version_order(spark, d):
    return versions.version_order(log_of(spark, d)).select("k", "ts", "newer_ts")


@query(f"WITH {V_SQL}, {_RANKED} SELECT k, ts, rn FROM r")
def version_rank(spark, d):
    return versions.version_rank(log_of(spark, d)).select("k", "ts", "rn")


@query(f"WITH {V_SQL}, {_RANKED} SELECT k, ts, op, v FROM r WHERE rn > 1")
def shadowed_versions(spark, d):
    return versions.shadowed(log_of(spark, d)).select("k", "ts", "op", "v")


@query(f"WITH {V_SQL} SELECT k, count(*) AS entries, CAST(sum(32 + length(CAST(k AS VARCHAR)) + length(v)) AS BIGINT) AS bytes FROM v GROUP BY k")
def memtable_size(spark, d):
    size = versions.memory_size(F.col("k").cast("string"), F.col("v"))
    return log_of(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"))


# ------------------------------------------------------------------ merges and writes


@query(f"WITH {V_SQL}, {_TIERS} SELECT k, CAST(idx AS INTEGER) AS idx, ts, op, v FROM tr WHERE rn = 1")
def tiered_merge(spark, d):
    return versions.tiered_merge(tiers(spark, d)).select("k", "idx", "ts", "op", "v")


@query(f"""WITH {V_SQL}, t AS (SELECT k, ts, seq, op, v || '0' AS v, 0 AS idx FROM v, h WHERE ts >= h.t UNION ALL SELECT k, ts, seq, op, v || '1', 1 FROM v, h WHERE ts >= h.t // 2 UNION ALL
SELECT k, ts, seq, op, v || '2', 2 FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY k, ts, seq ORDER BY idx) AS rn FROM t) SELECT k, ts, op, v, CAST(idx AS INTEGER) AS idx FROM r WHERE rn = 1""")
def merge_versions(spark, d):
    log, m = log_of(spark, d), middle(spark, d)
    overlapping = [log.where(F.col("ts") >= m), log.where(F.col("ts") >= m // 2), log]
    named = [t.withColumn("v", F.concat("v", F.lit(str(i)))) for i, t in enumerate(overlapping)]
    return versions.merge_versions(named).select("k", "ts", "op", "v", "idx")


@query(f"""WITH {V_SQL}, {_TIERS} SELECT c_custkey AS k, tr.k IS NOT NULL AS found, CAST(idx AS INTEGER) AS idx, v
FROM customer LEFT JOIN (SELECT * FROM tr WHERE rn = 1 AND op = 1) tr ON tr.k = c_custkey""")
def tiered_get(spark, d):
    return versions.tiered_get(tiers(spark, d), requests(spark, d)).select("k", "found", "idx", "v")


def _changes(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(-1).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(PUT).alias("op"), F.col("o_totalprice").alias("x"))
    change = log_of(spark, d).select((F.col("ts") % 3000).alias("k"), "ts", "seq", "op", "x")
    return base, change


_CHANGES = f"{V_SQL}, b AS (SELECT o_orderkey AS k, CAST(-1 AS BIGINT) AS ts, 1 AS op, o_totalprice AS x FROM orders UNION ALL SELECT ts % 3000, ts, op, x FROM v"


@query(f"WITH {_CHANGES} WHERE op = 1), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS rn FROM b) SELECT k, ts, x FROM r WHERE rn = 1")
def upsert_merge(spark, d):
    base, change = _changes(spark, d)
    return versions.merge_changes(base, change.where(F.col("op") == PUT)).select("k", "ts", "x")


@query(f"WITH {_CHANGES}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS rn FROM b) SELECT k, ts, x FROM r WHERE rn = 1 AND op = 1")
def delete_merge(spark, d):
    return versions.merge_changes(*_changes(spark, d)).select("k", "ts", "x")


def _batches(spark, d):
    entry = F.struct("ts", "op", "k", "v")
    rows = log_of(spark, d).groupBy(F.floor(F.col("ts") / 10).cast("long").alias("b")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select(F.col("b").alias("ts"), F.transform("entries", lambda e: F.struct(e.op.alias("op"), e.k.alias("k"), e.v.alias("v"))).alias("entries"))


@query(f"WITH {V_SQL}, b AS (SELECT k, ts // 10 AS bts, row_number() OVER (PARTITION BY ts // 10 ORDER BY ts) - 1 AS s, op, v FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bts DESC, s DESC) AS rn FROM b) SELECT k, bts AS ts, s AS seq, v FROM r WHERE rn = 1 AND op = 1")
def write_batch(spark, d):
    return versions.latest_view(versions.batch_log(_batches(spark, d))).select("k", "ts", "seq", "v")


@query(f"WITH {V_SQL}, b AS (SELECT k, ts // 10 AS bts, row_number() OVER (PARTITION BY ts // 10 ORDER BY op, ts) - 1 AS s, op, v FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bts DESC, s DESC) AS rn FROM b) SELECT k, bts AS ts, s AS seq, v FROM r WHERE rn = 1 AND op = 1")
def rpc_batch(spark, d):
    return versions.latest_view(versions.batch_log(_batches(spark, d), deletes_last=True)).select("k", "ts", "seq", "v")


@query(f"""WITH {V_SQL}, b AS (SELECT k % 7 AS k, ts // 10 AS bts, row_number() OVER (PARTITION BY ts // 10 ORDER BY ts) - 1 AS s, op, v FROM v)
SELECT k, bts AS ts, min(s) AS seq, arg_max(op, s) AS op, arg_max(v, s) AS v FROM b GROUP BY k, bts""")
def map_batches(spark, d):
    few = F.transform("entries", lambda e: F.struct(e.op.alias("op"), (e.k % 7).alias("k"), e.v.alias("v")))
    return versions.map_batches(_batches(spark, d).withColumn("entries", few)).select("k", "ts", "seq", "op", "v")


def _le(x):
    return f"format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', ({x}) % 256, ({x}) // 256 % 256, ({x}) // 65536 % 256, ({x}) // 16777216)"


@query(f"""WITH {V_SQL}, e AS (SELECT ts // 10 AS b, ts, format('{{:02X}}', op) || {_le("length(CAST(k AS VARCHAR))")} || hex(CAST(k AS VARCHAR)) || {_le("length(v)")} || hex(v) AS x FROM v)
SELECT b AS ts, {_le("count(*)")} || string_agg(x, '' ORDER BY ts) AS encoded, TRUE AS same FROM e GROUP BY b""")
def batch_codec(spark, d):
    entries = F.transform("entries", lambda e: F.struct(e.op.alias("op"), e.k.cast("string").cast("binary").alias("k"), e.v.cast("binary").alias("v")))
    rows = _batches(spark, d).select("ts", entries.alias("entries"), versions.encode_batch(entries).alias("data"))
    return rows.select("ts", F.hex("data").alias("encoded"), (versions.decode_batch(F.col("data")) == F.col("entries")).alias("same"))


@query(f"""WITH RECURSIVE {V_SQL}, b AS (SELECT k AS grp, ts, 32 + length(CAST(k AS VARCHAR)) + length(v) AS bytes, row_number() OVER (PARTITION BY k ORDER BY ts) AS rn FROM v), {_reset("b", "bytes", 1024, "segment")}
SELECT grp AS k, segment, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(ts) AS lo, max(ts) AS hi FROM g GROUP BY ALL""")
def flush_segments(spark, d):
    cut = lsm.segments(log_of(spark, d), versions.memory_size(F.col("k").cast("string"), F.col("v")), 1024)
    return cut.groupBy("k", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


_BLOCKS = f"""b AS (SELECT l_suppkey AS grp, l_orderkey AS k, 34 + length(CAST(l_orderkey AS VARCHAR)) + length(CAST(l_partkey AS VARCHAR)) AS bytes,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS rn FROM lineitem), {_reset("b", "bytes", 4096, "block")},
x AS (SELECT grp AS s, block, min(k) AS first_key, max(k) AS last_key, count(*) AS n FROM g GROUP BY ALL)"""


def _blocks(spark, d):
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), *order)
    size = F.lit(34) + F.length(F.col("l_orderkey").cast("string")) + F.length(F.col("l_partkey").cast("string"))
    return lsm.segments(rows, size, 4096, by="s", order=order).groupBy("s", F.col("segment").alias("block")).agg(F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"), F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_BLOCKS} SELECT s, block, first_key, last_key, n FROM x")
def block_layout(spark, d):
    return _blocks(spark, d)


@query(f"WITH RECURSIVE {_BLOCKS} SELECT s, min(block) AS block FROM x WHERE last_key >= 700 GROUP BY s")
def block_lookup(spark, d):
    return _blocks(spark, d).where("last_key >= 700").groupBy("s").agg(F.min("block").alias("block"))


# ------------------------------------------------------------------ garbage collection


_GC = f"WITH {V_SQL}, o AS (SELECT v.*, sum(CASE WHEN ts < h.t THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts DESC) AS old, ts >= h.t AS young FROM v, h) "


@query(_GC + "SELECT k, ts, op, v FROM o WHERE young OR (old = 1 AND op = 1)")
def mvcc_gc(spark, d):
    return gc.mvcc_gc(log_of(spark, d), middle(spark, d)).select("k", "ts", "op", "v")


@query(_GC + "SELECT k, ts, op, v FROM o WHERE young OR old = 1")
def tombstone_gc(spark, d):
    return gc.mvcc_gc(log_of(spark, d), middle(spark, d), deepest=False).select("k", "ts", "op", "v")


@query(_GC + ", c AS (SELECT *, k // 16 AS block FROM o WHERE young OR (old = 1 AND op = 1)) SELECT k, ts, op, v, block, CAST((row_number() OVER (PARTITION BY block ORDER BY k, ts DESC) - 1) // 200 AS BIGINT) AS part FROM c".replace(", c AS", "SELECT * FROM (WITH c AS") + ") q")
def compact_output(spark, d):
    return gc.compact(log_of(spark, d), middle(spark, d), per_file=200).select("k", "ts", "op", "v", "block", "part")


# ------------------------------------------------------------------ levels, files, manifest


@query(f"WITH {V_SQL} SELECT ts // 1000 AS segment, min(k) AS lo, max(k) AS hi, count(*) AS n, count(*) FILTER (op = 2) AS tombstones FROM v GROUP BY 1")
def segment_stats(spark, d):
    g = log_of(spark, d).groupBy(F.floor(F.col("ts") / 1000).cast("long").alias("segment"))
    return g.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("op") == 2, 1)).alias("tombstones"))


_SCORE = f"{FILES_SQL}, sc AS (SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, round(CASE WHEN level = 0 THEN count(*) / 4.0 ELSE CAST(sum(size) AS DOUBLE) / (10485760.0 * pow(10.0, level - 1)) END, 6) AS score FROM f GROUP BY level)"


@query(f"WITH {_SCORE} SELECT level, files, bytes, CAST(score AS DOUBLE) AS score FROM sc")
def compaction_score(spark, d):
    return lsm.compaction_score(files(spark, d))


@query(f"""WITH {_SCORE}, p AS (SELECT level AS pick FROM sc WHERE score > 1 AND level < 6 ORDER BY score DESC, level LIMIT 1),
big AS (SELECT file_num FROM f, p WHERE level = pick ORDER BY size DESC, file_num LIMIT 1),
c AS (SELECT f.* FROM f, p WHERE level = pick AND (pick = 0 OR file_num IN (SELECT file_num FROM big))),
s AS (SELECT min(lo) AS a, max(hi) AS b FROM c)
SELECT level, file_num, 'input' AS role FROM c UNION ALL
SELECT f.level, f.file_num, 'overlap' FROM f, p, s WHERE f.level = pick + 1 AND hi >= a AND lo <= b""")
def compaction_pick(spark, d):
    return lsm.compaction_pick(files(spark, d)).select("level", "file_num", "role")


@query(f"""WITH RECURSIVE {FILES_SQL}, b AS (SELECT level AS grp, file_num, size, row_number() OVER (PARTITION BY level ORDER BY lo, file_num) AS rn FROM f), {_reset("b", "size", 500_000, "out_file")}
SELECT grp AS level, file_num, out_file FROM g""")
def compaction_split(spark, d):
    return lsm.compaction_split(files(spark, d), 500_000).select("level", "file_num", "out_file")


@query(f"""WITH {FILES_SQL}, e AS (SELECT 1 AS edit_no, 'add' AS action, * FROM f UNION ALL SELECT 2, 'delete', * FROM f WHERE file_num % 5 = 0 UNION ALL SELECT 3, 'add', * REPLACE (size + 1 AS size) FROM f WHERE file_num % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY level, file_num ORDER BY edit_no DESC) AS rn FROM e) SELECT level, file_num, lo, hi, n, size FROM r WHERE rn = 1 AND action = 'add' ORDER BY level, lo, file_num""")
def manifest_state(spark, d):
    every = files(spark, d)
    cut, back = every.where("file_num % 5 = 0"), every.where("file_num % 10 = 0").withColumn("size", F.col("size") + 1)
    edits = [x.select(F.lit(i).alias("edit_no"), F.lit(a).alias("action"), "*") for i, a, x in ((1, "add", every), (2, "delete", cut), (3, "add", back))]
    return lsm.manifest_state(reduce(DataFrame.unionByName, edits)).select("level", "file_num", "lo", "hi", "n", "size")


@query(f"WITH {FILES_SQL} SELECT a.file_num, count(*) AS overlaps FROM f a JOIN f b ON a.level = 0 AND b.level = 1 AND a.hi >= b.lo AND a.lo <= b.hi GROUP BY 1")
def file_overlap(spark, d):
    every = files(spark, d)
    return lsm.overlap_counts(every.where("level = 0"), every.where("level = 1"))


@query(f"WITH {FILES_SQL} SELECT o_orderkey AS k, level, count(*) AS files FROM orders JOIN f ON o_orderkey BETWEEN lo AND hi GROUP BY 1, 2")
def level_probe(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return lsm.level_counts(keys, files(spark, d))


@query(f"""WITH {FILES_SQL}, rows AS (SELECT l_orderkey AS k, l_suppkey % 7 AS level, l_suppkey * 10 + l_linenumber AS file_num, CASE WHEN min(l_quantity) < 5 THEN 2 ELSE 1 END AS op, min(l_partkey) AS v FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, CASE WHEN level = 0 THEN -file_num ELSE file_num END) AS rn FROM rows)
SELECT o_orderkey AS k, r.k IS NOT NULL AS found, level, file_num, v FROM orders LEFT JOIN (SELECT * FROM r WHERE rn = 1 AND op = 1) r ON r.k = o_orderkey""")
def level_get(spark, d):
    at = [F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 7).alias("level"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("file_num")]
    dealt = table(spark, d, "lineitem").select(*at, "l_quantity", "l_partkey").repartition("level", "file_num")  # for rows and bounds alike
    rows = dealt.groupBy("k", "level", "file_num").agg(F.when(F.min("l_quantity") < 5, 2).otherwise(1).alias("op"), F.min("l_partkey").alias("v"))
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return lsm.level_get(keys, rows, files(spark, d)).select("k", "found", "level", "file_num", "v")


@query(f"WITH {FILES_SQL} SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM f GROUP BY level")
def compaction_stats(spark, d):
    return files(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'begin' WHEN 'view' THEN 'done' WHEN 'error' THEN 'stall' ELSE 'other' END AS kind, event_id AS i FROM events)
SELECT CAST(coalesce(sum(i) FILTER (kind = 'done'), 0) AS BIGINT) AS bytes_compacted, CAST(coalesce(sum(i // 2) FILTER (kind = 'done'), 0) AS BIGINT) AS bytes_written, count(*) FILTER (kind = 'done') AS compactions,
CAST(coalesce(sum(i % 97) FILTER (kind = 'done'), 0) AS BIGINT) AS compaction_ms, CAST(coalesce(sum(i % 97) FILTER (kind = 'stall'), 0) AS BIGINT) AS stall_ms, count(*) FILTER (kind = 'begin') - count(*) FILTER (kind = 'done') AS pending FROM e""")
def compaction_counters(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "click", "begin").when(t == "view", "done").when(t == "error", "stall").otherwise("other")
    return lsm.compaction_stats(table(spark, d, "events").select(kind.alias("kind"), i.alias("bytes_in"), F.expr("event_id div 2").alias("bytes_out"), (i % 97).alias("ms")))


@query(f"WITH {FILES_SQL} SELECT CAST(round(CAST(sum(size) AS DOUBLE) / sum(size) FILTER (level = 0), 6) AS DOUBLE) AS amplification FROM f")
def write_amplification(spark, d):
    return files(spark, d).agg(F.round(F.sum("size") / F.sum(F.when(F.col("level") == 0, F.col("size"))), 6).alias("amplification"))


@query(f"WITH {V_SQL}, s AS (SELECT k, ts, CAST(sum(CASE WHEN op = 2 THEN -2 ELSE 1 END) OVER (PARTITION BY k ORDER BY ts) AS BIGINT) AS l0 FROM v) SELECT k, ts, l0, l0 >= 12 AS stalled FROM s")
def write_stall_flags(spark, d):
    return lsm.stall_flags(log_of(spark, d).select("k", "ts", F.when(F.col("op") == 2, -2).otherwise(1).alias("delta"))).select("k", "ts", "l0", "stalled")


_ORD = "o AS (SELECT k, ts, x, row_number() OVER (PARTITION BY k ORDER BY ts) AS rn FROM v)"


@query(f"""WITH RECURSIVE {V_SQL}, {_ORD}, s AS (
SELECT k, ts, rn, 60 >= CAST(floor(x) AS BIGINT) AS granted, CASE WHEN 60 >= CAST(floor(x) AS BIGINT) THEN 60 - CAST(floor(x) AS BIGINT) ELSE 60 END AS tokens FROM o WHERE rn = 1
UNION ALL SELECT o.k, o.ts, o.rn, least(60, tokens + (o.ts - s.ts) // 50) >= CAST(floor(x) AS BIGINT),
CASE WHEN least(60, tokens + (o.ts - s.ts) // 50) >= CAST(floor(x) AS BIGINT) THEN least(60, tokens + (o.ts - s.ts) // 50) - CAST(floor(x) AS BIGINT) ELSE least(60, tokens + (o.ts - s.ts) // 50) END
FROM s JOIN o ON o.k = s.k AND o.rn = s.rn + 1) SELECT k, ts, granted FROM s""".replace("(o.ts - s.ts) // 50", "(o.ts - s.ts)"))
def rate_limit_sim(spark, d):
    return wal.token_bucket(log_of(spark, d).select("k", "ts", F.floor("x").alias("cost")), 60, 1)


# ------------------------------------------------------------------ transactions


_OUT = f"""WITH RECURSIVE {TXN_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY req, txn) AS rn FROM t),
s AS (SELECT txn, k, req, rn, TRUE AS committed, req AS last FROM o WHERE rn = 1 UNION ALL
SELECT o.txn, o.k, o.req, o.rn, s.last <= o.snap, CASE WHEN s.last <= o.snap THEN o.req ELSE s.last END FROM s JOIN o ON o.k = s.k AND o.rn = s.rn + 1)"""


@query(_OUT + " SELECT txn, k, committed FROM s")
def commit_outcomes(spark, d):
    return txn.commit_outcomes(txns(spark, d))


@query(f"WITH {TXN_SQL} SELECT a.txn, a.k, count(b.txn) AS n_conflicts FROM t a LEFT JOIN t b ON a.k = b.k AND b.req > a.snap AND b.req < a.req GROUP BY 1, 2")
def conflict_pairs(spark, d):
    return txn.conflicts(txns(spark, d)).select("txn", "k", "n_conflicts")


@query(_OUT + " SELECT k, max(req) AS commit_ts FROM s WHERE committed GROUP BY k")
def latest_commits(spark, d):
    return txn.latest_commits(txns(spark, d))


@query(f"""WITH RECURSIVE {TXN_SQL}, o AS (SELECT t.*, event_type = 'error' AS aborted, row_number() OVER (PARTITION BY k ORDER BY req, txn) AS rn FROM t JOIN events ON event_id = txn),
s AS (SELECT txn, k, req, rn, NOT aborted AS committed, CASE WHEN aborted THEN -1 ELSE req END AS last FROM o WHERE rn = 1 UNION ALL
SELECT o.txn, o.k, o.req, o.rn, NOT aborted AND s.last <= o.snap, CASE WHEN NOT aborted AND s.last <= o.snap THEN o.req ELSE s.last END FROM s JOIN o ON o.k = s.k AND o.rn = s.rn + 1)
SELECT txn, k, committed FROM s""")
def txn_aborts(spark, d):
    ended = table(spark, d, "events").select(F.col("event_id").alias("txn"), (F.col("event_type") == "error").alias("aborted"))
    return txn.commit_outcomes(txns(spark, d).join(ended, "txn"))


@query(_OUT + """, c AS (SELECT k, max(req) AS commit_ts FROM s WHERE committed GROUP BY k), w AS (SELECT DISTINCT txn, unnest([k, (k // 10) * 10 + txn % 10]) AS k, snap FROM t)
SELECT txn, k, commit_ts FROM w JOIN c USING (k) WHERE commit_ts > snap""")
def write_conflicts(spark, d):
    sets = txns(spark, d).withColumn("keys", F.array("k", F.expr("(k div 10) * 10 + txn % 10")))
    return txn.write_conflicts(sets, txn.latest_commits(txns(spark, d)))


@query(_OUT + """, w AS (SELECT s.k, s.req AS ts, s.txn AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, event_type AS v FROM s JOIN events ON event_id = s.txn WHERE committed),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS rn FROM w) SELECT k, ts, v FROM r WHERE rn = 1 AND op = 1""")
def committed_writes(spark, d):
    log = log_of(spark, d).select(F.col("ts").alias("txn"), "op", "v")
    return versions.latest_view(txn.committed_writes(txns(spark, d).join(log, "txn"))).select("k", "ts", "v")


@query(f"""WITH {TXN_SQL}, p AS (SELECT snap AS "at", 1 AS d FROM t UNION ALL SELECT req, -1 FROM t), c AS (SELECT "at", sum(d) AS d FROM p GROUP BY 1)
SELECT "at", CAST(sum(d) OVER (ORDER BY "at") AS BIGINT) AS active FROM c""")
def active_transactions(spark, d):
    return txn.active_transactions(txns(spark, d))


@query()
def multi_key_outcomes(spark, d):
    """Two keys of a group of ten each; the outcome of a transaction depends on all before, so SQL has none."""
    other = F.expr("(user_id div 10) * 10 + event_id % 10")
    keys = table(spark, d, "events").select(F.col("event_id").alias("txn"), F.array("user_id", other).alias("keys"))
    return txn.multi_key_outcomes(txns(spark, d).join(keys, "txn"))


@query("SELECT least(coalesce(min(event_id * 1000) FILTER (event_type = 'click'), 500000), 500000) AS horizon FROM events".replace("500000", "CAST(500000 AS BIGINT)"))
def min_active_snapshot(spark, d):
    active = table(spark, d, "events").where("event_type = 'click'").select((F.col("event_id") * 1000).alias("snap"))
    return txn.min_active_snapshot(active, 500_000).select(F.col("horizon").cast("long").alias("horizon"))


# ------------------------------------------------------------------ clocks and keys


def _ticks(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


_HLC = """e AS (SELECT user_id % 5 AS node, event_id AS id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events),
c AS (SELECT node, id, max((ms << 16) - n) OVER (PARTITION BY node ORDER BY id) + n AS hlc FROM e)"""


@query(f"WITH {_HLC} SELECT node, id, CAST(hlc AS BIGINT) AS hlc FROM c")
def hlc_now(spark, d):
    return clock.hlc_now(_ticks(spark, d)).select("node", "id", "hlc")


@query(f"WITH {_HLC} SELECT id, CAST(hlc >> 16 AS BIGINT) AS wall, CAST(hlc & 65535 AS BIGINT) AS logical FROM c")
def hlc_unpack(spark, d):
    return clock.hlc_now(_ticks(spark, d)).select("id", clock.wall_of(F.col("hlc")).alias("wall"), clock.logical_of(F.col("hlc")).alias("logical"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS node, event_id AS id, event_id // 3 AS ms, (event_id + 5) // 4 + event_id // 12 AS rw, event_id % 7 AS rl,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
s AS (SELECT node, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS l FROM e WHERE rn = 1 UNION ALL
SELECT s.node, e.rn, greatest(w, rw, ms), CASE WHEN greatest(w, rw, ms) = w AND greatest(w, rw, ms) = rw THEN greatest(l, rl) + 1 WHEN greatest(w, rw, ms) = w THEN l + 1 WHEN greatest(w, rw, ms) = rw THEN rl + 1 ELSE 0 END
FROM s JOIN e ON e.node = s.node AND e.rn = s.rn + 1)
SELECT node, w AS wall, l AS logical FROM s QUALIFY row_number() OVER (PARTITION BY node ORDER BY rn DESC) = 1""")
def hlc_merge(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("node"), i.alias("id"), F.floor(i / 3).alias("ms"), (F.floor((i + 5) / 4) + F.floor(i / 12)).alias("remote_wall"), (i % 7).alias("remote_logical"))
    return clock.hlc_merge(rows)


@query("SELECT event_id, hex(CAST(user_id AS VARCHAR)) || printf('%016X', CAST(-1 - event_id AS BIGINT)) AS encoded, CAST(user_id AS VARCHAR) AS key, event_id AS ts FROM events".replace("printf('%016X', CAST(-1 - event_id AS BIGINT))", "upper(to_hex(CAST(-1 - event_id AS BIGINT)))"))
def mvcc_key_codec(spark, d):
    rows = table(spark, d, "events").select("event_id", clock.encode_key(F.col("user_id").cast("string").cast("binary"), F.col("event_id")).alias("e"))
    back = clock.decode_key(F.col("e"))
    return rows.select("event_id", F.hex("e").alias("encoded"), back["key"].cast("string").alias("key"), back["ts"].alias("ts"))


# ------------------------------------------------------------------ Bloom filters


def _bits(key: str, m: str) -> str:
    """SQL of bit `i` of a key: two halves of a digest, hashed twice in 32 bits."""
    half = "('0x' || substr(md5(CAST({0} AS VARCHAR)), {1}, 8))::BIGINT"
    return f"(({half.format(key, 1)} + i * {half.format(key, 9)}) & 4294967295) % {m}"


_M = "CAST((greatest(64, count(DISTINCT user_id) * 10) + 7) // 8 * 8 AS BIGINT)"
_PROBE = f"""size AS (SELECT {_M} AS m FROM events), bits AS (SELECT DISTINCT {_bits('user_id', 'm')} AS bit FROM events, size, range(0, 6) r(i)),
p AS (SELECT c_custkey AS k, bool_and({_bits('c_custkey', 'm')} IN (SELECT bit FROM bits)) AS maybe FROM customer, size, range(0, 6) r(i) GROUP BY 1)"""


@query(f"SELECT event_type, count(DISTINCT user_id) AS n, {_M} AS bits, 6 AS hashes FROM events GROUP BY 1")
def bloom_sizing(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    bits, k = bloom.sizing(F.col("n"))
    return n.select("event_type", "n", bits.alias("bits"), F.lit(k).alias("hashes"))


@query(f"WITH s AS (SELECT event_type, {_M} AS m FROM events GROUP BY 1) SELECT event_type, m, count(DISTINCT {_bits('user_id', 'm')}) AS set_bits FROM events JOIN s USING (event_type), range(0, 6) r(i) GROUP BY 1, 2")
def bloom_bits(spark, d):
    return bloom.set_bits(bloom.build(table(spark, d, "events"), ["event_type"], "user_id"), ["event_type"])


def _filter(spark, d):
    return bloom.build(table(spark, d, "events"), [], "user_id")


@query(f"WITH {_PROBE} SELECT k, maybe FROM p")
def bloom_probe(spark, d):
    return bloom.probe(requests(spark, d), "k", _filter(spark, d))


@query(f"WITH {_PROBE} SELECT k, maybe FROM p")
def bloom_codec(spark, d):
    data = bloom.encode(_filter(spark, d))
    return requests(spark, d).distinct().select("k", bloom.may_contain(F.lit(data), F.col("k")).alias("maybe"))


@query(f"WITH {_PROBE} SELECT count(*) AS probes, count(*) FILTER (maybe) AS false_hits FROM p WHERE k NOT IN (SELECT user_id FROM events)")
def bloom_fpr(spark, d):
    absent = requests(spark, d).join(table(spark, d, "events").select(F.col("user_id").alias("k")), "k", "left_anti")
    return bloom.probe(absent, "k", _filter(spark, d)).agg(F.count(F.lit(1)).alias("probes"), F.count(F.when(F.col("maybe"), 1)).alias("false_hits"))


# ------------------------------------------------------------------ logs


@query(f"WITH {V_SQL}, b AS (SELECT *, sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts) AS bad FROM v) SELECT k, ts, v, x FROM b WHERE bad = 0")
def wal_replay(spark, d):
    return wal.replay(log_of(spark, d), F.col("op") == 2).select("k", "ts", "v", "x")


@query(f"""WITH RECURSIVE {V_SQL}, {_ORD}, s AS (SELECT k, ts, rn, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, ts AS first FROM o WHERE rn = 1 UNION ALL
SELECT o.k, o.ts, o.rn, CASE WHEN n >= 4 OR o.ts - first >= 300 THEN batch + 1 ELSE batch END, CASE WHEN n >= 4 OR o.ts - first >= 300 THEN 1 ELSE n + 1 END, CASE WHEN n >= 4 OR o.ts - first >= 300 THEN o.ts ELSE first END
FROM s JOIN o ON o.k = s.k AND o.rn = s.rn + 1) SELECT k, ts, batch FROM s""")
def group_commit_batches(spark, d):
    return wal.group_commit(log_of(spark, d).select("k", "ts", F.col("ts").alias("at")), 4, 300)


@query(f"""WITH RECURSIVE {V_SQL}, o AS (SELECT k, ts, ts % 90 * 1000 AS bytes, row_number() OVER (PARTITION BY k ORDER BY ts) AS rn FROM v),
s AS (SELECT k, CAST(NULL AS BIGINT) AS ts, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS piece, CAST(0 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS skip, CAST(0 AS BIGINT) AS "end" FROM o WHERE rn = 1
UNION ALL SELECT k, ts, rn, piece, rest - least(rest, 32761 - begun), bytes, block, begun, least(rest, 32761 - begun), skip, begun + 7 + least(rest, 32761 - begun) FROM (
  SELECT o.k, o.ts, o.rn, o.bytes, CASE WHEN s.rest = 0 THEN 0 ELSE s.piece + 1 END AS piece, CASE WHEN s.rest = 0 THEN o.bytes ELSE s.rest END AS rest,
  CASE WHEN 32768 - s."end" < 7 THEN s.block + 1 ELSE s.block END AS block, CASE WHEN 32768 - s."end" < 7 THEN 0 ELSE s."end" END AS begun, CASE WHEN 32768 - s."end" < 7 THEN 32768 - s."end" ELSE 0 END AS skip
  FROM s JOIN o ON o.k = s.k AND o.rn = s.rn + CASE WHEN s.rest = 0 THEN 1 ELSE 0 END))
SELECT k, ts, piece, CASE WHEN piece = 0 AND rest = 0 THEN 1 WHEN piece = 0 THEN 2 WHEN rest = 0 THEN 4 ELSE 3 END AS kind, block, start AS "offset", length, skip FROM s WHERE piece >= 0""")
def wal_fragments(spark, d):
    return wal.fragments(log_of(spark, d).select("k", "ts", (F.col("ts") % 90 * 1000).alias("bytes")))


@query(f"""WITH {V_SQL}, b AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY ts) AS record, md5(repeat(v || ts, CAST(ts % 400 AS INTEGER))) AS payload, sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts) AS bad FROM v)
SELECT k, record, payload FROM b WHERE bad = 0""")
def wal_reassemble(spark, d):
    log = log_of(spark, d)
    records = log.select("k", "ts", F.repeat(F.concat("v", F.col("ts").cast("string")), (F.col("ts") % 400).cast("int")).cast("binary").alias("payload"), "op")
    longest = records.groupBy("k").agg(F.sum(wal.most_pieces(F.octet_length("payload"))).alias("n")).agg(F.max("n")).first()[0] or 0
    written = wal.cut_payloads(records)
    hit = (F.col("op") == DELETE) & F.col("kind").isin(wal.FULL, wal.FIRST)  # the first piece of a broken record
    read = wal.reassemble(written.select("k", "pos", "kind", "payload", F.col("crc").bitwiseXOR(hit.cast("long")).alias("crc")), longest=longest)
    order = Window.partitionBy("k").orderBy("pos")
    return read.select("k", "pos", F.md5("payload").alias("payload")).select("k", F.row_number().over(order).cast("long").alias("record"), "payload")


@query("SELECT event_id, event_type <> 'error' AS ok FROM events")
def checksum_verify(spark, d):
    """Records are written with their checksum, some damaged after it was taken, and read back."""
    path = f"{_shared(spark)}/wal-{uuid.uuid4().hex}"
    damaged = F.when(F.col("event_type") == "error", F.overlay("props", F.lit("#"), F.lit(2), F.lit(1))).otherwise(F.col("props"))
    taken = table(spark, d, "events").select(F.col("event_id").alias("lsn"), wal.crc32c(F.col("props").cast("binary")).alias("checksum"), damaged.alias("payload"))
    taken.write.json(path)
    return read_wal(spark, path).select(F.col("lsn").alias("event_id"), "ok")


# ------------------------------------------------------------------ replication


def _matched(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("term"), (F.col("user_id") % 5).alias("peer")).agg(F.max("event_id").alias("idx"))


_COMMIT = """m AS (SELECT event_type AS term, user_id % 5 AS peer, max(event_id) AS idx FROM events GROUP BY 1, 2),
ci AS (SELECT term, idx AS commit_index FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY idx DESC, peer) AS rn FROM m) WHERE rn = 3)"""


@query(f"WITH {_COMMIT} SELECT term, commit_index FROM ci")
def commit_index(spark, d):
    entries = table(spark, d, "events").select(F.col("event_type").alias("term"), F.col("event_id").alias("idx"))
    return quorum.commit_index(_matched(spark, d), entries, 5)


@query(f"WITH {_COMMIT} SELECT term, count(*) AS applied, max(event_id) AS last FROM events JOIN ci ON event_type = term AND event_id <= commit_index GROUP BY 1")
def apply_committed(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("term"), "event_id").join(commit_index(spark, d), "term")
    return rows.where("event_id <= commit_index").groupBy("term").agg(F.count(F.lit(1)).alias("applied"), F.max("event_id").alias("last"))


def _votes(spark, d):
    e = table(spark, d, "events")
    asked = e.select(F.col("event_type").alias("term"), (F.col("user_id") % 5).alias("peer"), (F.col("user_id") % 3).alias("candidate"), F.col("event_id").alias("at"), (F.col("event_id") % 4).alias("last_term"), F.col("event_id").alias("last_idx"))
    voters = e.select((F.col("user_id") % 5).alias("peer")).distinct().withColumn("own_term", F.lit(1).cast("long")).withColumn("own_idx", F.col("peer") * 3)
    return quorum.vote_grants(asked, voters)


_VOTES = """g AS (SELECT event_type AS term, user_id % 5 AS peer, user_id % 3 AS candidate, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id) AS rn
FROM events WHERE event_id % 4 > 1 OR (event_id % 4 = 1 AND event_id >= (user_id % 5) * 3)), vg AS (SELECT term, peer, candidate FROM g WHERE rn = 1)"""


@query(f"WITH {_VOTES} SELECT term, peer, candidate FROM vg")
def vote_grants(spark, d):
    return _votes(spark, d)


@query(f"WITH {_VOTES} SELECT term, candidate, count(*) AS votes, count(*) >= 3 AS elected FROM vg GROUP BY 1, 2")
def election_result(spark, d):
    return quorum.election_result(_votes(spark, d), 5)


@query("""WITH a AS (SELECT user_id % 3 AS node, event_id AS "at", event_id * 7 % 1000 AS idx FROM events),
c AS (SELECT *, min(idx) OVER (PARTITION BY node ORDER BY "at" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM a) SELECT node, "at", idx FROM c WHERE cut IS NULL OR idx < cut""")
def log_truncate_append(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 3).alias("node"), F.col("event_id").alias("at"), (F.col("event_id") * 7 % 1000).alias("idx"))
    return quorum.truncate_append(rows)


_APPEND = """l AS (SELECT user_id % 97 AS node, row_number() OVER (PARTITION BY user_id % 97 ORDER BY event_id) AS idx FROM events), lt AS (SELECT *, 1 + idx // 20 AS term FROM l),
e AS (SELECT node, max(idx) AS "end", max(term) AS top FROM lt GROUP BY 1),
q AS (SELECT *, top + CASE WHEN node % 4 = 0 THEN -1 ELSE 1 END AS term, greatest("end" - node % 5, 0) AS prev, "end" // 2 AS committed, "end" + node % 3 - 1 AS leader FROM e),
a AS (SELECT *, term >= top AND (prev = 0 OR (SELECT lt.term FROM lt WHERE lt.node = q.node AND lt.idx = prev) = 1 + prev // 20 + CASE WHEN node % 7 = 0 THEN 1 ELSE 0 END) AS ok FROM q)"""


@query(f"""WITH {_APPEND} SELECT node, greatest(term, top) AS term, ok AS success, CASE WHEN ok AND leader > committed THEN least(leader, prev + 2) ELSE committed END AS "commit", CASE WHEN ok THEN prev + 2 ELSE "end" END AS "end" FROM a""")
def append_entries(spark, d):
    node = (F.col("user_id") % 97).alias("node")
    log = table(spark, d, "events").select(node, "event_id").withColumn("one", F.lit(1).cast("long"))
    log = running(log, ["node"], ["event_id"], F.col("one"), "sum", F.col("event_id"), "idx").select("node", "idx", F.expr("1 + idx div 20").alias("term"), F.col("event_id").cast("string").alias("data"))
    ends = log.groupBy("node").agg(F.max("idx").alias("end"), F.max("term").alias("top"))
    state = ends.select("node", F.col("top").alias("term"), F.expr("end div 2").alias("commit"))
    prev = ends.withColumn("prev_idx", F.greatest(F.col("end") - F.col("node") % 5, F.lit(0).cast("long")))
    entry = F.struct((F.col("top") + 1).alias("term"), F.lit("new").alias("data"))
    asked = prev.select(
        "node",
        (F.col("top") + F.when(F.col("node") % 4 == 0, -1).otherwise(1)).alias("term"),
        "prev_idx",
        F.expr("if(prev_idx = 0, 0, 1 + prev_idx div 20 + if(node % 7 = 0, 1, 0))").alias("prev_term"),
        (F.col("end") + F.col("node") % 3 - 1).alias("leader_commit"),
        F.array(entry, entry).alias("entries"),
    )
    answers, after = quorum.append_entries(log, state, asked)
    return answers.join(after.groupBy("node").agg(F.max("idx").alias("end")), "node").select("node", "term", "success", "commit", "end")


# ------------------------------------------------------------------ histories and workloads


@query("""WITH e AS (SELECT user_id AS k, event_id AS ts, event_type = 'error' AS is_read, event_id % 4 AS value FROM events),
w AS (SELECT *, last_value(CASE WHEN NOT is_read THEN value END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM e)
SELECT k, ts, value, expected FROM w WHERE is_read AND value IS DISTINCT FROM expected""")
def register_violations(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("ts"), (F.col("event_type") == "error").alias("is_read"), (F.col("event_id") % 4).alias("value"))
    return history.register_violations(e).select("k", "ts", "value", "expected")


@query()
def linearizable(spark, d):
    """Histories of six operations of three clients each, overlapping; the search has no SQL."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select(
        F.expr("event_id div 6").alias("k"), (i % 3).cast("int").alias("client"), (F.col("user_id") % 2 == 0).alias("is_read"), (F.col("user_id") % 3).cast("string").alias("value"), (i * 10).alias("call"), (i * 10 + 5 + F.col("user_id") % 20).alias("ret")
    )
    return history.linearizable(rows)


@query("SELECT c_custkey, 'user' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS key FROM customer")
def ycsb_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", ycsb.key(F.col("c_custkey")).alias("key"))


@query("""WITH w(workload, reads, other) AS (VALUES ('A', 50, 'update'), ('B', 95, 'update'), ('C', 100, 'update'), ('D', 95, 'insert'), ('F', 50, 'rmw'))
SELECT workload, CASE WHEN event_id * 31 % 100 < reads THEN 'read' ELSE other END AS operation, count(*) AS n FROM events, w GROUP BY 1, 2""")
def ycsb_mix(spark, d):
    draw = F.col("event_id") * 31 % 100
    each = F.array(*[F.struct(F.lit(w).alias("workload"), ycsb.operation(draw, w).alias("operation")) for w in ycsb.MIXES])
    return table(spark, d, "events").select(F.explode(each).alias("e")).groupBy("e.workload", "e.operation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, upper(lpad(to_hex(255 - ascii(event_type)), 2, '0')) || hex(substr(event_type, 2)) AS flipped FROM events")
def ycsb_rmw(spark, d):
    return table(spark, d, "events").select("event_id", ycsb.flip_first(F.col("event_type")).alias("flipped"))


@query("SELECT event_id, CAST(xor(user_id, event_id * 2654435761) & 3 AS BIGINT) AS shard FROM events")
def cache_shard(spark, d):
    return table(spark, d, "events").select("event_id", lsm.cache_shard(F.col("user_id"), F.col("event_id")).alias("shard"))


@query("""WITH a AS (SELECT user_id % 4 AS shard, user_id AS k, event_id AS ts FROM events),
p AS (SELECT *, lag(ts) OVER (PARTITION BY shard, k ORDER BY ts) AS before FROM a),
c AS (SELECT p.shard, p.k, p.ts, p.before, count(DISTINCT b.k) AS others FROM p LEFT JOIN a b ON b.shard = p.shard AND b.ts > p.before AND b.ts < p.ts GROUP BY ALL)
SELECT shard, k, ts, before IS NOT NULL AND others < 16 AS hit FROM c""")
def lru_simulation(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("shard"), F.col("user_id").alias("k"), F.col("event_id").alias("ts"))
    return lsm.lru_hits(rows, 16)


@query("""WITH a AS (SELECT user_id % 8 AS shard, user_id % 5 AS file, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS k, event_id AS ts FROM events),
b AS (SELECT *, max(CASE WHEN k IS NULL THEN ts END) OVER (PARTITION BY shard, file ORDER BY ts) AS removed, lag(ts) OVER (PARTITION BY shard, file, k ORDER BY ts) AS before FROM a)
SELECT shard, file, k, ts, CASE WHEN k IS NOT NULL THEN before IS NOT NULL AND before > coalesce(removed, -1) END AS hit FROM b""")
def cache_remove_file(spark, d):
    """No block is evicted here, so only removals of files tell hits from misses."""
    k = F.when(F.col("event_type") != "error", F.col("user_id"))
    rows = table(spark, d, "events").select((F.col("user_id") % 8).alias("shard"), (F.col("user_id") % 5).alias("file"), k.alias("k"), F.col("event_id").alias("ts"))
    return lsm.lru_hits(rows, 1 << 40).select("shard", "file", "k", "ts", "hit")
