"""Canonical versioned schema and the inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = 1, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as versions (k, ts, seq, op, v, x); `error` events are tombstones."""
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), F.col("event_id").alias("ts"), F.lit(0).cast("long").alias("seq"), op.alias("op"), F.col("event_type").alias("v"), F.col("value").alias("x")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted files (level, file_num, lo, hi, n, size) from line items."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber")
    return grouped.agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.count(F.lit(1)).alias("n")).select(
        (F.col("l_suppkey") % 7).alias("level"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("file_num"), "lo", "hi", "n", (F.col("n") * 1000).alias("size")
    )


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-key transactions (txn, k, snap, req)."""
    req = F.col("event_id") * 1000 + 1 + F.floor("value") * 20000
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("txn"), F.col("user_id").alias("k"), (F.col("event_id") * 1000).alias("snap"), req.alias("req"))


def middle(spark: SparkSession, sf_dir: str) -> int:
    """Half of the newest timestamp: the snapshot and GC horizon of the catalogue."""
    return int(table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 2


#: The same inputs for the SQL oracle.
V_SQL = """v AS (SELECT user_id AS k, event_id AS ts, CAST(0 AS BIGINT) AS seq,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, event_type AS v, value AS x FROM events),
h AS (SELECT max(event_id) // 2 AS t, max(event_id) AS m FROM events)"""
FILES_SQL = """f AS (SELECT l_suppkey % 7 AS level, l_suppkey * 10 + l_linenumber AS file_num, min(l_orderkey) AS lo,
  max(l_orderkey) AS hi, count(*) AS n, count(*) * 1000 AS size FROM lineitem GROUP BY l_suppkey, l_linenumber)"""
TXN_SQL = """t AS (SELECT event_id AS txn, user_id AS k, event_id * 1000 AS snap,
  event_id * 1000 + 1 + CAST(floor(value) AS BIGINT) * 20000 AS req FROM events)"""
