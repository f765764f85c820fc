"""Scalar functions for SQL: registered under short names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.operators.wal import crc32c

#: name -> SQL body; temporary SQL functions stay inside Catalyst, no Python runs.
SCALARS = {
    "hlc_wall": "(h BIGINT) RETURNS BIGINT RETURN shiftrightunsigned(h, 16)",
    "hlc_logical": "(h BIGINT) RETURNS BIGINT RETURN h & 65535",
    "cache_shard": "(f BIGINT, o BIGINT) RETURNS BIGINT RETURN (f ^ o) & 3",
    "ycsb_key": "(i BIGINT) RETURNS STRING RETURN concat('user', lpad(cast(i AS STRING), 12, '0'))",
}


def register(spark: SparkSession) -> None:
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("crc32c", crc32c)  # Arrow batches: Spark has no CRC-32C
