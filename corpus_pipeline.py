"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
stages but the last return the columns of `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, simhash, substrings, toxicity
from tidemark.llm.common import prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.  The model learns from the labels of `documents`."""
    prepare(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    prepare(spark)
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by repeated windows go; every document stays."""
    prepare(spark)
    done = substrings.dedup(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("doc.text"))
    others = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    out = done.select(*others, text.alias("__tm_text"), changed.alias("__tm_changed"))
    return out.select(
        *[
            F.col("__tm_text").alias(c) if c == "text" else F.when(F.col("__tm_changed"), F.length("__tm_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenizer, trained model, XXH64 and alignment have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; what each returns is written as Parquet to the shared
    checkpoint folder and read again.  A stage's output goes once the next one's is written."""
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
