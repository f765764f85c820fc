"""Connected components by large and small stars."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliable(spark) -> None:
    """Makes sure that checkpoints go to the folder the session names (spark.checkpoint.dir); one of its
    own only where it names none and runs on this machine alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-ckpt-"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b) over any orderable type: the least node that can be
    reached.

    Every node links its larger neighbours to its least one (large star), then itself and its
    smaller ones (small star), until nothing changes: stars are left.  The rounds are about the
    logarithm of the longest path, however long; minima are combined map-side, so a hub is no
    single task, and each round is checkpointed."""
    reliable(edges.sparkSession)
    given = edges.select("a", "b").where("a is not null and b is not null").checkpoint()
    e = given.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    prints = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    before = e.agg(prints.alias("p")).first()["p"]
    while before["n"]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        e = large.join(low, "a").select(pair.alias("x")).select("x.a", "x.b").where("a != b").distinct().checkpoint()
        now = e.agg(prints.alias("p")).first()["p"]
        if now == before:
            break
        before = now
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
