"""Replayed workloads against a dictionary."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ycsb
from tidemark.schema import PUT
from tidemark.table import VersionedTable


@pytest.mark.parametrize("workload", sorted(ycsb.MIXES))
def test_replay(spark, workload):
    ops = ycsb.generate(spark, 3000, 50, workload, 24)
    state = {r["k"]: r["loaded"] for r in ycsb.load(spark, 40, 24).collect()}
    got = {r["id"]: r["seen"] for r in ycsb.replay(ycsb.load(spark, 40, 24), ops, writes=workload != "C", chunk=400).collect()}
    reads = 0
    for r in sorted(ops.collect()):
        assert got[r["id"]] == state.get(r["k"])
        if r["value"] is not None:
            state[r["k"]] = r["value"]
        reads += r["operation"] == "read"
    assert abs(reads / 30 - ycsb.MIXES[workload][0]) < 5 and len(got) == 3000


def test_a_workload_on_a_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.append(ycsb.load(spark, 40, 24).select("k", F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(PUT).alias("op"), F.col("loaded").alias("value")))
    state = {r["k"]: r["value"] for r in table.view().collect()}
    ops = ycsb.generate(spark, 600, 50, "A", 24)
    for i in range(2):
        part = ops.where((F.col("id") >= 300 * i) & (F.col("id") < 300 * (i + 1)))
        seen = {r["id"]: r["seen"] for r in ycsb.run(table, part, i + 1).collect()}
        for r in sorted(part.collect()):
            assert seen[r["id"]] == state.get(r["k"])
            if r["value"] is not None:
                state[r["k"]] = r["value"]
        assert {r["k"]: r["value"] for r in table.view().collect()} == state
