"""The registered queries on the smallest tables, their SQL, and the pipeline by brute force."""

import os

import compare
import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, queries, simhash, toxicity
from tidemark.llm.common import Forest

from test_operators import strip_brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    if name in queries.ORACLE_SQL:
        assert compare.same(df, compare.oracle(DIR), queries.ORACLE_SQL[name]) is None
    else:
        assert df.count() > 0


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    low = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).orderBy("doc_id").collect() if r.doc_id in low]
    fps, forest = [simhash.fingerprint(r[1]) for r in rows], Forest()
    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= 3:
                forest.join(i, j)
    rows = [r for i, r in enumerate(rows) if forest.find(i) == i]
    rows = [(r[0], kept if gone else r[1]) for r, (_, gone, kept) in zip(rows, strip_brute(rows, 35), strict=True)]
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    items = decontaminate.Items([(b.item_id, b.text) for b in bench], decontaminate.Q, decontaminate.CORE, decontaminate.RATE)
    left = {d for d, t in rows if not items.matches(t)}
    held = {d for d, t in rows if any(b.text in (t or "") for b in bench)}
    assert not left & held
    got = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == left
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "substring_dedup", "decontamination", "packing"]
