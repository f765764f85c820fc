"""Operator 5, embedding near-dedup by iterative quantisation.

A rotation is learnt on at most `sample_rows` vectors (a bound of the fit; every vector is
indexed) so that the signs of the rotated vectors are balanced binary codes of 64 bits (vectors with
fewer components get several rotations).  Codes are cut into four substrings of 16 bits, one
table each (multi-index Hamming tables).  A vector looks up its own substrings and those within one
flipped bit, so every pair with at most seven differing bits is found whatever the number of rows,
and of those beyond every pair that differs in at most one bit of some substring and `most_bits` in
all.  A pair is taken from the first table that holds it, so it counts once; it is reranked by
the cosine of the original vectors in double precision.

Buckets of at most `crowd` vectors give pairs; fuller ones are compared where they are, in blocks,
and give a number of links for each vector and stars of links, never their pairs.  Equal vectors
are one node and are not compared; their number enters the counts.  Vectors of another length than
the usual one have buckets of their own and codes from random hyperplanes.

Defined results: a null vector, one with null or non-finite components and the zero vector
link with nothing, not even with their likes, and are kept; vectors of different lengths do not
link; repeated rows count as links of one another; a null vec_id links like any other, but names
no component; no rows, no result; other columns, labels among them, are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, connected_components, numbered, own, prepare, smallest_hashes, smallest_ids, table

THRESHOLD, SAMPLE_ROWS, MOST_BITS = 0.95, 20_000, 18
BITS, TABLES = 64, 4
#: Vectors of a bucket that is compared as a whole, and of a block of it.
CROWD, BLOCK = 256, 2048


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, the vector's doubles as bytes, or null where it links with nothing)."""
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            a = np.array([], float) if v is None or any(x is None for x in v) else np.asarray(v, float) + 0.0
            with np.errstate(over="ignore"):
                ok = len(a) and np.isfinite(a).all() and a.any()
            out.append(a.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


class Rotation:
    """Centre, projection and rotations learnt by iterative quantisation, 64 bits in all."""

    def __init__(self, x: np.ndarray, rounds: int = 50, seed: int = 5) -> None:
        self.dims = x.shape[1]
        x = _unit(x)
        self.mean = x.mean(axis=0)
        centred = x - self.mean
        _, vectors = np.linalg.eigh(centred.T @ centred)
        rng, turns = np.random.default_rng(seed), []
        while sum(t.shape[1] for t in turns) < BITS:
            axes = vectors[:, ::-1][:, :BITS]
            z = centred @ axes
            r, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
                r = (u @ vt).T
            turns.append(axes @ r)
        self.turn = np.hstack(turns)[:, :BITS]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return _signs((_unit(x) - self.mean) @ self.turn)


def _signs(z: np.ndarray) -> np.ndarray:
    return ((z >= 0).astype(U64) << np.arange(BITS, dtype=U64)).sum(axis=1, dtype=U64).view(np.int64)


@lru_cache(maxsize=8)
def _hyperplanes(dims: int) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims, BITS))


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation: Rotation = shared.value
        for b in batches:
            raw = b.column(1).to_pylist()
            code, dims = np.zeros(b.num_rows, np.int64), np.array([len(v) // 8 for v in raw])
            for n in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == n)
                x = np.frombuffer(b"".join(raw[i] for i in mine)).reshape(len(mine), n)
                code[mine] = rotation.codes(x) if n == rotation.dims else _signs(_unit(x) @ _hyperplanes(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], ["node", "v", "copies", "code"])

    return run


def _cosine(p: np.ndarray, q: np.ndarray) -> float:
    p, q = p / np.abs(p).max(), q / np.abs(q).max()
    return float(p @ q / np.sqrt((p @ p) * (q @ q)))


def _rerank(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, cos = [], []
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if len(x) == len(y):
                    p, q = np.frombuffer(x), np.frombuffer(y)
                    c = _cosine(p, q)
                    if c >= threshold:
                        keep.append(i)
                        cos.append(c)
            got = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns[:4], pa.array(cos, pa.float64())], ["a", "b", "copies_a", "copies_b", "cosine"])

    return run


WIDTH = BITS // TABLES
_LOW = (1 << WIDTH) - 1


def _tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index (t, key, node, code): a row a vector and table; and probes, a row for each key that
    a vector looks up.  Keys hold the length of the vector, so other lengths are apart."""
    subs = [F.shiftrightunsigned("code", WIDTH * t).bitwiseAND(F.lit(_LOW)) + F.shiftleft(F.length("v").cast("long"), WIDTH) for t in range(TABLES)]
    of = nodes.select("node", "code", F.posexplode(F.array(*subs)).alias("t", "key"))
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << i for i in range(WIDTH)))])
    probes = of.select("node", "code", "t", "key", F.explode(flips).alias("flip"))
    return of, probes.select("node", "code", "t", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))


def _near_in(diff: np.ndarray, t: int) -> np.ndarray:
    return np.bitwise_count((diff >> U64(WIDTH * t)) & U64(_LOW)) <= 1


def _compare(threshold: float, most_bits: int):
    """Rows (t, key, block, side, node, code, copies, v) of crowded buckets, sorted so: those indexed
    (side 0) and those that look up (side 1).  Gives (node, others, linked): links of a node counted
    with copies, or a link of it to one other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("vectors")
        now, state = None, None

        def give(node, others, linked) -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (node, others, linked)]
            return pa.RecordBatch.from_arrays([cols[0], cols[1], pc.if_else(pc.equal(cols[1], 0), cols[2], pa.nulls(len(cols[2]), pa.int64()))], ["node", "others", "linked"])

        def finish() -> pa.RecordBatch:
            node, total, label = state["node"], state["total"], state["label"]
            some = np.flatnonzero(total)
            apart = np.flatnonzero(label != np.arange(len(label)))
            return give([node[some], node[apart]], [total[some], np.zeros(len(apart), np.int64)], [node[some], node[label[apart]]])

        for b in batches:
            if not b.num_rows:
                continue
            t, key, block, side, node, code, copies = (c.to_numpy() for c in b.columns[:7])
            heads = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0))
            for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), b.num_rows], strict=True):
                which = (int(t[lo]), int(key[lo]), int(block[lo]))
                x = np.frombuffer(b"".join(b.column(7).slice(lo, hi - lo).to_pylist())).reshape(hi - lo, -1)
                mine = {"node": node[lo:hi], "code": code[lo:hi].view(U64), "copies": copies[lo:hi], "x": x, "unit": _unit(x)}
                if which != now:
                    if state is not None:
                        yield finish()
                    now, state = which, {k: v[:0] for k, v in mine.items()} | {"total": np.zeros(0, np.int64), "label": np.zeros(0, np.int64)}
                if side[lo] == 0:
                    state = {k: np.concatenate([state[k], v]) for k, v in mine.items()}
                    state |= {"total": np.zeros(len(state["node"]), np.int64), "label": np.arange(len(state["node"]))}
                    continue
                for i in range(0, hi - lo, 512):
                    q = {k: v[i : i + 512] for k, v in mine.items()}
                    yield give(*_links(state, q, which[0], threshold, most_bits))
        if state is not None:
            yield finish()

    return run


def _links(state: dict, q: dict, t: int, threshold: float, most_bits: int) -> tuple[list, list, list]:
    """Compares what looks up with what is indexed; counts of the former, and a link for each."""
    diff = state["code"][:, None] ^ q["code"][None, :]
    near = (state["node"][:, None] < q["node"][None, :]) & (np.bitwise_count(diff) <= most_bits)
    for before in range(t):
        near &= ~_near_in(diff, before)
    cos = state["unit"] @ q["unit"].T
    on = near & (cos >= threshold)
    for i, j in zip(*np.nonzero(near & (np.abs(cos - threshold) < 1e-12)), strict=True):
        on[i, j] = _cosine(state["x"][i], q["x"][j]) >= threshold
    state["total"] += on @ q["copies"]
    linked = np.flatnonzero(on.any(axis=0))
    first, label = on[:, linked].argmax(axis=0), state["label"]
    for j in linked[on[:, linked].sum(axis=0) > 1].tolist():  # what it links is one component
        mine = label[on[:, j]]
        if (mine != mine[0]).any():
            label[np.isin(label, mine)] = mine.min()
    others = (state["copies"] @ on)[linked]
    nodes = q["node"][linked]
    return [nodes, nodes], [others, np.zeros(len(nodes), np.int64)], [nodes, state["node"][first]]


def links(nodes: DataFrame, *, threshold: float, most_bits: int = MOST_BITS, crowd: int = CROWD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of `nodes` (node, v, copies, code): (node, others), to be summed, and links (a, b) with the
    components of all pairs."""
    index, probes = _tables(nodes)
    full = index.groupBy("t", "key").count().where(F.col("count") > crowd)
    full = full.select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")).checkpoint()
    crowded = full.limit(1).count() > 0
    light = index.join(full, ["t", "key"], "left_anti") if crowded else index
    left = light.select("t", "key", F.col("node").alias("a"), F.col("code").alias("code_a"))
    right = probes.select("t", "key", F.col("node").alias("b"), F.col("code").alias("code_b"))
    diff, earlier = F.col("code_a").bitwiseXOR(F.col("code_b")), F.lit(False)
    for t in range(TABLES - 1):
        near = F.bit_count(F.shiftrightunsigned(diff, WIDTH * t).bitwiseAND(F.lit(_LOW))) <= 1
        earlier = earlier | ((F.col("t") > t) & near)
    found = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(diff) <= most_bits) & ~earlier).select("a", "b")
    va = nodes.select(F.col("node").alias("a"), F.col("copies").alias("copies_a"), F.col("v").alias("va"))
    vb = nodes.select(F.col("node").alias("b"), F.col("copies").alias("copies_b"), F.col("v").alias("vb"))
    both = found.join(va, "a").join(vb, "b").select("a", "b", "copies_a", "copies_b", "va", "vb")
    pairs = both.mapInArrow(_rerank(threshold), "a long, b long, copies_a long, copies_b long, cosine double").checkpoint()
    counted = pairs.select(F.col("a").alias("node"), F.col("copies_b").alias("others")).union(pairs.select("b", "copies_a"))
    linked = pairs.select("a", "b")
    if crowded:
        places = index.join(full, ["t", "key"]).select("t", "key", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(0).alias("side"), "node")
        asked = probes.join(full, ["t", "key"]).select("t", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "node")
        rows = places.union(asked).join(nodes.select("node", "code", "copies", "v"), "node").select("t", "key", "block", "side", "node", "code", "copies", "v")
        where = ["t", "key", "block"]
        done = rows.repartition(*where).sortWithinPartitions(*where, "side").mapInArrow(_compare(threshold, most_bits), "node long, others long, linked long").checkpoint()
        counted = counted.union(done.where("others > 0").select("node", "others"))
        linked = linked.union(done.where("linked is not null").select("node", "linked"))
    return counted, linked


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(_clean, "vec_id long, v binary").checkpoint()
    plain = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = numbered(plain)
    named = nodes.select("node", "v", "copies")
    n = named.limit(2).count()
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n < 2:
        linked = rows.where("v is not null").join(nodes, "v").select("vec_id", (F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    else:
        dims = named.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()["n"]  # the usual length
        sample = smallest_hashes(named.where(F.length("v") == dims), sample_rows, "node").orderBy(F.xxhash64("node")).limit(sample_rows).select("v").toArrow()["v"]
        rotation = Rotation(np.frombuffer(b"".join(sample.to_pylist())).reshape(-1, dims // 8))
        shared = spark.sparkContext.broadcast(rotation)
        coded = named.mapInArrow(_encode(shared), "node long, v binary, copies long, code long").checkpoint()
        counted, linked = links(coded, threshold=threshold, crowd=crowd, block=block)
        degree = counted.groupBy("node").agg(F.sum("others").alias("others"))
        roots = connected_components(linked)
        known = smallest_ids(nodes.join(degree, "node", "left"), roots)
        known = known.select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
        linked = rows.where("v is not null").join(known, "v").select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""
