"""Operator 8, SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints of 64 bits link at `radius` or fewer differing bits.  Every bit position gets a
vector of radius + 1 bits; for each of the 2^(radius+1) - 1 non-zero vectors v, mask v keeps the
positions whose vector has an odd product with v.  The vectors of at most `radius` differing
positions never span the whole space, so some v is orthogonal to all of them: in that table the
two fingerprints agree on every kept bit.  Hence no pair within the radius is ever missed.

Equal fingerprints are one node before any table is built.  A bucket within the tables is
compared inside one task and leaves a star per component, not its pairs.  Buckets above
`most` fingerprints are dealt out again by the same construction over the bits their mask
dropped; as fingerprints are distinct and two levels fix 48 bits, such a bucket has 65,536
members at the very most.

Defined results: no words (null, empty or blank text): fingerprint zero, linked like any other;
fewer words than a shingle: the whole sequence is the one shingle; repeated shingles count
each time; a null doc_id links like any other and gets the component of its group (null if no
member has an id); repeated rows come out once each; no rows, no result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Forest, connected_components, contract, numbered, own, parts_for, prepare, smallest_ids, table

SHINGLE, RADIUS, SEED = 3, 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        dig = xxhash.xxh64_digest
        digests = b"".join([dig(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(bits)).tobytes(), "big")


def _fingerprints(shingle: int):
    """The text column (the second) gives way to the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("fingerprints")
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], U64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    return run


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions, one for each non-zero vector."""
    size = 1 << (radius + 1)
    vector = {p: i % (size - 1) + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(radius: int):
    """Rows (bucket columns.., fp, node): links of the task's buckets, as stars.  A task holds the
    rows of its own buckets, which the number of tasks bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("links")
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        *keys, fp, node = (c.to_numpy() for c in t.columns)
        order = np.lexsort((node, *keys))
        fp, node = fp[order].view(U64), node[order]
        head = np.zeros(len(fp), bool)
        head[0] = True
        for k in keys:
            k = k[order]
            head[1:] |= k[1:] != k[:-1]
        start = np.flatnonzero(head)
        size = np.diff(start, append=len(fp))
        links: list[tuple[np.ndarray, np.ndarray]] = []
        two = start[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        links.append((node[near], node[near + 1]))
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            f, forest = fp[s : s + n], Forest()
            if n <= 64:
                i, j = np.nonzero(np.tril(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, -1))
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    forest.join(x, y)
            else:
                root = np.arange(n)
                for i in range(1, n):
                    hit = np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= radius)
                    for r in np.unique(root[hit]).tolist():
                        forest.join(i, r)
                    if len(hit):
                        root[i] = forest.find(i)
            pairs = [(x, forest.find(x)) for x in list(forest.up)]
            pairs = [(x, r) for x, r in pairs if x != r]
            if pairs:
                x, r = np.array(pairs).T
                links.append((node[s + x], node[s + r]))
        a, b = (np.concatenate(p) for p in zip(*links, strict=True))
        yield from contract(iter([pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])]))

    return run


def link_fingerprints(nodes: DataFrame, *, radius: int = RADIUS, most: int = 2000) -> DataFrame:
    """nodes: (fp, node), each fp once.  Links (a, b) with the components of all pairs within
    `radius`."""
    spark = nodes.sparkSession
    n = nodes.count()
    masks = covering_masks(list(range(64)), radius)
    tabled = nodes.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("x"))
    tabled = tabled.select("x.t", "x.key", "fp", "node")
    large = tabled.groupBy("t", "key").count().where(F.col("count") > most).select("t", "key").checkpoint()
    n_large = large.count()
    light = tabled
    deep = None
    if n_large:
        side = F.broadcast(large) if n_large <= 10_000 else large
        light = tabled.join(side, ["t", "key"], "left_anti")
        heavy = tabled.join(side, ["t", "key"], "left_semi")
        subs = [covering_masks([p for p in range(64) if not m >> p & 1], radius) for m in masks]
        choice = F.array(*[F.array(*[F.lit(_signed(s)) for s in sub]) for sub in subs])
        deep = heavy.select("t", "key", "fp", "node", F.posexplode(F.element_at(choice, F.col("t") + 1)).alias("u", "mask"))
        deep = deep.select("t", "key", "u", F.col("fp").bitwiseAND(F.col("mask")).alias("sub"), "fp", "node")
        deep = deep.repartition(parts_for(spark, n * 16, 500_000), "t", "key", "u", "sub").mapInArrow(_stars(radius), "a long, b long")
    links = light.repartition(parts_for(spark, n * len(masks), 500_000), "t", "key").mapInArrow(_stars(radius), "a long, b long")
    return links.union(deep) if deep is not None else links


def _classes(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows (doc_id, fp and whatever follows the text), the distinct ones as
    numbered classes, and their links' roots."""
    rest = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    fps = docs.mapInArrow(_fingerprints(shingle), f"doc_id long, fp long{rest}").checkpoint()
    classes = numbered(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return fps, classes, connected_components(link_fingerprints(classes.select("fp", "node"), radius=radius), contracted=True)


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp: signed 64-bit, component_id) for every row of `docs`."""
    fps, classes, roots = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, radius)
    named = smallest_ids(classes, roots).select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Exactly one row, all columns, of each group: that with the smallest doc_id (null last), then
    the smallest hash of the row.

    Rows are told apart by doc_id and that hash, so equal ids with different texts are judged each
    by itself.  What has to go is looked up, not what stays; rows equal in every column are dealt
    with apart, and only where they won, by an aggregation with map-side combine."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    told = docs.withColumns({"__tm_row": F.xxhash64(*plain), "__tm_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))})
    rows = told.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("__tm_row").alias("row"), F.col("__tm_id").alias("id"))
    fps, classes, roots = _classes(rows, shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "id", "row")
    groups = classes.select("fp", "node").join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("group"))
    first = fps.groupBy("fp").agg(F.min(order).alias("first")).join(groups, "fp").select("fp", "group", "first")
    best = first.groupBy("group").agg(F.min("first").alias("best"))
    judged = fps.withColumn("mine", order).join(first.select("fp", "group").join(best, "group").select("fp", "best"), "fp")
    judged = judged.select(F.col("row").alias("__tm_row"), F.col("id").alias("__tm_id"), (F.col("mine") == F.col("best")).alias("won")).checkpoint()
    key = ["__tm_row", "__tm_id"]
    left = told.join(judged.where("not won").select(*key).distinct(), key, "left_anti")
    twice = judged.where("won").groupBy(*key).count().where("count > 1").select(*key).checkpoint()
    if twice.limit(1).count():
        once = left.join(twice, key, "left_semi").dropDuplicates(key)
        left = left.join(twice, key, "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
