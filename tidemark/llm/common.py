"""Shared plumbing of the training-data operators: shipping the package to executors,
reliable checkpoints, vectorised word hashing over Arrow buffers and distributed
connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once per application, bound Arrow batches and
    make sure that a checkpoint folder exists (the cluster's own where it names one)."""
    gc.collect()
    trim()
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(), "tidemark_pkg.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-ckpt-"))
    # 2,000 rows of ordinary text are a few MB; byte limits guard against very long texts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parts_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for `rows` rows at `per_task` each, never below the session's setting."""
    return max(n_shuffle(spark), -(-rows // per_task))


def smallest_hashes(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """`rows` with a hash of the columns below a bound that leaves somewhat more than `most` of
    them: what is then sorted for the `most` smallest does not grow with the table."""
    n = rows.count()
    if n <= 4 * most:
        return rows
    bound = int(-(1 << 63) + (1 << 64) * (1.5 * most + 1000) / n)
    return rows.where(F.xxhash64(*columns) < F.lit(bound)) if bound < (1 << 63) - 1 else rows


def most_frequent(counted: DataFrame, by: str, most: int) -> list:
    """Rows of a counted table that are more frequent than a cut, `most` at most, on the driver.  The
    cut comes from a histogram, so no task sends the driver more."""
    counted = counted.checkpoint()
    c = F.col(by)
    size = F.when(c < 1000, c).otherwise(1000 + F.floor(F.log(c / 1000.0) * 100)).cast("long")
    histogram = sorted(map(tuple, counted.groupBy(size.alias("size")).count().collect()), reverse=True)  # a few thousand rows
    cut, total = 1 << 62, 0
    for value, n in histogram:
        total += n
        if total > most:
            break
        cut = value
    return counted.where(size >= cut).collect()


#: What empties the caches that an operator keeps in a worker between tasks.
CACHES: dict[str, object] = {}


def own(operator: str) -> None:
    """Called at the start of a task: workers are used again, so other operators' caches go, and
    memory that allocators keep goes back to the system."""
    for name, clear in CACHES.items():
        if name != operator:
            clear()
    trim()


def trim() -> None:
    """Gives unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- Arrow text buffers


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null counts as empty) and its n+1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunked(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; one row is never cut."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Every byte that ends a word: the space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def spans(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes with inside[byte]; runs
    never cross rows."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    on = inside[raw]
    before, after = np.empty_like(on), np.empty_like(on)
    before[0], before[1:] = False, on[:-1]
    after[-1], after[:-1] = False, on[1:]
    heads = offs[:-1]
    before[heads[heads < len(raw)]] = False
    tails = offs[1:] - 1
    after[tails[tails >= 0]] = False
    start = np.flatnonzero(on & ~before)
    end = np.flatnonzero(on & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


CACHES["hashing"] = _POW.clear


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i in 0..n-1; base is odd."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            a = np.ones(size, U64)
            a[1:] = U64(b)
            out.append(np.multiply.accumulate(a))
        have = _POW[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial by prefix sums, then mixed."""
    pw, inv = powers(0x9E3779B97F4A7C15, len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * pw[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_SIGNS: dict[int, np.ndarray] = {}
CACHES["signs"] = _SIGNS.clear
#: Places in a word whose random values are kept in a table.
PLACES = 64


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each of these disjoint spans of bytes: the sum of a random value for each place and byte,
    then mixed.  Unlike a polynomial modulo 2^64 it has no pairs of words that collide whatever
    the seed, and hashes with different seeds are independent."""
    table = _SIGNS.get(seed)
    if table is None:
        table = _SIGNS[seed] = mix(mix(np.arange(PLACES * 256, dtype=U64) + U64(seed)) + U64(seed))
    length = end - start
    ends = np.cumsum(length)
    # texts come in chunks far below 2^31 bytes
    every = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    place = every - np.repeat((ends - length).astype(np.int32), length)
    every += np.repeat((start - ends + length).astype(np.int32), length)
    sign = place * np.int32(256) + raw[every]
    del every
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value = table[np.where(place < PLACES, sign, 0)]
        value[far] = mix(mix((place[far].astype(U64) * U64(256) + (sign[far] & 255).astype(U64)) + U64(seed)) + U64(seed))
    else:
        value = table[sign]
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(value, out=total[1:])
    return mix(total[ends] - total[ends - length] + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def sequences(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every `width` consecutive values (fewer values: none): hashes of neighbours are mixed
    into one of twice the width, or of one value more."""
    h, done = values, 1
    for bit in bin(width)[3:]:
        h = mix(h[: max(0, len(h) - done)] * U64(seed) + h[done:])
        done *= 2
        if bit == "1":
            n = len(values) - done
            h = mix(h[: max(0, n)] * U64(seed) + values[done:])
            done += 1
    return h[: max(0, len(values) - width + 1)]


# ---------------------------------------------------------------- connected components


class Forest:
    """Union-find over arbitrary hashable nodes; the smallest node is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of one task by a star per component, a million links at a time."""
    forest, seen = Forest(), 0

    def flush() -> pa.RecordBatch:
        rows = [(x, forest.find(x)) for x in list(forest.up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"]
        )

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        seen += b.num_rows
        if seen > 1_000_000:
            yield flush()
            forest, seen = Forest(), 0
    yield flush()


def connected_components(links: DataFrame, most_rounds: int = 60, *, contracted: bool = False) -> DataFrame:
    """(node, root) for every node of `links` (two long columns) but the roots themselves;
    a root is the smallest node reachable.

    Each task first contracts its own links to stars, unless they are `contracted`; then large-star and small-star
    rounds run until nothing changes.  Minima are combined map-side and the joins are
    plain equi-joins that adaptive execution may split, so a hub costs no single task.
    Every round is checkpointed to the shared folder."""
    a, b = links.columns
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    e = (e if contracted else e.mapInArrow(contract, "a long, b long")).distinct().checkpoint()
    prints = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    before = e.select(prints.alias("p")).first()["p"]
    for _ in range(most_rounds):
        if not before["n"]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # an edge (u, v) with v <= u is kept through v's own side, where u is the larger one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        )
        e = small.select("x.a", "x.b").where("a != b").distinct().checkpoint()
        now = e.select(prints.alias("p")).first()["p"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def numbered(classes: DataFrame) -> DataFrame:
    """Classes with a `node` of their own for link search, checkpointed.  Ids will not do: a class may
    have none, and two classes the same (one id with two texts)."""
    return classes.withColumn("node", F.monotonically_increasing_id()).checkpoint()


def smallest_ids(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """`classes` of `numbered` with component_id: the smallest `least` of their component, null if it
    has none."""
    grouped = classes.join(roots, "node", "left").withColumn("__tm_group", F.coalesce("root", "node")).drop("root")
    least = grouped.groupBy("__tm_group").agg(F.min("least").alias("component_id"))
    return grouped.join(least, "__tm_group").drop("__tm_group")
