"""Analytics over levels, files and manifests of a log-structured store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fold import SLAB_ROWS, ordered_fold, reset_groups, running, slab_cuts, slab_of
from tidemark.schema import PUT

# Fixed values of the level layout.
L0_TRIGGER, LEVEL_RATIO, BASE_BYTES, MAX_LEVELS, STALL_AT = 4, 10, 10 * 1024 * 1024, 7, 12

#: Keys and bounds of files that one task of `level_counts` should hold: each key becomes a row a level.
PROBE_SLAB = 1 << 19

#: Keys of at most so many bytes, as Spark estimates, are few: it sends them to all tasks by itself.
FEW_KEYS_BYTES = 10 << 20


def target_size(level: Column) -> Column:
    """Bytes a level should hold; level 0 goes by files (A3)."""
    return F.when(level == 0, F.lit(0.0)).otherwise(F.lit(float(BASE_BYTES)) * F.pow(F.lit(float(LEVEL_RATIO)), level - 1))


def compaction_score(files: DataFrame) -> DataFrame:
    """Level 0: files over the trigger; deeper: bytes over the target (A2)."""
    sums = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("files") / L0_TRIGGER).otherwise(F.col("bytes") / target_size(F.col("level")))
    return sums.withColumn("score", F.round(score, 6))


def _height(lo: Column, hi: Column) -> Column:
    """The power of two that an inclusive range fits into: it meets two bins of that width at most."""
    return F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int")


def _floor_div(x: str) -> str:
    """SQL of the bin that a key falls into at `__tm_height`, in whole numbers: shifting rounds down."""
    return f"shiftright(cast({x} as bigint), __tm_height)"


def _bins(rows: DataFrame, heights: Column) -> DataFrame:
    """Rows at every bin (height, bin) that their range lo..hi meets at the given heights."""
    at = rows.withColumn("__tm_height", F.explode(heights))
    first, last = (F.expr(_floor_div(c)) for c in ("lo", "hi"))
    return at.withColumn("__tm_bin", F.explode(F.sequence(first, last)))


def file_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of files whose inclusive key ranges meet (P4, J3), as an equi-join on key bins.

    Each file's bins are as wide as its own range, so it has two at most however wide it is; it looks
    for the other side at all widths from its own on that occur there.  A pair meets at the wider
    one's width, and is taken from the first bin it shares.  As many rows as there are pairs; to
    count them, `overlap_counts`."""

    def side(rows: DataFrame, end: str) -> DataFrame:
        named = rows.select(*[F.col(c).alias(f"{c}_{end}") for c in rows.columns]).withColumns({"lo": F.col(f"lo_{end}"), "hi": F.col(f"hi_{end}")})
        return named.where("lo <= hi").withColumn("__tm_own", _height(F.col("lo"), F.col("hi")))

    a, b = side(left, "a"), side(right, "b")
    own_a, own_b = (_bins(x, F.array("__tm_own")) for x in (a, b))
    tall_a, tall_b = (F.array(*[F.lit(h) for h in _heights(x)]).cast("array<int>") for x in (a, b))
    wider = _bins(b, F.filter(tall_a, lambda h: h >= F.col("__tm_own")))
    taller = _bins(a, F.filter(tall_b, lambda h: h > F.col("__tm_own")))
    key, drop = ["__tm_height", "__tm_bin"], ["lo", "hi", "__tm_own"]
    pairs = own_a.drop(*drop).join(wider.drop(*drop), key).unionByName(taller.drop(*drop).join(own_b.drop(*drop), key))
    first = F.expr(_floor_div("greatest(lo_a, lo_b)"))
    return pairs.where((first == F.col("__tm_bin")) & (F.greatest("lo_a", "lo_b") <= F.least("hi_a", "hi_b"))).drop(*key)


def _heights(files: DataFrame) -> list[int]:
    """The widths that occur, 64 at most."""
    return sorted(r[0] for r in files.select("__tm_own").distinct().collect())


def overlap_counts(left: DataFrame, right: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(file_num, overlaps): how many files of `right` the range of each file of `left` meets (P4, J3), added
    up where files share a number; those that meet none are left out.

    No pairs: what begins at or before a file's end less what ends before its start, two running
    totals over the bounds of both sides."""

    def points(files: DataFrame, number: str, *each: tuple) -> DataFrame:
        at = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(c).alias("at"), F.lit(kind).alias("kind"), F.lit(d).alias("d"), F.lit(sign).alias("sign")) for axis, c, kind, d, sign in each])
        return files.where("lo <= hi").select(F.expr(number).alias("file_num"), F.explode(at).alias("p")).select("file_num", "p.*")

    # of equal places bounds of the right come first among the starts (0), last among the ends (2)
    asked = points(left, "file_num", (0, "hi", 1, 0, 1), (1, "lo", 1, 0, -1))
    bounds = points(right, "null", (0, "lo", 0, 1, 0), (1, "hi", 2, 1, 0))
    both = asked.unionByName(bounds)
    counted = running(both, ["axis"], ["at", "kind"], F.col("d"), "sum", F.col("at"), "c", slab_rows=slab_rows)
    return counted.where("sign <> 0").groupBy("file_num").agg(F.sum(F.col("sign") * F.col("c")).alias("overlaps")).where("overlaps > 0")


def level_probe(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose range holds each key (R11, J4), by key bins: as many rows as there are pairs."""
    held = files.where("lo <= hi").withColumn("__tm_own", _height(F.col("lo"), F.col("hi")))
    heights = F.array(*[F.lit(h) for h in _heights(held)]).cast("array<int>")
    asked = _bins(keys.withColumns({"lo": F.col("k"), "hi": F.col("k")}), heights).drop("lo", "hi")
    return asked.join(_bins(held, F.array("__tm_own")), ["__tm_height", "__tm_bin"]).where("k between lo and hi").drop("__tm_height", "__tm_bin", "__tm_own")


def level_counts(keys: DataFrame, files: DataFrame, slab_rows: int = PROBE_SLAB) -> DataFrame:
    """(k, level, files): how many files (level, lo, hi) of each level hold each key (R11, J4), once for each
    row of the key; levels with none are left out.

    No pairs: a key is held by the files that begin at or before it less those that end before it,
    which is a running total over bounds and keys in order.  Levels are few, so each is a column.
    Large tables are cut into slabs, each of which begins with a row of the totals before it."""
    held = files.where("lo <= hi")
    levels = [r[0] for r in held.select("level").distinct().collect()]
    if not levels:
        return keys.select("k", F.lit(None).cast(files.schema["level"].dataType).alias("level"), F.lit(0).cast("long").alias("files")).limit(0)
    bound = F.array(*[F.struct(F.col(c).alias("at"), F.lit(kind).alias("kind"), F.lit(d).alias("d")) for c, kind, d in (("lo", 0, 1), ("hi", 2, -1))])
    of = [F.sum(F.when(F.col("level").eqNullSafe(x), F.col("p.d"))).alias(f"__tm_l{i}") for i, x in enumerate(levels)]
    totals = [f"__tm_l{i}" for i in range(len(levels))]
    bounds = held.select("level", F.explode(bound).alias("p")).groupBy("p.at", "p.kind").agg(*of)
    asked = keys.where("k is not null").groupBy(F.col("k").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    points = bounds.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    cuts = slab_cuts(points.select("at"), F.col("at"), slab_rows)
    points = points.withColumn("slab", slab_of(F.col("at"), cuts))
    if cuts:
        sums = bounds.groupBy(slab_of(F.col("at"), cuts).alias("slab")).agg(*[F.sum(c).alias(c) for c in totals])
        every = files.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("slab"))
        past = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)  # a row a slab
        heads = every.join(F.broadcast(sums), "slab", "left").select("slab", F.lit(-1).alias("kind"), *[F.sum(c).over(past).alias(c) for c in totals])
        points = points.unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy("slab").orderBy(F.asc_nulls_first("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = points.select("at", "n", *[F.sum(c).over(order).alias(c) for c in totals]).where("n is not null")
    each = F.array(*[F.struct(F.lit(x).alias("level"), (F.col(c) * F.col("n")).alias("files")) for x, c in zip(levels, totals, strict=True)])
    return counted.select(F.col("at").alias("k"), F.explode(each).alias("p")).select("k", F.col("p.level").cast(files.schema["level"].dataType).alias("level"), "p.files").where("files > 0")


def level_get(wanted: DataFrame, log: DataFrame, files: DataFrame) -> DataFrame:
    """Lookup by level (R11): of the files (level, file_num, lo, hi) whose range holds a key, those of
    level 0 are asked newest first (largest number), then one of each deeper level; the first whose
    rows in `log` (k, level, file_num, op, ..) have the key decides, a deletion too.  Adds `found`."""
    rest = [c for c in log.columns if c not in ("k", "level", "file_num")]
    # an equi-join by key finds the rows; bounds are looked up by file, so no key meets every wide file
    held = files.select("level", "file_num", F.col("lo").alias("__tm_lo"), F.col("hi").alias("__tm_hi"))
    # few keys leave few rows to look bounds up for; many are matched at the end, so that a log dealt by file
    # stays so for its bounds and is then dealt by key once
    few = int(str(wanted.select("k")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= FEW_KEYS_BYTES
    some = log.join(wanted.select("k").distinct(), "k", "left_semi") if few else log
    rows = some.join(held, ["level", "file_num"]).where("k between __tm_lo and __tm_hi").drop("__tm_lo", "__tm_hi")
    order = F.struct(F.col("level"), F.when(F.col("level") == 0, -F.col("file_num")).otherwise(F.col("file_num")))
    first = F.min_by(F.struct("level", "file_num", *rest), order).alias("__tm")
    hit = rows.groupBy("k").agg(first).where(F.col("__tm.op") == PUT)
    out = wanted.join(hit, "k", "left")
    return out.select(*wanted.columns, F.col("__tm").isNotNull().alias("found"), *[F.col(f"__tm.{c}").alias(c) for c in ("level", "file_num", *rest)])


def compaction_pick(files: DataFrame) -> DataFrame:
    """Input files of the next compaction with their role (C1, N4): the highest score strictly above
    one wins, lower levels first; level 0 gives all its files, others their largest (lowest number
    first), and the next level those that overlap the inputs.  No level above one: no rows."""
    pick = compaction_score(files).where(f"score > 1 and level < {MAX_LEVELS - 1}").agg(F.max_by("level", F.struct("score", -F.col("level"))).alias("pick"))
    mine = files.join(F.broadcast(pick), F.col("level") == F.col("pick"))  # one row, null if no level is above
    largest = mine.where("pick > 0").orderBy(F.desc("size"), "file_num").limit(1)
    chosen = mine.where("pick = 0").unionByName(largest)
    span = chosen.agg(F.min("lo").alias("a"), F.max("hi").alias("b"), (F.max("pick") + 1).alias("next"))  # one row
    below = files.join(F.broadcast(span), (F.col("level") == F.col("next")) & (F.col("hi") >= F.col("a")) & (F.col("lo") <= F.col("b"))).drop("a", "b", "next")
    return chosen.drop("pick").withColumn("role", F.lit("input")).unionByName(below.withColumn("role", F.lit("overlap")))


def compaction_split(files: DataFrame, target: int) -> DataFrame:
    """Output file of each input of a level in key order (N5): a file ends with the input that brings it
    to the target, and the next starts from nothing."""
    return reset_groups(files, "level", ["lo", "file_num"], "size", target, "out_file")


def manifest_state(edits: DataFrame) -> DataFrame:
    """(edit_no, action, level, file_num, ..) -> live files (C5): the last edit of each (level, file_num)
    decides, so a file that is added again after its deletion lives."""
    key = ["level", "file_num"]
    rest = [c for c in edits.columns if c not in key]
    last = edits.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("edit_no", F.col("action") == "add")).alias("__tm"))
    live = last.where(F.col("__tm.action") == "add")
    return live.select(*key, *[F.col(f"__tm.{c}").alias(c) for c in rest if c not in ("edit_no", "action")]).orderBy("level", "lo", "file_num")


def segments(log: DataFrame, size: Column, limit: int, by: str = "k", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Flush segment or block of each row with its `bytes` (W9, W11, W12): the row that fills a
    segment to `limit` is its last."""
    return reset_groups(log.withColumn("bytes", size.cast("long")), by, list(order), "bytes", limit, "segment")


def stall_flags(changes: DataFrame, trigger: int = STALL_AT, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(k, ts, delta) -> files in level 0 and whether writes stall."""
    done = running(changes, ["k"], ["ts"], F.col("delta"), "sum", F.col("ts"), "l0", slab_rows=slab_rows)
    return done.withColumn("stalled", F.col("l0") >= trigger)


def compaction_stats(events: DataFrame) -> DataFrame:
    """(kind, bytes_in, bytes_out, ms) of begun and done compactions and of stalls -> one row of
    counters (A4): kinds are `begin`, `done` and `stall`; pending is begun less done."""
    done, stall = F.col("kind") == "done", F.col("kind") == "stall"

    def total(what: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, what)), F.lit(0)).cast("long")

    one = F.lit(1)
    return events.agg(
        total(F.col("bytes_in"), done).alias("bytes_compacted"),
        total(F.col("bytes_out"), done).alias("bytes_written"),
        total(one, done).alias("compactions"),
        total(F.col("ms"), done).alias("compaction_ms"),
        total(F.col("ms"), stall).alias("stall_ms"),
        (total(one, F.col("kind") == "begin") - total(one, done)).alias("pending"),
    )


def cache_shard(file: Column, offset: Column) -> Column:
    """Shard of a cached block; the multiplier is 1 modulo 4, so low bits suffice."""
    return file.bitwiseXOR(offset).bitwiseAND(F.lit(3))


def lru_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """(shard, k, ts) -> hit of an LRU cache of `capacity` blocks a shard (N6, C13).  With a column `file`
    blocks belong to files, and a row with a null k removes its file's blocks (it is no access and has
    a null hit).  A shard is one task's time; memory is one cache."""
    filed = "file" in accesses.columns

    def step(cache, _, k, file):  # a dict keeps its order of insertion
        blocks, of = cache
        if k is None and filed:
            for x in of.pop(file, ()):
                del blocks[x]
            return None
        x = (file, k)
        hit = x in blocks
        blocks.pop(x, None)
        blocks[x] = True
        if filed:
            of.setdefault(file, set()).add(x)
        if len(blocks) > capacity:
            out = next(iter(blocks))
            del blocks[out]
            if filed:
                of[out[0]].discard(out)
        return hit

    rows = accesses.select("shard", "ts", "k", (F.col("file") if filed else F.lit(None).cast("long")).alias("file"))
    done = ordered_fold(rows, "shard", ["ts", "k", "file"], lambda: [{}, {}], step, "hit", "boolean")
    return done.select("shard", "k", "ts", "hit", *(["file"] if filed else []))
