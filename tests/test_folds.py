"""Ordered folds and two-level running totals against plain loops, with a hot key and many slabs."""

import random
from collections import Counter, OrderedDict, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clock, history, lsm, quorum, txn, versions, wal
from tidemark.operators.fold import reset_groups, running, slab_cuts, slab_of


def skewed(n=3000, seed=2):
    """(k, ts, x): two thirds of the rows have key 0."""
    r = random.Random(seed)
    return [(0 if r.random() < 0.67 else r.randrange(1, 20), t, r.randrange(1, 50)) for t in r.sample(range(10 * n), n)]


def by_key(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda x: x[1]):
        out[row[0]].append(row)
    return out


@pytest.fixture(scope="module")
def rows():
    return skewed()


def test_commit_outcomes(spark, rows):
    df = spark.createDataFrame(rows, "k long, ts long, x long").select("k", F.col("ts").alias("txn"), (F.col("ts") - F.col("x")).alias("snap"), F.col("ts").alias("req"))
    want = {}
    for k, hist in by_key(rows).items():
        last = -1
        for _, t, x in hist:
            want[t] = last <= t - x
            last = t if want[t] else last
    got = {r.txn: r.committed for r in txn.commit_outcomes(df).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    top = {r.k: r.commit_ts for r in txn.latest_commits(df).collect()}
    assert top == {k: max(t for _, t, _ in h if want[t]) for k, h in by_key(rows).items()}
    assert txn.commit_outcomes(df.limit(0)).count() == 0


def test_token_bucket_and_group_commit(spark, rows):
    df = spark.createDataFrame(rows, "k long, ts long, cost long").withColumn("at", F.col("ts"))
    granted, batch = {}, {}
    for k, hist in by_key(rows).items():
        tokens, last, b, n, first = 60, None, -1, 0, 0
        for _, t, x in hist:
            tokens, last = min(60, tokens + (0 if last is None else t - last)), t
            granted[k, t] = tokens >= x
            tokens -= x if granted[k, t] else 0
            if b < 0 or n >= 4 or t - first >= 30:
                b, n, first = b + 1, 0, t
            n += 1
            batch[k, t] = b
    assert {(r.k, r.ts): r.granted for r in wal.token_bucket(df, 60, 1).collect()} == granted and len(set(granted.values())) == 2
    assert {(r.k, r.ts): r.batch for r in wal.group_commit(df, 4, 30).collect()} == batch
    assert wal.token_bucket(df.limit(0), 60, 1).count() == wal.group_commit(df.limit(0), 4, 30).count() == 0


def test_lru(spark, rows):
    df = spark.createDataFrame([(k % 3, x, t) for k, t, x in rows], "shard long, k long, ts long")
    want = {}
    for shard, hist in by_key([(k % 3, t, x) for k, t, x in rows]).items():
        cache = OrderedDict()
        for _, t, x in hist:
            want[shard, t] = x in cache
            cache[x] = True
            cache.move_to_end(x)
            if len(cache) > 16:
                cache.popitem(last=False)
    assert {(r.shard, r.ts): r.hit for r in lsm.lru_hits(df, 16).collect()} == want
    assert lsm.lru_hits(df.limit(0), 16).count() == 0


def test_cache_with_removed_files(spark, rows):
    df = spark.createDataFrame([(k % 3, x % 4, None if x % 7 == 0 else x, t) for k, t, x in rows], "shard long, file long, k long, ts long")
    want = {}
    for shard, hist in by_key([(k % 3, t, x) for k, t, x in rows]).items():
        cache = OrderedDict()
        for _, t, x in hist:
            file, k = x % 4, None if x % 7 == 0 else x
            if k is None:
                want[shard, t] = None
                for y in [y for y in cache if y[0] == file]:
                    del cache[y]
                continue
            want[shard, t] = (file, k) in cache
            cache[file, k] = True
            cache.move_to_end((file, k))
            if len(cache) > 9:
                cache.popitem(last=False)
    assert {(r.shard, r.ts): r.hit for r in lsm.lru_hits(df, 9).collect()} == want


@pytest.mark.parametrize("limit", [1, 60, 10**6])
def test_reset_groups(spark, rows, limit):
    df = spark.createDataFrame([(k, t, None if x == 9 else x) for k, t, x in rows], "k long, ts long, x long")
    want = {}
    for k, hist in by_key(rows).items():
        group, total = 0, 0
        for _, t, x in hist:
            want[k, t] = group
            total += 0 if x == 9 else x
            if total >= limit:
                group, total = group + 1, 0
    assert {(r.k, r.ts): r.g for r in reset_groups(df, "k", ["ts"], "x", limit, "g").collect()} == want
    assert reset_groups(df.limit(0), "k", ["ts"], "x", limit, "g").count() == 0


@pytest.mark.parametrize("slab", [7, 500, 1 << 20])
@pytest.mark.parametrize("total", ["sum", "max", "min", "last"])
def test_running_totals_equal_one_window(spark, rows, slab, total):
    many = [(k if k != 3 else None, t << 16 if k else (t // 2) << 16 | t % 2, x) for k, t, x in rows]  # stamps with a counter
    df = spark.createDataFrame(many, "k long, ts long, x long").withColumn("x", F.when(F.col("x") > 5, F.col("x")))  # some nulls
    over_of = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[total]
    for newest_first, own in ((False, True), (True, False)):
        order = F.desc("ts") if newest_first else F.asc("ts")
        over = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        want = df.withColumn("y", over_of("x").over(over))
        got = running(df, ["k"], [order], F.col("x"), total, F.col("ts"), "y", newest_first=newest_first, own=own, slab_rows=slab)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert running(df.limit(0), ["k"], ["ts"], F.col("x"), total, F.col("ts"), "y", slab_rows=slab).count() == 0


def test_slabs_are_even_for_real_stamps(spark):
    """Milliseconds in the high bits, and most rows in a short time: a hot key still spreads."""
    r = random.Random(9)
    df = spark.createDataFrame([(r.choice([1_700_000_000_000, 1_700_000_000_000 + r.randrange(10**9)]) + r.randrange(2000) << 16 | r.randrange(9),) for _ in range(20_000)], "ts long")
    cuts = slab_cuts(df, F.col("ts"), 1000)
    sizes = [c["count"] for c in df.groupBy(slab_of(F.col("ts"), cuts).alias("s")).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3000


@pytest.mark.parametrize("slab", [50, 1 << 20])
def test_asof_rank_and_conflicts_over_slabs(spark, rows, slab):
    log = spark.createDataFrame([(k, t, 0, 1 + x % 2, {"x": x}) for k, t, x in rows], "k long, ts long, seq long, op int, v map<string, long>")
    probes = spark.createDataFrame([(k, t + 3 - x % 9) for k, t, x in rows] + [(99, 5), (0, -1)], "k long, at long")
    of = {k: [t for _, t, _ in h] for k, h in by_key(rows).items()}
    want = Counter((k, at, max((t for t in of.get(k, ()) if t <= at), default=None)) for k, at in map(tuple, probes.collect()))
    assert Counter((r.k, r["at"], r.ts) for r in versions.asof(probes, log, slab_rows=slab).collect()) == want
    ranks = {(r.k, r.ts): r.rn for r in versions.version_rank(log.drop("v"), slab).collect()}
    assert ranks == {(k, t): len(h) - i for k, h in of.items() for i, t in enumerate(h)}
    newer = {(r.k, r.ts): r.newer_ts for r in versions.version_order(log.drop("v"), slab).collect()}
    assert newer == {(k, t): h[i + 1] if i + 1 < len(h) else None for k, h in of.items() for i, t in enumerate(h)}
    history_of = spark.createDataFrame([(k, t, x % 3 == 0, x % 5) for k, t, x in rows], "k long, ts long, is_read boolean, value long")
    stale = set()
    for k, hist in by_key(rows).items():
        value = None
        for _, t, x in hist:
            if x % 3 == 0 and x % 5 != value:
                stale.add((k, t))
            value = x % 5 if x % 3 else value
    assert {(r.k, r.ts) for r in history.register_violations(history_of).collect()} == stale


@pytest.mark.parametrize("slab", [50, 1 << 20])
def test_clock_and_log_over_slabs(spark, rows, slab):
    df = spark.createDataFrame(rows, "node long, id long, ms long").withColumn("ms", F.col("ms") + F.floor(F.col("id") / 100))
    ms = {(k, t): x + t // 100 for k, t, x in rows}
    want, merged = {}, {}
    for k, hist in by_key(rows).items():
        wall, n, w, c = -1, 0, 0, 0
        for _, t, x in hist:
            n = n + 1 if ms[k, t] <= wall else 0
            wall = max(wall, ms[k, t])
            want[k, t] = (wall << 16) + n
            far, count = t // 90 + x % 4, x % 7
            top = max(w, far, ms[k, t])
            c = max(c, count) + 1 if top == w == far else c + 1 if top == w else count + 1 if top == far else 0
            w = top
        merged[k] = (w, c)
    assert {(r.node, r.id): r.hlc for r in clock.hlc_now(df, slab).collect()} == want
    received = df.select("node", "id", "ms", (F.floor(F.col("id") / 90) + (F.col("ms") - F.floor(F.col("id") / 100)) % 4).alias("remote_wall"), ((F.col("ms") - F.floor(F.col("id") / 100)) % 7).alias("remote_logical"))
    assert {r.node: (r.wall, r.logical) for r in clock.hlc_merge(received, slab).collect()} == merged
    log = spark.createDataFrame(rows, "node long, at long, idx long")
    kept = set()
    for k, hist in by_key(rows).items():
        cut = None
        for _, t, x in reversed(hist):
            if cut is None or x < cut:
                kept.add((k, t))
            cut = x if cut is None else min(cut, x)
    assert {(r.node, r.at) for r in quorum.truncate_append(log, slab).collect()} == kept


def test_stamps_carry_into_the_wall_part(spark):
    n = 70_000
    ticks = spark.range(n + 2).select(F.lit(0).cast("long").alias("node"), "id", F.when(F.col("id") < n, 1000).otherwise(1001).cast("long").alias("ms"))
    got = [r.hlc for r in clock.hlc_now(ticks, 9000).orderBy("id").collect()]
    assert got == list(range(1000 << 16, (1000 << 16) + n + 2))
    full = spark.createDataFrame([(0, 1, 10, 10, 65535), (0, 2, 10, 0, 0)], "node long, id long, ms long, remote_wall long, remote_logical long")
    assert [(r.wall, r.logical) for r in clock.hlc_merge(full).collect()] == [(11, 1)]
