"""Versioned reads, garbage collection and merges against a dictionary model, and edge cases."""

import hashlib
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bloom, clock, gc, history, lsm, quorum, txn, versions, wal
from tidemark.operators.graph import components
from tidemark.schema import DELETE, PUT

KIND = "k bigint, ts bigint, seq bigint, op int, v string"


def live(df, *cols):
    return sorted(tuple(r[c] for c in cols or ("k", "v")) for r in df.collect())


def model(rows, at):
    state = {}
    for k, ts, seq, op, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if ts <= at:
            state[k] = (op, v)
    return sorted((k, v) for k, (op, v) in state.items() if op == PUT)


def log(n=300, seed=1):
    r = random.Random(seed)
    return [(r.randrange(20), ts // 3, ts % 3, r.choice([PUT, PUT, DELETE]), r.choice([None, "", f"v{ts}"])) for ts in range(n)]


def by_value(rows):
    return sorted(rows, key=repr)


def test_snapshots_and_gc_agree_with_a_dictionary(spark):
    rows = log()
    df = spark.createDataFrame(rows, KIND).cache()
    for at in (-1, 0, 17, 50, 99, 1000):
        assert by_value(versions.snapshot_read(df, at).select("k", "v").collect()) == by_value(model(rows, at))
    for horizon in (0, 40, 80, 200):
        kept = gc.mvcc_gc(df, horizon)
        for at in (horizon, horizon + 7, 1000):
            assert by_value(versions.snapshot_read(kept, at).select("k", "v").collect()) == by_value(model(rows, at))
        assert gc.mvcc_gc(kept, horizon).count() == kept.count()


def test_null_empty_and_deleted_values_differ(spark):
    df = spark.createDataFrame([(1, 1, 0, PUT, None), (2, 1, 0, PUT, ""), (3, 1, 0, PUT, "x"), (3, 2, 0, DELETE, None), (4, 1, 0, DELETE, None)], KIND)
    assert live(versions.latest_view(df)) == [(1, None), (2, "")]
    wanted = spark.createDataFrame([(1,), (3,), (4,), (9,)], "k bigint")
    assert live(versions.multi_get(df, wanted), "k", "found") == [(1, True), (3, False), (4, False), (9, False)]
    assert live(versions.contains_any_version(df, wanted), "k") == [(1,), (3,), (4,)]


def test_batch_order_and_deletes_last(spark):
    b = spark.createDataFrame([(1, [(PUT, 1, "a"), (DELETE, 1, None), (PUT, 1, "b")])], "ts bigint, entries array<struct<op:int,k:bigint,v:string>>")
    assert live(versions.latest_view(versions.batch_log(b))) == [(1, "b")]
    assert live(versions.latest_view(versions.batch_log(b, deletes_last=True))) == []


def test_seek_lower_bound(spark):
    keys = spark.createDataFrame([(1,), (3,), (5,), (900,), (3,), (None,)], "k bigint")
    t = spark.createDataFrame([(-500,), (2,), (3,), (4,), (6,), (700,), (901,), (3,)], "k bigint")
    for rows in (1 << 20, 2):
        assert live(versions.seek_lower_bound(keys, t, rows), "target", "k") == [(-500, 1), (2, 3), (3, 3), (4, 5), (6, 900), (700, 900), (901, None)]
    far = spark.createDataFrame([(0,), (10**12,), (-(10**15),)], "k bigint")
    assert live(versions.seek_lower_bound(far, far.union(spark.createDataFrame([(1,)], "k bigint"))), "target", "k") == [(-(10**15), -(10**15)), (0, 0), (1, 10**12), (10**12, 10**12)]
    assert live(versions.seek_lower_bound(keys.limit(0), t), "k") == [(None,)] * 7


def test_tiers_newest_wins(spark):
    new = spark.createDataFrame([(1, 9, 0, DELETE, None)], KIND)
    old = spark.createDataFrame([(1, 5, 0, PUT, "a"), (2, 5, 0, PUT, "b")], KIND)
    wanted = spark.createDataFrame([(1,), (2,)], "k bigint")
    assert live(versions.tiered_get([new, old], wanted), "k", "found") == [(1, False), (2, True)]
    assert live(versions.tiered_merge([new, old]), "k", "idx", "op") == [(1, 0, DELETE), (2, 1, PUT)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert versions.latest_view(none).count() == gc.mvcc_gc(none, 5).count() == versions.shadowed(none).count() == 0


def test_picking_needs_more_than_four_files(spark):
    kind = "level bigint, file_num bigint, lo bigint, hi bigint, n bigint, size bigint"
    four = [(0, i, 10 * i, 10 * i + 5, 1, 1) for i in range(4)]
    below = [(1, 50, 0, 3, 1, 1), (1, 51, 100, 200, 1, 1)]
    assert lsm.compaction_pick(spark.createDataFrame(four + below, kind)).count() == 0
    five = [*four, (0, 4, 40, 45, 1, 1)]
    assert live(lsm.compaction_pick(spark.createDataFrame(five + below, kind)), "file_num", "role") == [*((i, "input") for i in range(5)), (50, "overlap")]


def test_keys_and_clocks(spark):
    df = spark.createDataFrame([(b"a", 5), (b"", 0), (b"a", 6)], "k binary, ts bigint").select("k", "ts", clock.encode_key(F.col("k"), F.col("ts")).alias("e"))
    rows = df.select("k", "ts", "e", clock.decode_key(F.col("e")).alias("d")).collect()
    assert all((bytes(r.d.key), r.d.ts) == (bytes(r.k), r.ts) for r in rows)
    e = {(bytes(r.k), r.ts): bytes(r.e) for r in rows}
    assert e[b"a", 6] < e[b"a", 5]  # newest first
    ticks = spark.createDataFrame([(0, 1, 100), (0, 2, 100), (0, 3, 90), (0, 4, 101)], "node bigint, id bigint, ms bigint")
    assert [r.hlc for r in clock.hlc_now(ticks).orderBy("id").collect()] == [100 << 16, (100 << 16) + 1, (100 << 16) + 2, 101 << 16]


@pytest.mark.parametrize("inline", [1 << 20, 0])  # as a constant, and by bucket
def test_bloom_rates(spark, monkeypatch, inline):
    monkeypatch.setattr(bloom, "INLINE_BYTES", inline)
    keys = spark.range(100_000).select(F.concat(F.lit("key-"), "id").alias("k"))
    held = bloom.build(keys, [], "k")
    assert held.agg(F.max("m")).first()[0] == 1_000_000
    assert bloom.probe(keys, "k", held).where("not maybe").count() == 0
    other = spark.range(100_000).select(F.concat(F.lit("nonexistent-"), "id").alias("k"))
    assert 400 < bloom.probe(other, "k", held).where("maybe").count() < 1500  # 0.9 % at ten bits a key
    assert bloom.probe(keys.limit(9), "k", held.limit(0)).where("maybe").count() == 0
    assert bloom.probe(keys.limit(0), "k", held).count() == 0


def test_bloom_groups_and_codec(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), "id").union(spark.createDataFrame([(7, 1), (7, 1), (8, None)], "g long, id long"))
    sizes = {r.g: (r.m, r.set_bits) for r in bloom.set_bits(bloom.build(rows, ["g"], "id"), ["g"]).collect()}
    assert {g: m for g, (m, _) in sizes.items()} == {0: 10_000, 1: 10_000, 2: 10_000, 7: 64} and sizes[7][1] <= 6 and all(3500 < sizes[g][1] < 5500 for g in range(3))
    one = rows.where("g = 1")
    data = bloom.encode(bloom.build(one, [], "id"))
    k, bits = bloom.decode(data)
    assert k == 6 and len(bits) == 1250 and bloom.decode(b"") == (0, b"")
    asked = spark.range(20_000).select("id", bloom.may_contain(F.lit(data), F.col("id")).alias("maybe"), bloom.may_contain(F.lit(b""), F.col("id")).alias("none"))
    got = {r.id for r in asked.where("maybe").collect()}
    assert set(range(1, 3000, 3)) <= got and len(got) < 1500 and asked.where("none").count() == 0
    # as a plain loop over the digest
    for x in (1, 2, 5000):
        d = hashlib.md5(str(x).encode()).hexdigest()
        at = [((int(d[:8], 16) + i * int(d[8:16], 16)) & 0xFFFFFFFF) % 10_000 for i in range(6)]
        assert all(bits[i // 8] >> i % 8 & 1 for i in at) == (x in got)


def test_batch_codec(spark):
    kind = "id int, entries array<struct<op:int,k:binary,v:binary>>"
    rows = [(1, [(PUT, b"key", b"val"), (DELETE, b"k2", None), (PUT, b"", b"x" * 300)]), (2, []), (3, [(PUT, b"a", b"")])]
    df = spark.createDataFrame(rows, kind).select("id", "entries", versions.encode_batch(F.col("entries")).alias("data"))
    plain = {r[0]: struct.pack("<I", len(r[1])) + b"".join(struct.pack("<BI", op, len(k)) + k + struct.pack("<I", len(v or b"")) + (v or b"") for op, k, v in r[1]) for r in rows}
    got = {r.id: r for r in df.select("id", "data", versions.decode_batch(F.col("data")).alias("back")).collect()}
    assert {i: bytes(r.data) for i, r in got.items()} == plain
    for i, entries in rows:
        assert [(e.op, bytes(e.k), None if e.v is None else bytes(e.v)) for e in got[i].back] == [(op, k, v or None) for op, k, v in entries]
    broken = [plain[1][:-1], plain[1][:9], b"\x01", b"", struct.pack("<I", 1 << 30), plain[3] + b"tail"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(broken)], "id int, data binary")
    assert [r.n for r in df.select("id", F.size(versions.decode_batch(F.col("data"))).alias("n"), versions.decode_batch(F.col("data")).isNull().alias("bad")).orderBy("id").collect()] == [None, None, None, None, None, 1]


def test_merge_keeps_every_version(spark):
    new = spark.createDataFrame([(1, 9, 0, DELETE, None), (1, 5, 0, PUT, "newer")], KIND)
    old = spark.createDataFrame([(1, 5, 0, PUT, "a"), (1, 5, 1, PUT, "c"), (2, 5, 0, PUT, "b"), (None, 1, 0, PUT, "n")], KIND)
    got = versions.merge_versions([new, old]).select("k", "ts", "seq", "idx", "op", "v").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 9, 0, 0, DELETE, None), (1, 5, 0, 0, PUT, "newer"), (1, 5, 1, 1, PUT, "c"), (2, 5, 0, 1, PUT, "b"), (None, 1, 0, 1, PUT, "n")]))


def test_overlap_of_wide_and_narrow_files(spark):
    r = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            lo = r.choice([r.randrange(-500, 500), r.randrange(-(10**12), 10**12)])
            out.append((i, lo, lo + r.choice([0, 1, 7, 100, 4095, 4096, 10**9, 10**12])))
        return out

    a, b = some(60), some(70)
    left, right = (spark.createDataFrame(x, "file_num long, lo long, hi long") for x in (a, b))
    got = live(lsm.file_overlap(left, right), "file_num_a", "file_num_b")
    assert got == sorted((i, j) for i, lo, hi in a for j, lo2, hi2 in b if hi >= lo2 and lo <= hi2) and len(got) > 300
    keys = spark.createDataFrame([(k,) for k in (0, -1, 5, 10**12, -(10**12), a[0][1], a[1][2])], "k long")
    assert live(lsm.level_probe(keys, left), "k", "file_num") == sorted((k.k, i) for k in keys.collect() for i, lo, hi in a if lo <= k.k <= hi)
    assert lsm.file_overlap(left.limit(0), right).count() == lsm.file_overlap(left, right.limit(0)).count() == lsm.level_probe(keys, left.limit(0)).count() == 0


def test_files_are_counted_without_pairs(spark):
    """4,000 keys and 3,000 files that hold nearly all of them: 12 million pairs, none of which is made."""
    r = random.Random(6)
    small = [(r.choice([0, 1, None, 5]), lo, lo + r.choice([-1, 0, 3, 40])) for lo in (r.randrange(-60, 60) for _ in range(80))]
    asked = [r.randrange(-70, 110) for _ in range(150)] + [3, 3, 3, None, small[0][1]]
    keys, files = spark.createDataFrame([(k,) for k in asked], "k long"), spark.createDataFrame(small + [(1, None, None)], "level long, lo long, hi long")
    want = Counter((k, level) for k in asked if k is not None for level, lo, hi in small if lo <= k <= hi)
    for slab_rows in (7, 1 << 19):
        got = lsm.level_counts(keys, files, slab_rows)
        assert {(x.k, x.level): x.files for x in got.collect()} == want and got.count() == len(want)
    assert lsm.level_counts(keys, files.limit(0)).count() == lsm.level_counts(keys.limit(0), files).count() == 0
    keys, files = spark.range(4000).withColumnRenamed("id", "k"), spark.range(3000).selectExpr("id % 3 as level", "-id as lo", "3999 + id as hi")
    plan = lsm.level_counts(keys, files, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("Join") == plan.count("BroadcastHashJoin")  # only the totals of slabs
    assert {tuple(x) for x in lsm.level_counts(keys, files, 1000).groupBy("level", "files").count().collect()} == {(i, 1000, 4000) for i in range(3)}


def test_overlaps_are_counted_without_pairs(spark):
    r = random.Random(7)
    a, b = ([(r.choice([i, 5, None]), lo, lo + r.choice([-1, 0, 3, 40])) for i, lo in enumerate(r.randrange(-60, 60) for _ in range(n))] for n in (70, 90))
    left, right = (spark.createDataFrame([*x, (1, None, None)], "file_num long, lo long, hi long") for x in (a, b))
    want = Counter(i for i, lo, hi in a for _, lo2, hi2 in b if lo <= hi and lo2 <= hi2 and hi >= lo2 and lo <= hi2)
    for slab_rows in (9, 1 << 22):
        got = lsm.overlap_counts(left, right, slab_rows)
        assert {x.file_num: x.overlaps for x in got.collect()} == want and got.count() == len(want)
    assert lsm.overlap_counts(left, right.limit(0)).count() == lsm.overlap_counts(left.limit(0), right).count() == 0
    wide = spark.range(3000).selectExpr("id as file_num", "-id as lo", "id as hi")  # nine million pairs
    plan = lsm.overlap_counts(wide, wide)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and {x.overlaps for x in lsm.overlap_counts(wide, wide).collect()} == {3000}


def test_reads_go_by_level(spark):
    files = [(0, 1, 0, 9), (0, 2, 5, 9), (1, 3, 0, 4), (1, 4, 5, 9), (2, 5, 0, 9)]
    rows = [(6, 0, 1, PUT, "old"), (6, 0, 2, PUT, "new"), (3, 1, 3, DELETE, None), (3, 2, 5, PUT, "hidden"), (7, 2, 5, PUT, "deep"), (8, 1, 3, PUT, "outside its file")]
    got = lsm.level_get(spark.createDataFrame([(k,) for k in (6, 3, 7, 8, 99)], "k long"), spark.createDataFrame(rows, "k long, level long, file_num long, op int, v string"), spark.createDataFrame(files, "level long, file_num long, lo long, hi long"))
    assert live(got, "k", "found", "v") == [(3, False, None), (6, True, "new"), (7, True, "deep"), (8, False, None), (99, False, None)]


def test_reads_of_many_keys_deal_a_log_twice(spark, monkeypatch):
    log = spark.range(3000).selectExpr("id % 700 as k", "id % 3 as level", "id % 11 as file_num", "cast(1 + id % 2 as int) as op", "id as v")
    files = log.groupBy("level", "file_num").agg(F.min("k").alias("lo"), (F.max("k") - 20).alias("hi"))
    wanted = spark.range(0, 900, 2).withColumnRenamed("id", "k")
    few = [tuple(x) for x in lsm.level_get(wanted, log, files).select("k", "found", "level", "file_num").collect()]
    monkeypatch.setattr(lsm, "FEW_KEYS_BYTES", -1)
    dealt = log.repartition("level", "file_num")
    many = lsm.level_get(wanted, dealt, files)
    assert sorted(repr(tuple(x)) for x in many.select("k", "found", "level", "file_num").collect()) == sorted(map(repr, few)) and len(few) == 450
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lsm.level_get(wanted, dealt, files)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "LeftSemi" not in plan and plan.count("Exchange hashpartitioning") <= 5  # two of the log, two of the files, one of the keys


def test_later_edits_of_the_manifest_win(spark):
    edits = [(1, "add", 1, 7, 0), (2, "delete", 1, 7, 0), (3, "add", 1, 7, 5), (1, "add", 2, 7, 1), (4, "delete", 2, 7, 1), (1, "add", 0, 9, 3)]
    df = spark.createDataFrame(edits, "edit_no long, action string, level long, file_num long, lo long")
    assert live(lsm.manifest_state(df), "level", "file_num", "lo") == [(0, 9, 3), (1, 7, 5)]


def test_append_entries(spark):
    log = [(n, i, t, f"{n}.{i}") for n in (1, 2, 3, 4) for i, t in ((1, 1), (2, 1), (3, 2))]
    state = [(n, 2, 1) for n in (1, 2, 3, 4, 5)]
    asked = [(1, 2, 2, 1, 9, [(3, "x")]), (2, 1, 3, 2, 9, [(3, "x")]), (3, 4, 3, 1, 9, [(4, "x")]), (4, 3, 3, 2, 3, []), (5, 2, 0, 0, 1, [(2, "a"), (2, "b")])]
    answers, after = quorum.append_entries(
        spark.createDataFrame(log, "node long, idx long, term long, data string"),
        spark.createDataFrame(state, "node long, term long, commit long"),
        spark.createDataFrame(asked, "node long, term long, prev_idx long, prev_term long, leader_commit long, entries array<struct<term: bigint, data: string>>"),
    )
    assert live(answers, "node", "term", "success", "commit") == [(1, 2, True, 3), (2, 2, False, 1), (3, 4, False, 1), (4, 3, True, 3), (5, 2, True, 1)]
    of = {}
    for n, i, t, d in live(after, "node", "idx", "term", "data"):
        of.setdefault(n, []).append((i, t, d))
    assert of[1] == [(1, 1, "1.1"), (2, 1, "1.2"), (3, 3, "x")] and of[5] == [(1, 2, "a"), (2, 2, "b")] and [len(of[n]) for n in (2, 3, 4)] == [3, 3, 3]


def test_crc32c(spark):
    known = {b"123456789": 0xE3069283, b"": 0, bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, bytes(range(32)): 0x46DD794E}
    df = spark.createDataFrame([(k,) for k in known] + [(None,)], "b binary").repartition(3)
    got = {None if r.b is None else bytes(r.b): r.c for r in df.select("b", wal.crc32c("b").alias("c")).collect()}
    assert got == known | {None: None}


def test_fragments_and_reassembly(spark):
    r = random.Random(3)
    # one that leaves less than a header, one that fills a block, one that leaves exactly a header, long, empty, null
    sizes = [32768 - 7 - 100, 200, 32768 - 2 * 7 - 107 - 7, 32761, 0, 98_290, 100_000, 990, 32768 - 7 - 3, 5]
    payloads = [bytes(r.randrange(256) for _ in range(min(n, 50))) * (n // min(n, 50)) + b"t" * (n % min(n, 50)) if n else b"" for n in sizes]
    rows = [(k, i, p) for k in (1, 2) for i, p in enumerate(payloads)] + [(3, 0, b"only"), (4, 0, None)]
    df = spark.createDataFrame(rows, "k long, ts long, payload binary")
    pieces = wal.cut_payloads(df).cache()
    # by the bytes of a file
    at, want = 0, []
    for p in payloads:
        first, left = True, p
        while first or left:
            if 32768 - at % 32768 < 7:
                at += 32768 - at % 32768
            n = min(len(left), 32768 - at % 32768 - 7)
            want.append((at, (1 if n == len(left) else 2) if first else 4 if n == len(left) else 3, n))
            at, left, first = at + 7 + n, left[n:], False
    got = [(x.pos, x.kind, len(x.payload)) for x in pieces.where("k = 1").orderBy("pos").collect()]
    assert got == want and {kind for _, kind, _ in want} == {1, 2, 3, 4}
    back = {}
    for x in wal.reassemble(pieces).orderBy("pos").collect():
        back.setdefault(x.k, []).append(bytes(x.payload))
    assert back == {1: payloads, 2: payloads, 3: [b"only"], 4: [b""]}

    def read(broken):
        return [bytes(x.payload) for x in wal.reassemble(broken.where("k = 1"), slab_rows=3).orderBy("pos").collect()]

    mid = [p for p, kind, _ in want if kind == 3][0]
    kept = payloads[: sizes.index(98_290)]
    flipped = F.when(F.col("pos") == mid, F.concat(F.unhex(F.lit("00")), F.expr("substring(payload, 2)"))).otherwise(F.col("payload"))
    assert read(pieces.withColumn("payload", flipped)) == kept  # a damaged byte
    assert read(pieces.where((F.col("pos") < mid) | (F.col("kind") != 4))) == kept  # a record begins within another
    last = want[-1][0]
    assert read(pieces.where(F.col("pos") != last)) == payloads[:-1]
    assert read(pieces.where("kind in (3, 4)")) == [] and read(pieces.limit(0)) == []
    assert read(pieces.withColumn("crc", F.when(F.col("pos") != last, F.col("crc")))) == payloads[:-1]  # no checksum


def test_logs_are_cut_and_read_in_one_pass(spark):
    r = random.Random(8)
    rows = [(k, ts, None if ts == 7 else r.randbytes(r.choice([0, 1, 3, 60, 900, 33_000, 70_000])), (k or 0) * 100 + ts) for k in [1, 2, None] for ts in range(30)]
    made = spark.createDataFrame(rows, "k bigint, ts bigint, payload binary, tag bigint").repartition(5)
    pieces = wal.cut_payloads(made).cache()
    at = {(x.k, x.ts, x.kind, x.block * wal.BLOCK_BYTES + x.offset, x.length) for x in wal.fragments(made.select("k", "ts", F.octet_length("payload").cast("long").alias("bytes"))).collect()}
    assert {(x.k, x.tag % 100, x.kind, x.pos, len(x.payload)) for x in pieces.collect()} == at and len(at) == pieces.count()
    broken = pieces.withColumn("crc", F.expr("if(k = 1 and tag = 112 and kind in (1, 2), crc ^ 1, crc)"))
    want = sorted((k or 0, bytes(p or b"")) for k, ts, p, _ in rows if k != 1 or ts < 12)
    one = wal.reassemble(broken)
    assert sorted((x.k or 0, bytes(x.payload)) for x in one.collect()) == want
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "HashAggregate" not in plan
    slabs = wal.reassemble(broken.where("k > 0"), slab_rows=5)  # longer logs than that
    assert sorted((x.k, bytes(x.payload)) for x in slabs.collect()) == [x for x in want if x[0]]
    assert "Window" in slabs._jdf.queryExecution().executedPlan().toString()
    most = made.groupBy("k").agg(F.sum(wal.most_pieces(F.octet_length("payload"))).alias("n"))
    assert all(x.n >= x["count"] for x in most.join(pieces.groupBy("k").count(), "k").collect())


def test_checksums_of_all_short_lengths(spark):
    def slow(x):
        c = 0xFFFFFFFF
        for b in x:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ 0x82F63B78 if c & 1 else c >> 1
        return c ^ 0xFFFFFFFF

    r = random.Random(9)
    rows = [(bytearray(r.randbytes(n)),) for n in [*range(200), 1000, 4097]] + [(None,)]
    got = {None if x.b is None else bytes(x.b): x.c for x in spark.createDataFrame(rows, "b binary").select("b", wal.crc32c("b").alias("c")).collect()}
    assert got == {None if b is None else bytes(b): None if b is None else slow(b) for (b,) in rows}


def test_replay_stops_at_the_first_bad_record(spark):
    df = spark.createDataFrame([(1, i, i != 2) for i in range(5)] + [(2, 0, True)], "k bigint, ts bigint, ok boolean")
    assert live(wal.replay(df, ~F.col("ok")), "k", "ts") == [(1, 0), (1, 1), (2, 0)]


def test_multi_key_transactions(spark):
    t = spark.createDataFrame([(1, ["a", "b"], 0, 10), (2, ["b", "c"], 5, 11), (3, ["c"], 5, 12), (4, ["z"], 0, 1)], "txn bigint, keys array<string>, snap bigint, req bigint")
    assert live(txn.multi_key_outcomes(t), "txn", "committed") == [(1, True), (2, False), (3, True), (4, True)]


def test_transactions_without_keys_snapshots_or_that_abort(spark):
    t = spark.createDataFrame([(1, ["a", "b"], 0, 10, False), (2, ["b", "b"], 5, 11, False), (3, None, 5, 12, False), (4, [], 0, 1, False), (5, ["a"], 20, 30, True), (6, ["a"], 25, 31, False), (7, ["q"], None, 40, False), (8, ["q"], None, 41, False)], "txn bigint, keys array<string>, snap bigint, req bigint, aborted boolean")
    assert live(txn.multi_key_outcomes(t), "txn", "committed") == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (7, True), (8, False)]
    one = spark.createDataFrame([(1, 0, None, 5), (2, 0, None, 6), (3, 0, 5, 9)], "txn bigint, k bigint, snap bigint, req bigint")
    assert live(txn.commit_outcomes(one), "txn", "committed") == [(1, True), (2, False), (3, True)]
    spans = spark.createDataFrame([(1, 0, 10), (2, 5, 6), (3, 6, 20)], "txn bigint, snap bigint, req bigint")
    assert live(txn.active_transactions(spans), "at", "active") == [(0, 1), (5, 2), (6, 2), (10, 1), (20, 0)]


def test_snapshot_isolation_permits_write_skew(spark):
    """Both read x and y at 0; one writes x, the other y: both commit.  Writing the same key, one does."""
    skew = spark.createDataFrame([(1, ["x"], 0, 10), (2, ["y"], 0, 11)], "txn bigint, keys array<string>, snap bigint, req bigint")
    assert live(txn.multi_key_outcomes(skew), "txn", "committed") == [(1, True), (2, True)]
    lost = spark.createDataFrame([(1, ["x"], 0, 10), (2, ["x"], 0, 11), (3, ["x"], 10, 12)], "txn bigint, keys array<string>, snap bigint, req bigint")
    assert live(txn.multi_key_outcomes(lost), "txn", "committed") == [(1, True), (2, False), (3, True)]
    # repeated and dirty reads: a snapshot's view never changes, whatever is written after it
    before = spark.createDataFrame([(1, 5, 0, PUT, "a")], KIND)
    after = before.union(spark.createDataFrame([(1, 9, 0, PUT, "b"), (2, 9, 0, PUT, "c")], KIND))
    assert live(versions.snapshot_read(before, 7)) == live(versions.snapshot_read(after, 7)) == [(1, "a")]


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (7000, 7000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(401)} | {i: 1000 for i in range(1000, 1300)} | {7000: 7000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linearizable_histories(spark):
    kind = "k bigint, client int, is_read boolean, value string, call bigint, ret bigint"
    good = [(1, 0, False, "a", 0, 10), (1, 1, True, "a", 5, 12), (1, 1, True, "a", 13, 14)]
    bad = [(2, 0, False, "a", 0, 1), (2, 0, False, "b", 2, 3), (2, 1, True, "a", 4, 5)]
    assert live(history.linearizable(spark.createDataFrame(good + bad, kind)), "k", "ok") == [(1, True), (2, False)]


def test_many_short_histories(spark):
    """Histories that straddle batches of rows, in one task and no frame for each."""
    own = "id div 3 as k, cast(id % 3 as int) as client, id % 3 = 2 as is_read, if(id % 3 = 2 and id div 3 % 4 > 0, '1', cast(id % 3 as string)) as value, id * 10 as call, id * 10 + 5 as ret"
    rows = spark.sql(f"select {own} from range(0, 90000, 1, 7)")
    got = history.linearizable(rows.orderBy(F.desc("call")))
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.k % 4 > 0, r.ok) for r in got.collect()} == {(True, True), (False, False)} and got.count() == 30_000
    kind = "k bigint, client int, is_read boolean, value string, call bigint, ret bigint"
    odd = [(None, 0, False, "a", 0, 1), (1, 0, True, None, 0, 1), (2, 0, False, "a", None, None), (3, 0, False, "a", 5, 9), (3, 0, True, None, 0, 5), (4, 0, False, "a", 6, 9), (4, 0, True, "a", 0, 5)]
    assert {r.k: r.ok for r in history.linearizable(spark.createDataFrame(odd, kind)).collect()} == {None: True, 1: True, 2: False, 3: True, 4: False}
    assert history.linearizable(spark.createDataFrame([], kind)).count() == 0


def test_truncating_appends(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 2)], "node bigint, at bigint, idx bigint")
    assert live(quorum.truncate_append(rows), "at", "idx") == [(1, 1), (4, 2)]
