"""The table on disk, streams into it, sources and SQL functions."""

import datetime
import json
import random
import struct

import pytest

from tidemark import functions, table
from tidemark.operators import txn, versions
from tidemark.schema import DELETE, PUT
from tidemark.sources import logs
from tidemark.streaming import commit_outcomes, into_table, windowed_counts
from tidemark.table import Closed, Conflict, Corrupt, VersionedTable


def test_put_get_delete_scan_compact_and_reopen(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.get(1) == (False, None)
    t.write_batch([(PUT, 1, "a"), (PUT, 2, "b"), (DELETE, 1, None), (PUT, 3, "")], ts=10)
    t.put(2, "c", ts=20)
    t.delete(3, ts=30)
    t.put(4, None, ts=40)
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert [t.get(k) for k in (1, 2, 3, 4)] == [(False, None), (True, "c"), (False, None), (True, None)]
    assert t.get(2, at=10) == (True, "b") and t.get(3, at=29) == (True, "")
    assert [r["k"] for r in t.scan(2, 4, at=20).collect()] == [2, 3]
    before = sorted(t.view().collect())
    old = t.view(at=35)
    t.compact(horizon=35)
    assert sorted(t.view().collect()) == before and sorted(t.view(at=35).collect()) == sorted(old.collect())
    assert t.log().count() == 2 and t.vacuum() == 0 and sorted(old.collect()) == sorted(t.view(at=35).collect())  # readers may still be at the old files
    assert t.vacuum(0) == 4 and t.vacuum(0) == 0
    assert sorted(t.view().collect()) == before and t.now() > 40
    t.close()
    with pytest.raises(Closed):
        t.get(1)


def test_files_are_pruned_by_key_and_time(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(5):
        t.write_batch([(PUT, 100 * i + j, f"v{i}.{j}") for j in range(10)], ts=10 * (i + 1))
    assert len(t.files()) == 5 and [f["lo"] for f in t.files(203, 203)] == [200] and [f["lo"] for f in t.files(5, 305, at=25)] == [0, 100]
    assert t.get(203) == (True, "v2.3") and t.get(203, at=29) == (False, None) and t.get(250) == (False, None)
    assert [r.k for r in t.scan(5, 102).collect()] == [5, 6, 7, 8, 9, 100, 101]
    t.compact(0)
    t.put(203, "new", ts=99)
    assert sorted(f["level"] for f in t.files(203, 203)) == [0, 1]
    far = {f["file"] for f in t.files() if f["level"] and not f["lo"] <= 203 <= f["hi"]}
    t.compact(100)  # only what the new key overlaps is rewritten
    assert t.get(203) == (True, "new") and t.get(9) == (True, "v0.9") and all(f["level"] == 1 for f in t.files()) and far <= {f["file"] for f in t.files()}
    wanted = spark.createDataFrame([(203,), (9,), (77,)], "k bigint")
    assert sorted(map(tuple, t.multi_get(wanted).collect())) == [(9, True, 10, "v0.9"), (77, False, None, None), (203, True, 99, "new")]


def test_compactions_and_commits_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t, other = VersionedTable(spark, path), VersionedTable(spark, path)
    for i in range(4):
        t.put(i, f"v{i}", ts=i + 1)
    write = VersionedTable._write

    def late(self, rows, level):
        """While one compaction writes, another one commits first, and so does a put."""
        monkeypatch.setattr(VersionedTable, "_write", write)
        done = write(self, rows, level)
        other.put(9, "during", ts=50)
        assert other.compact(5)
        return done

    monkeypatch.setattr(VersionedTable, "_write", late)
    with pytest.raises(Conflict):
        t.compact(5)
    assert sorted((r.k, r.value) for r in t.view().collect()) == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "v3"), (9, "during")] and t.log().count() == 5
    # a put that loses the race for a number takes the next
    publish = VersionedTable._publish

    def race(self, name, content):
        monkeypatch.setattr(VersionedTable, "_publish", publish)
        other.put(10, "first", ts=60)
        return publish(self, name, content)

    monkeypatch.setattr(VersionedTable, "_publish", race)
    t.put(10, "second", ts=61)
    assert t.get(10) == (True, "second") and t.get(10, at=60) == (True, "first") and t.log().count() == 7


def test_many_edits_snapshots_and_lost_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "SNAPSHOT_EVERY", 4)
    t = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(11):
        t.put(i % 3, f"v{i}", ts=i + 1)
    names = sorted(t._names("edits"))
    assert sum(n.endswith(".snapshot") for n in names) == 2 and VersionedTable(spark, t.path).state().edit == 11
    assert [t.get(k)[1] for k in range(3)] == ["v9", "v10", "v8"]
    t.compact(5)
    t.vacuum(0)
    assert sorted(t._names("edits"))[0].startswith("0" * 19 + "8") or sorted(t._names("edits"))[0].startswith("0" * 18 + "12")
    assert [t.get(k, at=5)[1] for k in range(3)] == ["v3", "v4", "v2"] and t.state().edit >= 12
    (tmp_path / "t" / "edits" / f"{t.state().edit + 2:020d}.edit").write_text("{}")
    with pytest.raises(Corrupt):
        t.state()


def test_batches_are_committed_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, 1, 0, PUT, "a"), (2, 1, 1, PUT, "b")], t.kinds)
    assert t.append(rows, stream="s", batch=0) and not t.append(rows, stream="s", batch=0) and t.append(rows.limit(0), stream="s", batch=1)
    assert not t.append(rows, stream="s", batch=1) and t.append(rows, stream="other", batch=0) and not t.append(rows.limit(0))
    assert t.log().count() == 4 and t.state().streams == {"s": 1, "other": 0}


def test_damaged_files_are_named(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.verify() == 0
    t.put(1, "a", ts=1)
    t.put(2, "b", ts=2)
    assert t.verify() == 2
    file = tmp_path / "t" / t.files(2, 2)[0]["file"]
    whole = file.read_bytes()
    (file.parent / f".{file.name}.crc").unlink()
    file.write_bytes(whole[:-6])  # the footer
    with pytest.raises(Corrupt):
        t.verify()
    file.write_bytes(whole)
    assert t.verify() == 2
    file.unlink()
    with pytest.raises(Corrupt):
        t.verify()


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    kind = "at timestamp, op int"
    source = str(tmp_path / "in")
    for part in ([(0, 1), (60, 1), (301, 2)], [(3000, 1)], [(10, 1), (2900, 2)]):
        at = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), op) for s, op in part]
        spark.createDataFrame(at, kind).coalesce(1).write.mode("append").parquet(source)
        q = windowed_counts(spark.readStream.schema(kind).parquet(source), "at").writeStream.format("parquet").outputMode("append")
        q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.window.start.minute, r.op, r.n) for r in got.collect()) == [(0, 1, 2), (5, 2, 1)]


def test_stream_into_table(spark, tmp_path):
    source = str(tmp_path / "in")
    kind = "k bigint, ts bigint, seq bigint, op int, value string"
    spark.createDataFrame([(1, 1, 0, PUT, "a"), (2, 1, 1, PUT, "b")], kind).write.parquet(source)
    t = VersionedTable(spark, str(tmp_path / "t"))
    for extra in ([], [(1, 2, 0, DELETE, None)]):
        if extra:
            spark.createDataFrame(extra, kind).write.mode("append").parquet(source)
        into_table(spark.readStream.schema(kind).parquet(source), t, str(tmp_path / "cp"), compact_every=2, keep=100).awaitTermination()
    assert [tuple(r) for r in t.view().collect()] == [(2, 1, "b")]


def test_sources_and_functions(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"ts": 1, "entries": [{"op": 1, "k": 5, "v": "x"}]}) + "\n")
    assert logs.read_batches(spark, str(tmp_path / "b.json")).first()["entries"][0]["v"] == "x"
    good = {"lsn": 1, "checksum": 0xE3069283, "payload": "123456789"}
    (tmp_path / "w.json").write_text(json.dumps(good) + "\n" + json.dumps(good | {"lsn": 2, "payload": "q"}) + "\n")
    assert [r["ok"] for r in logs.read_wal(spark, str(tmp_path / "w.json")).orderBy("lsn").collect()] == [True, False]
    functions.register(spark)
    assert tuple(spark.sql("select hlc_wall(65536 * 7 + 3), hlc_logical(65536 * 7 + 3), cache_shard(5, 6), ycsb_key(42)").first()) == (7, 3, 3, "user000000000042")
    assert spark.sql("select crc32c(cast('123456789' as binary))").first()[0] == 0xE3069283


def crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def log_file(records):
    """Bytes of a log, by the rules of its writer."""
    out = bytearray()
    for r in records:
        first, left = True, r
        while first or left:
            if 32768 - len(out) % 32768 < 7:
                out += bytes(32768 - len(out) % 32768)
            part = left[: 32768 - len(out) % 32768 - 7]
            left = left[len(part) :]
            kind = (2 if left else 1) if first else 3 if left else 4
            out += struct.pack("<IHB", crc(bytes([kind]) + part), len(part), kind) + part
            first = False
    return bytes(out)


def batch(*entries):
    return struct.pack("<I", len(entries)) + b"".join(struct.pack("<BI", op, len(k)) + k + struct.pack("<I", len(v)) + v for op, k, v in entries)


def test_binary_logs(spark, tmp_path):
    ten = [batch((PUT, b"key%d" % i, b"val")) for i in range(10)]
    whole = log_file(ten)
    (tmp_path / "clean.log").write_bytes(whole)
    (tmp_path / "cut.log").write_bytes(whole[:-10])
    last = bytearray(whole)
    last[-1] ^= 1
    (tmp_path / "flipped.log").write_bytes(bytes(last))
    five = log_file([batch((PUT, b"k" * 100, b"v" * 100))] * 5)
    mid = bytearray(five)
    mid[len(five) // 2] ^= 0xFF
    (tmp_path / "middle.log").write_bytes(bytes(mid))
    long = [b"A" * (32768 - 7 - 100), b"B" * 200, b"L" * 100_000, b"", b"C" * (32768 * 2)]
    (tmp_path / "long.log").write_bytes(log_file(long))
    (tmp_path / "empty.log").write_bytes(b"")
    got = {}
    for r in logs.read_log_files(spark, f"{tmp_path}/*.log").orderBy("pos").collect():
        got.setdefault(r.file.split("/")[-1][:-4], []).append(bytes(r.payload))
    assert {k: len(v) for k, v in got.items()} == {"clean": 10, "cut": 9, "flipped": 9, "middle": 2, "long": 5}
    assert got["clean"] == ten and got["long"] == long
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.log").write_bytes(log_file([batch((PUT, b"k1", b"a"), (PUT, b"k2", b"")), batch((DELETE, b"k1", b"")), b"no batch", batch((PUT, b"k2", b"b"))]))
    found = logs.recover(spark, f"{tmp_path}/r/*.log")
    assert [(bytes(r.k), r.op, r.v and bytes(r.v)) for r in found.orderBy("ts", "seq").collect()] == [(b"k1", PUT, b"a"), (b"k2", PUT, None), (b"k1", DELETE, None), (b"k2", PUT, b"b")]
    assert [(bytes(r.k), bytes(r.v)) for r in versions.latest_view(found.drop("file")).collect()] == [(b"k2", b"b")]


def test_outcomes_of_a_stream(spark, tmp_path):
    r = random.Random(5)
    rows = [(t, r.randrange(6), 10 * t - r.randrange(60), 10 * t) for t in range(200)]
    kind, source = "txn long, k long, snap long, req long", str(tmp_path / "in")
    for i in range(3):
        part = rows[i * 200 // 3 : (i + 1) * 200 // 3]
        spark.createDataFrame(part, kind).write.mode("append").parquet(source)
        q = commit_outcomes(spark.readStream.schema(kind).parquet(source)).writeStream.format("parquet").outputMode("append")
        q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {x.txn: x.committed for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {x.txn: x.committed for x in txn.commit_outcomes(spark.createDataFrame(rows, kind)).collect()}
    assert got == want and 0 < sum(want.values()) < 200
