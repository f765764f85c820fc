"""A versioned table on disk: immutable Parquet files and a log of numbered edits.

A commit writes one segment (a folder of Parquet files) and then publishes one edit, a small file
with the next number.  Publishing fails if that number is taken, so commits are in one order: who
comes second reads what came before, checks that its own edit still makes sense, and tries the
number after.  Every file stands in the edits with its level and the bounds of its keys and
timestamps.  Readers take the live files when they plan, and only those whose bounds a read can
touch, and so keep a consistent snapshot whatever is committed or compacted later (rows W1-W3, W12,
W13, C2, C5, R11, R21).

Every `SNAPSHOT_EVERY` edits the live list is written whole, so opening reads one snapshot and the few
edits after it.  Compaction merges level 0 with what its keys overlap in level 1; `vacuum` deletes
files that have not been live for a while."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import gc, versions
from tidemark.schema import DELETE, PUT

SNAPSHOT_EVERY = 50


class Closed(RuntimeError):
    """The table was closed."""


class Conflict(RuntimeError):
    """Another commit made this one impossible."""


class Corrupt(RuntimeError):
    """An edit or a file is not what was written."""


@dataclass
class State:
    """What the edits up to a number come to."""

    edit: int = 0
    live: dict[str, dict] = field(default_factory=dict)  # file -> level, bounds, rows
    gone: dict[str, int] = field(default_factory=dict)  # file -> when it ceased to be live, in ms
    streams: dict[str, int] = field(default_factory=dict)  # stream -> its last batch
    top: int = 0  # the highest timestamp ever committed

    def apply(self, edit: dict) -> None:
        self.edit = edit["edit"]
        for f in edit["delete"]:
            self.live.pop(f, None)
            self.gone[f] = edit["at"]
        for f in edit["add"]:
            self.live[f["file"]] = f
            self.gone.pop(f["file"], None)
            self.top = max(self.top, f["hi_ts"])
        for f in edit.get("vacuumed", ()):
            self.gone.pop(f, None)
        if edit.get("stream"):
            self.streams[edit["stream"]] = edit["batch"]


class VersionedTable:
    """put, delete, write_batch, get, scan, snapshot, compact over (k, ts, seq, op, value).

    Keys are integers or strings."""

    def __init__(self, spark: SparkSession, path: str, key: str = "bigint", value: str = "string") -> None:
        self.spark, self.path, self.open_ = spark, path.rstrip("/"), True
        self.kinds = f"k {key}, ts bigint, seq bigint, op int, value {value}"

    # ---------------------------------------------------------------- edits

    def _at(self, what: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}" if what else self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _read(self, name: str) -> dict:
        stream = self._fs().open(self._at(f"edits/{name}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        except ValueError as e:
            raise Corrupt(f"{self.path}/edits/{name}") from e
        finally:
            stream.close()

    def _publish(self, name: str, content: dict) -> bool:
        """Writes a file whole or not at all; False if the name is taken."""
        fs, jvm = self._fs(), self.spark._jvm
        temporary, final = self._at(f"edits/.{uuid.uuid4().hex}"), self._at(f"edits/{name}")
        if fs.exists(final):
            return False
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(self._at()).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(temporary), fs.makeQualified(final), none)
        except Exception:  # taken in between: the loser reads what came first
            if not fs.exists(final):
                raise
            fs.delete(temporary, False)
            return False
        return True

    def state(self) -> State:
        """The newest snapshot of the edits and what follows it."""
        names = self._names("edits")
        snapshots = sorted(n for n in names if n.endswith(".snapshot"))
        state = State(**self._read(snapshots[-1])) if snapshots else State()
        for n in sorted(n for n in names if n.endswith(".edit")):
            if int(n[:-5]) > state.edit:
                if int(n[:-5]) != state.edit + 1:
                    raise Corrupt(f"{self.path}: edit {state.edit + 1} is missing")
                state.apply(self._read(n))
        return state

    def _commit(self, add: list[dict], delete: list[str], **more) -> bool:
        """Publishes an edit after all others.  False if it is a stream's batch that is in already;
        Conflict if a file to delete is no longer live."""
        while True:
            state = self.state()
            if more.get("stream") and state.streams.get(more["stream"], -1) >= more["batch"]:
                return False
            lost = [f for f in delete if f not in state.live]
            if lost:
                raise Conflict(f"{lost[0]} is no longer live")
            edit = {"edit": state.edit + 1, "at": int(time.time() * 1000), "add": add, "delete": delete} | more
            if self._publish(f"{edit['edit']:020d}.edit", edit):
                if edit["edit"] % SNAPSHOT_EVERY == 0:
                    state.apply(edit)
                    self._publish(f"{edit['edit']:020d}.snapshot", vars(state))
                return True

    def _check(self) -> None:
        if not self.open_:
            raise Closed(self.path)

    def _write(self, rows: DataFrame, level: int) -> list[dict]:
        """A segment, and what the edits say of each of its files (a row a file on the driver)."""
        name = f"seg-{uuid.uuid4().hex}"
        out = rows.select("k", "ts", "seq", "op", "value")
        out = out.repartitionByRange("k") if level else out
        out.sortWithinPartitions("k", F.desc("ts"), F.desc("seq")).write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(self.kinds).parquet(f"{self.path}/{name}")
        stats = written.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("k"), F.max("k"), F.min("ts"), F.max("ts"), F.count(F.lit(1)))
        return [{"file": f"{name}/{f}", "level": level, "lo": lo, "hi": hi, "lo_ts": a, "hi_ts": b, "n": n} for f, lo, hi, a, b, n in stats.collect()]

    # ---------------------------------------------------------------- writes

    def append(self, rows: DataFrame, *, stream: str | None = None, batch: int = 0) -> bool:
        """One atomic commit of (k, ts, seq, op, value) rows.  With `stream`, its batches are numbered
        upwards, and one that is in already is left out (False)."""
        self._check()
        if stream and self.state().streams.get(stream, -1) >= batch:
            return False
        added = self._write(rows, 0)
        if not added and not stream:
            return False
        return self._commit(added, [], **({"stream": stream, "batch": batch} if stream else {}))

    def now(self) -> int:
        """The next timestamp: above the clock and every committed one."""
        return max(int(time.time() * 1000) << 16, self.state().top + 1)

    def write_batch(self, entries: list[tuple], ts: int | None = None) -> int:
        """[(op, k, value)] in order; later entries win."""
        at = self.now() if ts is None else ts
        self.append(self.spark.createDataFrame([(k, at, i, op, v if op == PUT else None) for i, (op, k, v) in enumerate(entries)], self.kinds).coalesce(1))
        return at

    def put(self, key, value, ts: int | None = None) -> int:
        return self.write_batch([(PUT, key, value)], ts)

    def delete(self, key, ts: int | None = None) -> int:
        return self.write_batch([(DELETE, key, None)], ts)

    # ---------------------------------------------------------------- reads

    def files(self, lo=None, hi=None, at: int | None = None) -> list[dict]:
        """Live files that may hold versions of keys lo..hi (both included) up to `at`."""
        every = self.state().live.values()
        return [f for f in every if (at is None or f["lo_ts"] <= at) and (lo is None or f["hi"] is None or f["hi"] >= lo) and (hi is None or f["lo"] is None or f["lo"] <= hi)]

    def _rows(self, files: list[dict]) -> DataFrame:
        self._check()
        if not files:
            return self.spark.createDataFrame([], self.kinds)
        return self.spark.read.schema(self.kinds).parquet(*sorted(f"{self.path}/{f['file']}" for f in files))

    def log(self) -> DataFrame:
        """All live versions, tombstones included."""
        return self._rows(self.files())

    def view(self, at: int | None = None) -> DataFrame:
        log = self._rows(self.files(at=at))
        return (versions.latest_view(log) if at is None else versions.snapshot_read(log, at)).select("k", "ts", "value")

    def get(self, key, at: int | None = None):
        """(found, value); reads only the files whose bounds hold the key."""
        self._check()
        log = self._rows(self.files(key, key, at)).where(F.col("k") == key)
        rows = (versions.latest_view(log) if at is None else versions.snapshot_read(log, at)).select("value").take(1)
        return (True, rows[0]["value"]) if rows else (False, None)

    def multi_get(self, wanted: DataFrame, at: int | None = None) -> DataFrame:
        """Every wanted key (a column k) with `found`, `ts` and `value`."""
        log = self._rows(self.files(at=at))
        log = log if at is None else log.where(F.col("ts") <= at)
        return versions.multi_get(log, wanted).select(*wanted.columns, "found", "ts", "value")

    def scan(self, start, end, at: int | None = None) -> DataFrame:
        log = self._rows(self.files(start, end, at)).where((F.col("k") >= start) & (F.col("k") < end))
        return (versions.latest_view(log) if at is None else versions.snapshot_read(log, at)).orderBy("k").select("k", "ts", "value")

    def export(self, path: str, at: int | None = None) -> None:
        self.view(at).write.parquet(path)

    def verify(self) -> int:
        """Reads all live files and compares them with the edits; Corrupt if one is missing, cannot be
        read or has other rows than were written (R13, R19).  Returns the number of files."""
        files = self.files()
        try:
            found = self._rows(files)
            got = {tuple(r) for r in found.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).collect()} if files else set()
        except (AnalysisException, PySparkException, Py4JJavaError) as e:
            raise Corrupt(f"{self.path}: {str(e).splitlines()[0]}") from e
        odd = {(f["file"].split("/")[1], f["n"], f["lo_ts"], f["hi_ts"]) for f in files} ^ got
        if odd:
            raise Corrupt(f"{self.path}: {sorted(odd)[0][0]}")
        return len(files)

    # ---------------------------------------------------------------- maintenance

    def compact(self, horizon: int, *, everything: bool = False) -> bool:
        """Merges level 0 and the files of level 1 whose keys it overlaps (or all files) into key-ranged
        files of level 1, without versions that no snapshot at or after `horizon` can see: all
        versions of the keys are among the inputs, so tombstones can go too.  False if there is
        nothing to do; Conflict, with nothing changed, if another compaction took an input."""
        self._check()
        live = self.state().live.values()
        fresh = [f for f in live if not f["level"]]
        if not (live if everything else fresh):
            return False
        known = [f for f in fresh if f["lo"] is not None]
        lo, hi = (min((f["lo"] for f in known), default=None), max((f["hi"] for f in known), default=None))
        below = [f for f in live if f["level"] and (everything or f["lo"] is None or lo is not None and f["hi"] >= lo and f["lo"] <= hi)]
        inputs = fresh + below
        added = self._write(gc.mvcc_gc(self._rows(inputs), horizon), 1)
        self._commit(added, [f["file"] for f in inputs])
        return True

    def vacuum(self, keep_seconds: float = 86_400) -> int:
        """Deletes files that have not been live for `keep_seconds` (readers that planned before may
        still read younger ones), folders of commits that were never published and are as old, and
        edits that a snapshot covers.  Returns how many files and folders went."""
        self._check()
        fs, state, until = self._fs(), self.state(), int((time.time() - keep_seconds) * 1000)
        old = [f for f, at in state.gone.items() if at <= until]
        n = sum(bool(fs.delete(self._at(f), False)) for f in old)
        named = {f.split("/")[0] for f in [*state.live, *state.gone] if f not in old}
        emptied = {f.split("/")[0] for f in old} - named
        for s in fs.listStatus(self._at()) if fs.exists(self._at()) else []:
            name = s.getPath().getName()
            if name in emptied:
                fs.delete(s.getPath(), True)
            elif name.startswith("seg-") and name not in named and s.getModificationTime() <= until:
                n += bool(fs.delete(s.getPath(), True))
        if old:
            self._commit([], [], vacuumed=old)
        names = sorted(self._names("edits"))
        covered = [x for x in names if x.endswith(".snapshot")][-1:]
        for x in names:
            if covered and x < covered[0].replace(".snapshot", ".edit") and fs.getFileStatus(self._at(f"edits/{x}")).getModificationTime() <= until:
                fs.delete(self._at(f"edits/{x}"), False)
        return n

    def close(self) -> None:
        self.open_ = False
