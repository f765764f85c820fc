"""Structured Streaming: change-log streams into a versioned table and live views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.table import Conflict, VersionedTable


def into_table(changes: DataFrame, target: VersionedTable, checkpoint: str, *, compact_every: int = 0, keep: int = 0) -> StreamingQuery:
    """Appends a stream of (k, ts, seq, op, value) as one commit a micro-batch; every
    `compact_every` batches the table is compacted to the newest `keep` timestamps.  The commit holds the
    stream's checkpoint and batch number, so a batch that is replayed after a failure is left out."""

    def commit(batch: DataFrame, number: int) -> None:
        target.append(batch, stream=checkpoint, batch=number)
        if compact_every and (number + 1) % compact_every == 0:
            try:
                target.compact(target.state().top - keep)
            except Conflict:  # another one is at it
                return

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(changes: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Changes per window and op, with late rows up to the watermark."""
    return changes.withWatermark(time, late).groupBy(F.window(time, width), "op").agg(F.count(F.lit(1)).alias("n"))


def commit_outcomes(txns: DataFrame) -> DataFrame:
    """A stream of single-key transactions (txn, k, snap, req) -> (txn, k, committed), first committer
    wins (T4).  The state of a key is its last commit; requests of a micro-batch are taken in the order
    of (req, txn), micro-batches as they come."""
    import pandas as pd

    def step(key, batches, state):
        (last,) = state.get if state.exists else (-1,)
        rows = pd.concat(list(batches)).sort_values(["req", "txn"])
        out = []
        for snap, req in zip(rows["snap"].tolist(), rows["req"].tolist(), strict=True):
            ok = last <= (-1 if pd.isna(snap) else snap)
            last = req if ok else last
            out.append(ok)
        state.update((int(last),))
        yield pd.DataFrame({"txn": rows["txn"], "k": key[0], "committed": out})

    rows = txns.select("txn", "k", "snap", "req")
    return rows.groupBy("k").applyInPandasWithState(step, "txn long, k long, committed boolean", "last long", "append", "NoTimeout")
