"""Snapshot-isolation transactions: first committer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import SLAB_ROWS, ordered_fold, running


def commit_outcomes(txns: DataFrame) -> DataFrame:
    """(txn, k, snap, req) of single-key transactions -> `committed` (T4, W6, W7): in the order of
    requests a transaction commits unless its key has a commit later than its snapshot.  With a
    column `aborted`, those that ended by themselves neither commit nor conflict (T3).  Writes and
    deletions are alike here.  A null snapshot saw nothing: it commits only if nothing has.

    Each outcome depends on the ones before, so a key is one task's time, though not its memory."""
    return _outcomes(txns).select("txn", "k", "committed")


def _outcomes(txns: DataFrame) -> DataFrame:
    def step(last, req, _, snap, aborted):
        ok = not aborted and last[0] <= (-1 if snap is None else snap)
        if ok:
            last[0] = req
        return ok

    aborted = F.coalesce("aborted", F.lit(False)) if "aborted" in txns.columns else F.lit(False)
    return ordered_fold(txns.select("k", "req", "txn", "snap", aborted.alias("aborted")), "k", ["req", "txn"], lambda: [-1], step, "committed", "boolean")


def multi_key_outcomes(txns: DataFrame) -> DataFrame:
    """(txn, keys, snap, req) -> `committed` for transactions over several keys.  An abort changes
    later outcomes, which couples keys, so each connected component of keys and transactions is
    replayed in order by itself; memory is one timestamp for each key of a component."""
    from tidemark.operators.graph import components

    edges = txns.select("txn", F.explode("keys").alias("key"))  # a set: repeated keys say the same
    named = edges.select(F.concat(F.lit("t"), F.col("txn").cast("string")).alias("a"), F.concat(F.lit("k"), F.col("key").cast("string")).alias("b"))
    comp = components(named).where(F.col("node").startswith("t")).select(F.substring("node", 2, 30).cast("long").alias("txn"), "component")

    def step(last, req, _, keys, snap, aborted):
        keys = keys or []
        ok = not aborted and all(last[0].get(k, -1) <= (-1 if snap is None else snap) for k in keys)
        if ok:
            last[0].update(dict.fromkeys(keys, req))
        return ok

    aborted = F.coalesce("aborted", F.lit(False)) if "aborted" in txns.columns else F.lit(False)
    # without keys nothing conflicts
    rows = txns.join(comp, "txn", "left").select(F.coalesce("component", F.concat(F.lit("t"), F.col("txn").cast("string"))).alias("component"), "req", "txn", "keys", "snap", aborted.alias("aborted"))
    return ordered_fold(rows, "component", ["req", "txn"], lambda: [{}], step, "committed", "boolean").select("txn", "committed")


def active_transactions(txns: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(txn, snap, req) -> (at, active): the transactions that have begun and not ended, after every
    begin and end (T1, T3)."""
    points = txns.select(F.explode(F.array(F.struct(F.col("snap").alias("at"), F.lit(1).alias("d")), F.struct(F.col("req").alias("at"), F.lit(-1).alias("d")))).alias("p"))
    changes = points.groupBy("p.at").agg(F.sum("p.d").alias("d")).withColumn("all", F.lit(0))
    return running(changes, ["all"], ["at"], F.col("d"), "sum", F.col("at"), "active", slab_rows=slab_rows).select("at", "active")


def conflicts(txns: DataFrame) -> DataFrame:
    """Requests on the same key after a transaction's snapshot and before its own request (J6), as a
    difference of two running counts: linear in a key's transactions, no pairs."""
    points = txns.select("k", "txn", F.explode(F.array(F.struct(F.col("snap").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("req").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("req").alias("at"), F.lit(-1).alias("kind")))).alias("p"))
    points = points.select("k", "txn", "p.at", "p.kind")
    # at equal positions: own probe (-1) before requests (0), snapshot probe (1) after them
    counted = running(points, ["k"], ["at", "kind"], F.when(F.col("kind") == 0, 1).otherwise(0), "sum", F.col("at"), "c")
    value = F.when(F.col("kind") == -1, F.col("c")).when(F.col("kind") == 1, -F.col("c")).otherwise(0)
    return counted.groupBy("txn", "k").agg(F.sum(value).alias("n_conflicts"))


def write_conflicts(txns: DataFrame, commits: DataFrame) -> DataFrame:
    """(txn, keys, snap) against the latest commits (k, commit_ts): the keys of each write set that were
    committed after its snapshot (T2, J6); a repeated key of a set counts once."""
    wanted = txns.select("txn", "snap", F.explode(F.array_distinct("keys")).alias("k"))
    return wanted.join(commits.select("k", "commit_ts"), "k").where(F.col("snap").isNull() | (F.col("commit_ts") > F.col("snap"))).select("txn", "k", "commit_ts")


def committed_writes(txns: DataFrame) -> DataFrame:
    """(txn, k, snap, req, op, v) -> the versions (k, ts, seq, op, v) that committing transactions write,
    puts and deletions (W6, W7)."""
    won = commit_outcomes(txns).where("committed").select("txn", "k")
    return txns.join(won, ["txn", "k"], "left_semi").select("k", F.col("req").alias("ts"), F.col("txn").alias("seq"), "op", "v")


def latest_commits(txns: DataFrame) -> DataFrame:
    """Newest commit per key."""
    return _outcomes(txns).where("committed").groupBy("k").agg(F.max("req").alias("commit_ts"))


def min_active_snapshot(active: DataFrame, now: int) -> DataFrame:
    """The oldest snapshot in use, at most now (A5)."""
    return active.agg(F.least(F.coalesce(F.min("snap"), F.lit(now)), F.lit(now)).alias("horizon"))
