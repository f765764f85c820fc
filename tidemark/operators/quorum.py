"""Analytics over replicated logs (no consensus is run here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fold import SLAB_ROWS, running


def commit_index(matched: DataFrame, entries: DataFrame, peers: int) -> DataFrame:
    """(term, peer, idx) -> the largest index on a majority whose entry has the term."""
    need = peers // 2 + 1
    order = Window.partitionBy("term").orderBy(F.desc("idx"), "peer")  # at most `peers` rows
    kth = matched.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == need).select("term", "idx")
    return kth.join(entries.select("term", "idx"), ["term", "idx"], "left_semi").select("term", F.col("idx").alias("commit_index"))


def vote_grants(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """One vote per term and peer: the first request whose log is as new as the voter's."""
    able = requests.join(voters, "peer").where(F.struct("last_term", "last_idx") >= F.struct("own_term", "own_idx"))
    return able.groupBy("term", "peer").agg(F.min_by("candidate", "at").alias("candidate"))


def election_result(votes: DataFrame, peers: int) -> DataFrame:
    """Votes per candidate and whether they are a majority of all peers."""
    return votes.groupBy("term", "candidate").agg(F.count(F.lit(1)).alias("votes")).withColumn("elected", F.col("votes") >= peers // 2 + 1)


def truncate_append(appends: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(node, at, idx) -> the entries left: a later append at or before an index cuts it."""
    done = running(appends, ["node"], [F.desc("at")], F.col("idx"), "min", F.col("at"), "cut", newest_first=True, own=False, slab_rows=slab_rows)
    return done.where("cut is null or idx < cut").drop("cut")


def append_entries(log: DataFrame, state: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One request for each node at most (X3): `log` (node, idx, term, data) with an entry 0 of term 0
    understood, `state` (node, term, commit), `requests` (node, term, prev_idx, prev_term,
    leader_commit, entries: array<struct<term, data>>).

    A request of an older term, or whose previous entry the log lacks, fails.  Else the log is cut after
    that entry, the request's entries follow, and the commit index rises to the leader's, but not past
    the log's end.  Returns (node, term, success, commit) for every request, and the new log of all
    nodes."""
    ends = log.groupBy("node").agg(F.max("idx").alias("end"))
    has = log.select("node", F.col("idx").alias("prev_idx"), F.col("term").alias("prev_term"), F.lit(True).alias("found"))
    asked = requests.join(state.select("node", F.col("term").alias("own"), "commit"), "node").join(ends, "node", "left").join(has, ["node", "prev_idx", "prev_term"], "left")
    start = (F.col("prev_idx") == 0) & (F.col("prev_term") == 0)
    ok = (F.col("term") >= F.col("own")) & (start | F.coalesce("found", F.lit(False)))
    last = F.col("prev_idx") + F.size("entries")
    commit = F.when(ok & (F.col("leader_commit") > F.col("commit")), F.least("leader_commit", last)).otherwise(F.col("commit"))
    answers = asked.select("node", F.greatest("term", "own").alias("term"), ok.alias("success"), commit.alias("commit"), "prev_idx", "entries")
    good = answers.where("success")
    kept = log.join(good.select("node", "prev_idx"), "node", "left").where("prev_idx is null or idx <= prev_idx").select("node", "idx", "term", "data")
    new = good.select("node", "prev_idx", F.posexplode("entries").alias("i", "e")).select("node", (F.col("prev_idx") + F.col("i") + 1).alias("idx"), "e.term", "e.data")
    return answers.select("node", "term", "success", "commit"), kept.unionByName(new)
