"""The decisions of log replication as expressions. Elections, timers and transport have no place in a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_entry(entries: DataFrame, idx: int) -> DataFrame:
    return entries.where(F.col("idx") == idx)


def entries_from(entries: DataFrame, idx: int) -> DataFrame:
    return entries.where(F.col("idx") >= idx).orderBy("idx")


def log_end(entries: DataFrame) -> DataFrame:
    """One row: last index, last term and size; 0 for an empty log."""
    return entries.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last_idx"), F.coalesce(F.max_by("term", "idx"), F.lit(0)).alias("last_term"), F.count(F.lit(1)).alias("size"))


def term_at(entries: DataFrame, idx: DataFrame) -> DataFrame:
    """idx(idx, ...) with the term there, 0 outside the log."""
    return idx.join(entries.select("idx", "term"), "idx", "left").withColumn("term", F.coalesce("term", F.lit(0)))


def truncate_append(entries: DataFrame, from_idx: int, new: DataFrame) -> DataFrame:
    return entries.where(F.col("idx") < from_idx).unionByName(new)


def commit_index(leaders: DataFrame, matches: DataFrame, entries: DataFrame) -> DataFrame:
    """New commit index of each leader(node, term, commit_idx) from matches(node, peer, match_idx) and entries(node, idx, term).

    The index that a majority holds is the majority-th largest of the peers' and its own last; it commits if it is of
    the leader's term, as terms never fall along a log.
    """
    last = entries.groupBy("node").agg(F.max("idx").alias("last_idx"))
    peers = matches.groupBy("node").agg(F.collect_list("match_idx").alias("m"))  # one entry a peer of the cluster
    both = leaders.join(last, "node", "left").join(peers, "node", "left").withColumn("last_idx", F.coalesce("last_idx", F.lit(0)))
    m = F.coalesce("m", F.array().cast("array<bigint>"))
    majority = (F.size(m) + 1).cast("int")
    held = F.element_at(F.sort_array(F.concat(m, F.array("last_idx")), asc=False), F.floor(majority / 2).cast("int") + 1)
    at = both.withColumn("held", held).join(entries.select("node", F.col("idx").alias("held"), F.col("term").alias("held_term")), ["node", "held"], "left")
    moved = (F.col("held_term") == F.col("term")) & (F.col("held") > F.col("commit_idx"))
    return at.select("node", F.when(moved, F.col("held")).otherwise(F.col("commit_idx")).alias("commit_idx"))


def submit(entries: DataFrame, writes: DataFrame, term: int, leads: bool) -> DataFrame:
    """The leader's log with writes(pos, op, key, value) behind it in order of pos; any other node's log as it is.

    pos counts from 0 without gaps.
    """
    if not leads:
        return entries
    last = log_end(entries).select("last_idx")  # one row
    new = writes.join(F.broadcast(last)).select(F.lit(term).cast("long").alias("term"), (F.col("last_idx") + 1 + F.col("pos")).alias("idx"), "op", "key", "value")
    return entries.unionByName(new)


def common_prefix(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: the last index up to which two logs (idx, term) agree, where a leader's back-off ends; 0 if nowhere."""
    theirs = right.select("idx", F.col("term").alias("their_term"))
    both = left.select("idx", "term").join(theirs, "idx", "full")
    differs = F.min(F.when(~F.col("term").eqNullSafe(F.col("their_term")), F.col("idx")))
    return both.agg(F.coalesce(differs - 1, F.max("idx"), F.lit(0)).alias("match_idx"))


def probe_result(probes: DataFrame) -> DataFrame:
    """probes(cluster, ok) with the exit code of each cluster: 0 for exactly one node that accepts, 1 for none, 2 for several."""
    n = F.sum(F.col("ok").cast("int"))
    return probes.groupBy("cluster").agg(F.when(n == 1, 0).when(F.coalesce(n, F.lit(0)) == 0, 1).otherwise(2).alias("code"))


def vote_decision(requests: DataFrame) -> DataFrame:
    """requests(req, term, candidate, last_idx, last_term, my_term, voted_for, my_last_idx, my_last_term) with granted and new_term."""
    higher = F.col("term") > F.col("my_term")
    vote = F.when(higher, F.lit(None)).otherwise(F.col("voted_for"))
    fresh = (F.col("last_term") > F.col("my_last_term")) | ((F.col("last_term") == F.col("my_last_term")) & (F.col("last_idx") >= F.col("my_last_idx")))
    granted = (F.col("term") >= F.col("my_term")) & (vote.isNull() | (vote == F.col("candidate"))) & fresh
    return requests.select("req", granted.alias("granted"), F.greatest("term", "my_term").alias("new_term"))


def append_decision(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests(req, term, prev_idx, prev_term, n_new, leader_commit, my_term, commit_idx, my_last_idx) with success and the commit index after it."""
    at = requests.join(entries.select(F.col("idx").alias("prev_idx"), F.col("term").alias("at_term")), "prev_idx", "left")
    fits = (F.col("prev_idx") == 0) | F.coalesce(F.col("at_term") == F.col("prev_term"), F.lit(False))
    success = (F.col("term") >= F.col("my_term")) & fits
    last = F.when(F.col("n_new") > 0, F.col("prev_idx") + F.col("n_new")).otherwise(F.col("my_last_idx"))
    new_commit = F.when(success & (F.col("leader_commit") > F.col("commit_idx")), F.least("leader_commit", last)).otherwise(F.col("commit_idx"))
    return at.select("req", success.alias("success"), new_commit.cast("long").alias("new_commit"))


def apply_committed(entries: DataFrame, commit_idx: int) -> DataFrame:
    """Log rows of the committed entries(term, idx, op, key, value): op 1 puts, 2 deletes; seq is the index."""
    op = F.when(F.col("op") == 1, "put").otherwise("delete")
    return entries.where(F.col("idx") <= commit_idx).select(F.col("idx").alias("seq"), "key", "value", F.lit(0).cast("long").alias("ts"), op.alias("op"))


def route(nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """nodes(node, role, leader) with where a client goes: none on the leader, error without one or its address, else redirect."""
    known = nodes.join(endpoints.select(F.col("node").alias("leader"), "host", "port"), "leader", "left")
    status = F.when(F.col("role") == "leader", "none").when(F.col("leader").isNull() | F.col("host").isNull(), "error").otherwise("redirect")
    return known.select("node", status.alias("status"), F.when(status == "redirect", F.concat_ws(":", "host", F.col("port").cast("string"))).alias("target"))
