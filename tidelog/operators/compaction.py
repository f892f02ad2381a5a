"""Compaction: when it pays, and the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import dead_bytes, file_name, with_offsets
from .views import keydir

THRESHOLD = 0.5


def ratio(segments: DataFrame, active: str) -> DataFrame:
    """One row: dead and all bytes of the files but the active one, and their ratio (0 where there are none)."""
    closed = dead_bytes(segments).where(F.col("file_id") != active)
    sums = closed.agg(F.coalesce(F.sum("dead_bytes"), F.lit(0)).alias("dead_bytes"), F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("closed_bytes"))
    return sums.withColumn("ratio", F.when(F.col("closed_bytes") > 0, F.col("dead_bytes") / F.col("closed_bytes")).otherwise(0.0))


def should_compact(segments: DataFrame, active: str, threshold: float = THRESHOLD) -> DataFrame:
    return ratio(segments, active).withColumn("should_compact", (F.col("closed_bytes") > 0) & (F.col("ratio") >= threshold))


def compact(segments: DataFrame, active: str, into: int, deletions: bool = True) -> DataFrame:
    """The segments after compaction: live records of closed files in a new file, at their places there; the active file as it is.

    Rows keep their seq, which decides what is live: a merged file never outranks later records, whatever its name.
    Deletions in closed files go where no record of their key stays; one behind a record of its key in the active file (files
    may follow that) stays with the live records, or its key would come back. Without deletions none stays: that is right
    only where the active file is the last.
    """
    of_active = F.when(F.col("file_id") == active, F.col("seq"))
    last = segments.groupBy("key").agg(F.max_by(F.struct("seq", "op"), "seq").alias("r"), F.max_by("op", of_active).alias("in_active"))
    shadows = F.coalesce(F.col("in_active") != "delete", F.lit(False)) if deletions else F.lit(False)
    stay = last.where((F.col("r.op") != "delete") | shadows).select("r.seq")
    closed = segments.where(F.col("file_id") != active)
    kept = with_offsets(closed.join(stay, "seq", "left_semi").drop("offset").withColumn("file_id", file_name(F.lit(into))))
    return kept.select(segments.columns).unionByName(segments.where(F.col("file_id") == active))


def stats(segments: DataFrame, active: str) -> DataFrame:
    """One row: closed bytes, live bytes copied, and bytes reclaimed gross (the files' size) and net."""
    live = keydir(segments).where(F.col("file_id") != active).agg(F.coalesce(F.sum("record_size"), F.lit(0)).alias("live_bytes"), F.count(F.lit(1)).alias("live_records"))
    closed = segments.where(F.col("file_id") != active).agg(F.coalesce(F.sum("record_size"), F.lit(0)).alias("gross_bytes"), F.countDistinct("file_id").alias("files"))
    return closed.crossJoin(live).withColumn("net_bytes", F.col("gross_bytes") - F.col("live_bytes"))  # one row each
