"""Live rows of a log, by the three resolutions that differ, and what is derived from them.

The online and the hint view group by key with one max_by of a struct, so the shuffle carries one partial row a key and
partition whatever the number of versions: hot keys collapse before it. The replay view does so twice: the last
deletion of each key, without values, then the best put behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import HEADER, size_of


def live_online(log: DataFrame) -> DataFrame:
    """What a running store answers: the last operation of a key by position; timestamps don't matter."""
    last = F.max_by(F.struct("op", "value", "ts", "seq"), "seq").alias("r")
    return log.groupBy("key").agg(last).where("r.op <> 'delete'").select("key", "r.value", "r.ts", "r.seq")


def live_as_of(log: DataFrame, seq: int) -> DataFrame:
    """The online view as it was after position seq; later writes don't show."""
    return live_online(log.where(F.col("seq") <= seq))


def live_replay(log: DataFrame, order: str = "seq") -> DataFrame:
    """What replaying the files gives: a deletion always removes, a put replaces a live row unless its ts is lower.

    A deletion forgets all earlier timestamps, so the outcome is the put of greatest (ts, position) behind the key's
    last deletion: two aggregates, without ordering a key's rows. The join between them carries keys and positions on one
    side; adaptive execution broadcasts that side where it is small and splits hot keys where it isn't.
    """
    dead = log.where("op = 'delete'").groupBy("key").agg(F.max(order).alias("_dead"))
    puts = log.where("op <> 'delete'").join(dead, "key", "left").where(F.col(order) > F.coalesce("_dead", F.lit(-1)))
    best = F.max_by(F.struct("value", "ts", "seq"), F.struct("ts", order)).alias("r")
    return puts.groupBy("key").agg(best).select("key", "r.value", "r.ts", "r.seq")


def live_hints(index: DataFrame) -> DataFrame:
    """The key index as index files give it: the greatest ts, then the later file and place. index(key, ts, value_size, offset, file_id)."""
    best = F.max_by(F.struct("ts", "value_size", "offset", "file_id"), F.struct("ts", "file_id", "offset")).alias("r")
    size = HEADER + F.octet_length("key") + F.greatest(F.col("r.value_size"), F.lit(0))
    return index.groupBy("key").agg(best).select("key", "r.ts", "r.value_size", "r.offset", "r.file_id", size.cast("long").alias("record_size"))


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records before the first bad one of each file; records(file_id, offset, ok, ...). Files behind a bad one still count."""
    so_far = Window.partitionBy("file_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("_ok", F.min(F.col("ok").cast("int")).over(so_far)).where("_ok = 1").drop("_ok")


def keydir(segments: DataFrame) -> DataFrame:
    """The index: where each live key's record lies. segments is a log with file_id, offset and record_size."""
    last = F.max_by(F.struct("op", "file_id", F.octet_length("value").alias("value_size"), "offset", "record_size", "ts"), "seq").alias("r")
    return segments.groupBy("key").agg(last).where("r.op <> 'delete'").select("key", "r.file_id", "r.value_size", "r.offset", "r.record_size", "r.ts")


def sized(log: DataFrame) -> DataFrame:
    return log.withColumn("record_size", size_of(F.col("key"), F.col("value"), F.col("op")))


def java_order(key: Column) -> Column:
    """A sort key in UTF-16 code unit order; the default order is that of UTF-8 bytes, which filters push down."""
    return F.encode(key, "UTF-16BE")
