"""Answers to an interleaved log of requests, as if run one by one in seq order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import carried


WRITES = ("put", "batch", "delete")


def _as_of(asked: DataFrame, requests: DataFrame) -> DataFrame:
    """asked(seq, key) with w, the (op, value) of the last write of key before seq; null without one."""
    writes = requests.where(F.col("op").isin(*WRITES)).select("seq", "key", F.struct("op", "value").alias("_w"))
    rows = writes.unionByName(asked.select("seq", "key", F.lit(None).cast(writes.schema["_w"].dataType).alias("_w")))
    # writes and reads never share a position, so those without a value are the ones asked
    return carried(rows, ["key"], "seq", "_w", "w").where("_w is null").select("seq", "key", "w")


def answer_gets(requests: DataFrame) -> DataFrame:
    """(seq, key, status, value) of each get: the last write before it decides. requests(seq, op, key, end_key, value).

    A key's requests are worked in blocks of positions, so a hot key is dealt out; requests of other kinds don't enter.
    """
    rows = _as_of(requests.where("op = 'get'").select("seq", "key"), requests)
    hit = F.col("w").isNotNull() & (F.col("w.op") != "delete")
    return rows.select("seq", "key", F.when(hit, "ok").otherwise("not_found").alias("status"), F.when(hit, F.col("w.value")).alias("value"))


def answer_ranges(requests: DataFrame, width: int = 4) -> DataFrame:
    """(seq, key, value) of each range's rows; reversed bounds give none here and "error" in answer_status.

    A range becomes gets of the distinct keys inside its bounds, whatever the number of their versions, and those are
    answered as gets are. Ranges and keys meet by key prefixes of width characters; a range over several prefixes takes
    part once for each of those that keys have, which are few beside the keys.
    """
    valid = requests.where((F.col("op") == "range") & (F.col("key") <= F.col("end_key"))).select("seq", F.col("key").alias("lo"), F.col("end_key").alias("hi"))
    keys = requests.where(F.col("op").isin(*WRITES)).select("key").distinct().withColumn("pre", F.substring("key", 1, width))
    first, last = F.substring("lo", 1, width), F.substring("hi", 1, width)
    near = valid.where(first == last).withColumn("pre", first)
    wide = valid.where(first != last).join(keys.select("pre").distinct(), F.col("pre").between(first, last))
    asked = near.unionByName(wide).join(keys, "pre").where(F.col("key").between(F.col("lo"), F.col("hi"))).select("seq", "key")
    return _as_of(asked, requests).where("w.op <> 'delete'").select("seq", "key", "w.value")


def batch_entries(requests: DataFrame) -> DataFrame:
    """The puts of batch requests(seq, keys, values): one row an entry with its place n; the last of a repeated key wins.

    Lists of different lengths are refused whole, as one "error" row with no key.
    """
    even = F.coalesce(F.size("keys") == F.size("values"), F.lit(False))
    entries = F.when(even, F.arrays_zip(F.col("keys").alias("key"), F.col("values").alias("value")))
    rows = requests.select("seq", even.alias("ok"), F.posexplode_outer(entries).alias("n", "e")).where("n is not null or not ok")
    return rows.select("seq", "n", F.col("e.key").alias("key"), F.col("e.value").alias("value"), F.when(F.col("ok"), "ok").otherwise("error").alias("status"))


def answer_status(requests: DataFrame) -> DataFrame:
    """(seq, op, status): unknown kinds and reversed ranges are errors; gets are ok or not_found; the rest is ok."""
    gets = answer_gets(requests).select("seq", F.lit("get").alias("op"), "status")
    known = F.col("op").isin("put", "delete", "batch", "range", "compact")
    bad = ~known | ((F.col("op") == "range") & (F.col("key") > F.col("end_key"))) | ((F.col("op") != "compact") & F.col("key").isNull())
    rest = requests.where("op <> 'get'").select("seq", "op", F.when(bad, "error").otherwise("ok").alias("status"))
    return rest.unionByName(gets)
