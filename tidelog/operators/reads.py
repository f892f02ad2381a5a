"""Lookups and range scans over a live view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import java_order


def get(live: DataFrame, key: str) -> DataFrame:
    """At most one row; the filter reaches the scan of a stored view."""
    return live.where(F.col("key") == key)


def multi_get(live: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(key, ...) with the live value, null where there is none: an empty value isn't null."""
    return keys.join(live, "key", "left")


def exists(live: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(live.select("key"), "key", "left_semi")


def missing(live: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(live.select("key"), "key", "left_anti")


def size(live: DataFrame) -> DataFrame:
    return live.agg(F.count(F.lit(1)).alias("n"))


def keys(live: DataFrame) -> DataFrame:
    return live.select("key")


def range_scan(live: DataFrame, start: str, end: str, utf16: bool = False) -> DataFrame:
    """Rows from start to end, both included, ascending by key. Reversed bounds are an error, as in the store's protocol."""
    if utf16:
        low, high = start.encode("utf-16-be"), end.encode("utf-16-be")
        if low > high:
            raise ValueError("range start is behind its end")
        at = java_order(F.col("key"))
        return live.where((at >= F.lit(low)) & (at <= F.lit(high))).orderBy(at)
    if start.encode() > end.encode():
        raise ValueError("range start is behind its end")
    return live.where(F.col("key").between(start, end)).orderBy("key")
