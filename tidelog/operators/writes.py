"""Rows that writes append to a log. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BATCH, DELETE, PUT


def put_rows(rows: DataFrame, base: int = 0) -> DataFrame:
    """Log rows of rows(pos, key, value, ts)."""
    return rows.select((F.lit(base) + F.col("pos")).cast("long").alias("seq"), "key", "value", "ts", F.lit(PUT).alias("op"))


def delete_rows(rows: DataFrame, base: int = 0) -> DataFrame:
    """Deletions of rows(pos, key, ts); an unknown key is deleted too, without an error."""
    return rows.select((F.lit(base) + F.col("pos")).cast("long").alias("seq"), "key", F.lit(None).cast("binary").alias("value"), "ts", F.lit(DELETE).alias("op"))


def batch_rows(batches: DataFrame, base: int = 0) -> DataFrame:
    """Log rows of batches(batch, keys array, values array, ts): one ts a batch, the last of a repeated key wins.

    Lists of different lengths fail the query.
    """
    checked = F.when(F.size("keys") == F.size("values"), F.arrays_zip("keys", "values")).otherwise(F.raise_error("keys and values differ in number"))
    rows = batches.select("batch", "ts", F.posexplode(checked).alias("i", "kv"))
    return rows.select((F.lit(base) + F.shiftleft(F.col("batch").cast("long"), 32) + F.col("i")).cast("long").alias("seq"), F.col("kv.keys").alias("key"), F.col("kv.values").alias("value"), "ts", F.lit(BATCH).alias("op"))
