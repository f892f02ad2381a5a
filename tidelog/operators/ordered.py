"""Running sums and values carried along ordered rows, in two steps, so that no key's or file's rows meet in one task.

Rows fall into blocks of BLOCK positions. A block's own total (or last value) is aggregated before the shuffle; only
those totals, one a block, are ordered key by key; then each block's rows are worked by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16  # positions a block


def _blocked(rows: DataFrame, order: Column, block: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(order / F.lit(block)).cast("long"))


def _known(rows: DataFrame, keys: list[str], totals: DataFrame) -> DataFrame:
    """rows with their block's totals; equal keys and blocks, nulls included."""
    on = rows._block == totals._b
    for k in keys:
        on = on & rows[k].eqNullSafe(totals[f"_{k}"])
    return rows.join(totals, on).drop("_b", *[f"_{k}" for k in keys])


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the sum of value over the rows of equal keys up to and with each, by order."""
    rows = _blocked(rows, F.col(order), block)
    totals = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _known(rows, keys, totals).withColumn(name, F.col("_base") + F.sum(value).over(inside)).drop("_base", "_block")


def carried(rows: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK, ahead: bool = False) -> DataFrame:
    """rows with the last value that isn't null of the rows of equal keys strictly before each, by order; null without one.

    With ahead it is the first value behind each.
    """
    rows = _blocked(rows, F.col(order), block)
    place = F.when(F.col(value).isNotNull(), F.col(order))
    edge = (F.min_by if ahead else F.max_by)(value, place).alias("_edge")
    totals = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b")).agg(edge)
    turned = lambda c: F.col(c).desc() if ahead else F.col(c).asc()
    earlier = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(turned("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_prior", F.last("_edge", ignorenulls=True).over(earlier)).drop("_edge")
    inside = Window.partitionBy(*keys, "_block").orderBy(turned(order)).rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_prior"))
    return _known(rows, keys, totals).withColumn(name, found).drop("_prior", "_block")
