"""Numbering rows in an order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def numbered(rows: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their place, from 0, within their group in the order given.

    Rows are dealt by ranges of group and order and written, so that the ranges stay; each range numbers its own rows and
    starts where those before it end.  So a group as large as the whole table takes as many tasks as there are ranges.
    """
    by = [F.col(g) for g in groups]
    dealt = rows.repartitionByRange(*by, *order) if by else rows.repartitionByRange(*order)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*groups, "_range").count()
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = sizes.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_range").alias("_at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order)) - 1
    out = dealt.withColumn("_inside", inside).join(F.broadcast(starts), same)
    return out.withColumn(name, F.col("_start") + F.col("_inside")).select(*rows.columns, name)
