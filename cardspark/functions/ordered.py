"""Rows in one order over all tasks: their places, and values carried along, where a key may hold more rows than a task should."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, by: list[str | Column], ranges: int | None = None) -> DataFrame:
    """The rows in order with `pos`, their places from 0 on, and `part`, the range of the order that they are in; written, so that both stay.

    Ranges cut a key with very many rows across tasks; Spark chooses their number, unless it is given."""
    rows = df.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by).withColumns({"part": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    rows = written(rows)
    parts = rows.groupBy("part").agg(F.count("*").alias("_n"))  # as many rows as there are partitions
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(parts.select("part", before.alias("_before"))), "part").withColumn("pos", F.col("_before") + F.col("_i")).drop("_i", "_before")


def filled(rows: DataFrame, value: str, forward: bool) -> DataFrame:
    """Numbered rows with the nearest `value` that is not null, at or before (forward) or at or after each row, over the borders of parts."""
    order = (lambda c: c) if forward else F.desc
    within = Window.partitionBy("part").orderBy(order("pos")).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.max_by if forward else F.min_by
    ends = rows.where(F.col(value).isNotNull()).groupBy("part").agg(pick(value, "pos").alias("_end"))
    ends = rows.select("part").distinct().join(ends, "part", "left").select("part", F.last("_end", ignorenulls=True).over(across).alias("_carried"))  # as many rows as parts
    return rows.join(F.broadcast(ends), "part").withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(within), "_carried")).drop("_carried")
