"""Operators along an order: neighbours, running values, islands and cut statistics (WN5-WN8, AG15).

All of them work within groups, so each group is one task's at most; rows of one group have an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.vector import dot


def adjacent_similarity(rows: DataFrame, group: str, order: str, vector: str = "embedding") -> DataFrame:
    """CH6/WN5: each row with its vector's inner product with the row before in its group; null for the first."""
    before = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("similarity", F.round(dot(F.col(vector), before), 6)).drop(vector)


def cut_statistics(rows: DataFrame, group: str, value: str = "similarity", percentile: float = 25.0) -> DataFrame:
    """CH7/AG15: ``(group, cut, mean, sd)``: the interpolated percentile below which a boundary lies, mean and deviation."""
    c = F.col(value)
    return rows.groupBy(group).agg(F.round(F.percentile(c, F.lit(percentile / 100)), 6).alias("cut"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("sd"))


def islands(rows: DataFrame, group: str, order: str, begins: Column, name: str = "chunk") -> DataFrame:
    """WN8: a number that goes up at each row where ``begins`` holds (null doesn't)."""
    return rows.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(order)))


def running_last(rows: DataFrame, group: str, order: str, holds: Column, value: str, name: str = "parent", missing=-1) -> DataFrame:
    """WN6: the latest ``value``, this row's included, of a row where ``holds``."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(F.when(holds, F.col(value)), ignorenulls=True).over(w), F.lit(missing)))


def next_value(rows: DataFrame, group: str, order: str, value: str, name: str = "next", missing=-1) -> DataFrame:
    """WN7: the following row's ``value``, where this row's stretch ends."""
    return rows.withColumn(name, F.coalesce(F.lead(value).over(Window.partitionBy(group).orderBy(order)), F.lit(missing)))
