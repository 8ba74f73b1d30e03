"""Ranks and running sums over a whole table without one task for all rows.

Rows fall into groups that follow the order; sums over groups give each group's start, and a window inside a group the
rest. Only the groups, of which there are few, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offset(df: DataFrame, groups: list[str], order: list[Column], amount: Column, inside: list[Column], name: str) -> DataFrame:
    sums = df.groupBy(*groups).agg(F.sum(amount).alias("_sum"))
    ahead = sums.withColumn("_ahead", F.sum("_sum").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    joined = df.alias("a").join(ahead.alias("b"), on).select("a.*", "b._ahead")
    window = Window.partitionBy(*groups).orderBy(*inside).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.col("_ahead") + F.sum(amount).over(window)).drop("_ahead")


def numbered(df: DataFrame, groups: list[str], order: list[Column], inside: list[Column], name: str = "rank") -> DataFrame:
    """Rank from 1 by (order, inside); groups are the columns that order sorts by, inside orders the rows of a group."""
    return _offset(df, groups, order, F.lit(1).cast("long"), inside, name)


def running_sum(df: DataFrame, groups: list[str], order: list[Column], amount: Column, inside: list[Column], name: str) -> DataFrame:
    """Sum of amount up to and with each row."""
    return _offset(df, groups, order, amount, inside, name)


#: Ids that share a group.
STRIDE = 65_536


def by_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with a group column that follows the order of a whole-number key."""
    return df.withColumn("_group", F.floor(F.col(key) / STRIDE))


def numbered_by_id(df: DataFrame, key: str = "doc_id", name: str = "rank") -> DataFrame:
    return numbered(by_id(df, key), ["_group"], [F.col("_group")], [F.col(key)], name).drop("_group")


def sum_by_id(df: DataFrame, amount: Column, name: str, key: str = "doc_id") -> DataFrame:
    return running_sum(by_id(df, key), ["_group"], [F.col("_group")], amount, [F.col(key)], name).drop("_group")
