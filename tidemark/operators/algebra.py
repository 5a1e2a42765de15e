"""Bag relational algebra on DataFrames. Catalyst picks the physical joins; nothing here forces one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Projection with duplicates kept; Columns may be expressions with aliases."""
    return df.select(*columns)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows: only where that is what is asked for."""
    return left.crossJoin(right)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal values in all columns of the same name, which appear once. Without a common column: the product."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common) if common else left.crossJoin(right)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    return left.join(right, condition, how)


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with ``low <= at <= high`` of whole numbers, by an equality join on buckets of ``width``."""
    bucket = F.floor(F.col(at) / width)
    cut = spans.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__bucket", bucket).join(cut, "__bucket").where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__bucket")


def semi_join(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Rows of ``left`` with a partner: IN and EXISTS."""
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: NOT EXISTS, and NOT IN where the right side has no null."""
    return left.join(right, on, "left_anti")


def outer_join(left: DataFrame, right: DataFrame, on: Column | str | list[str], side: str = "full") -> DataFrame:
    return left.join(right, on, side)


def bag_union(*inputs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, inputs)


def bag_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as in the input where it is rarer."""
    return left.intersectAll(right)


def bag_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as in ``left`` beyond ``right``."""
    return left.exceptAll(right)


def set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionAll(right).distinct()


def set_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def set_except(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def group(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Grouping; without aggregates the distinct keys."""
    return df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()


def sort(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.orderBy(*columns)


def estimate_equal(rows: float, distinct_values: float) -> float:
    """Size of an equality selection: rows over distinct values."""
    return rows / max(1.0, distinct_values)


def estimate_range(rows: float) -> float:
    return rows / 3


def estimate_join(left: float, right: float, left_distinct: float, right_distinct: float) -> float:
    return left * right / max(1.0, left_distinct, right_distinct)
