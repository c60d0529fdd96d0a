"""Helpers of the operators: kept order, first rows, safe reuse of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key by an explicit order (``dropDuplicates`` keeps any)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_per_group(df: DataFrame, keys: list[str | Column], order: list[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key in order; Spark prunes each partition to its first ranks before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def majority(df: DataFrame, group: list[str], value: str, row: str) -> DataFrame:
    """Each group's most frequent value (column ``value``), ties to the one seen first by ``row``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether a side has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = 100_000) -> DataFrame:
    """Broadcasts the right side only where a count shows it small, else lets Spark shuffle both."""
    return left.join(F.broadcast(right) if fits_broadcast(right, rows) else right, on, how)
