"""Exact order statistics of groups of any size.

A group's values are never collected: equal values are counted first, an
approximate percentile brackets the wanted ranks, and only the counted values
inside the bracket are put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the approximate percentile; its error is at most 1/ACCURACY of a group.
ACCURACY = 2_000


def at_ranks(rows: DataFrame, keys: list[str], value: str, share: float, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """One row per key: n, its rows with a value, and ranked, the values at the 0-based ``ranks`` (a function of n) near ``share`` of n.

    Rows without a value don't count; keys whose rows all lack one are left out. Null keys form a group.
    """
    there = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counts = there.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    near = [min(1.0, max(0.0, share + d / ACCURACY)) for d in (-4, 4)]
    sizes = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*[F.lit(s) for s in near]), ACCURACY).alias("_b"))
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_b")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = counts.join(named, same) if keys else counts.join(named)  # without keys the right side is one row
    # Ranks at the ends of a group lie outside an approximate bracket, so the bracket is opened there.
    low, high = F.get("_b", F.lit(0)), F.get("_b", F.lit(1))
    under = (F.col("_v") < low) if near[0] > 0 else F.lit(False)
    over = (F.col("_v") > high) if near[1] < 1 else F.lit(False)
    below = placed.groupBy(*keys).agg(F.max("n").alias("n"), F.coalesce(F.sum(F.when(under, F.col("_n"))), F.lit(0)).alias("_below"))
    inside = placed.filter(~under & ~over).groupBy(*keys, "_v").agg(F.max("_n").alias("_n"))
    base = below.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_below")
    joined = inside.join(base, same) if keys else inside.join(base)
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = joined.withColumn("_upto", upto)
    wanted = [F.max(F.when((r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")), F.col("_v"))) for r in ranks(F.col("n"))]
    return ordered.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*wanted).alias("ranked"))


def middle(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n and ranked: the lower and the upper middle value."""
    return at_ranks(rows, keys, value, 0.5, lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)])


def exclusive_quantile(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys and quantile by the exclusive method: position q * (n + 1), between the two values there."""
    def position(n: Column) -> Column:
        return F.least(F.greatest(F.lit(q) * (n + 1), F.lit(1.0)), n.cast("double"))

    found = at_ranks(rows, keys, value, q, lambda n: [F.floor(position(n)) - 1, F.least(F.floor(position(n)), n - 1)])
    a, b, at = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1)), position(F.col("n"))
    return found.select(*keys, (a + (b - a) * (at - F.floor(at))).alias("quantile"))
