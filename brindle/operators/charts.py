"""Histograms, time lines and statistics for charts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.core import keep_first, majority
from brindle.operators.quantiles import exclusive_quantile


#: Names of columns that number or date rows and are no measures (fixed value).
ID_LIKE = re.compile(r"(?i)(^|[_\s-])(id|no|serial|rank|index|year|date|month|period|quarter)([_\s-]|$)")


def nice_step(span: float, bins: int = 6) -> float:
    """The smallest of 1, 2, 2.5, 5 times a power of ten that cuts a span into about ``bins`` bins."""
    if span <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(span / bins))
    return next(m * power for m in (1, 2, 2.5, 5, 10) if m * power * bins >= span - 1e-9)


def histogram(df: DataFrame, value: str, bins: int = 6) -> DataFrame:
    """(bin, lower, upper, n) with the empty bins; the last bin takes the largest value."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    step = nice_step(float(high) - float(low), bins)
    start = math.floor(float(low) / step) * step
    last = max(0, math.ceil((float(high) - start) / step - 1e-9) - 1)
    placed = df.filter(F.col(value).isNotNull()).select(F.least(F.floor((F.col(value) - start) / step + 1e-9), F.lit(last)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (start + F.col("bin") * step).alias("lower"), (start + (F.col("bin") + 1) * step).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def timeline(df: DataFrame, day: Column, unit: str = "day") -> DataFrame:
    """(step, n) for every day or month from the first to the last, gaps as 0."""
    counts = df.select(F.trunc(day, "MM").alias("step") if unit == "month" else day.alias("step")).filter("step is not null").groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("step").alias("a"), F.max("step").alias("b"))
    every = ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("step")).select(F.col("step").cast("date").alias("step"))
    return every.join(counts, "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"))


def with_gaps(df: DataFrame, ordinal: str) -> DataFrame:
    """Adds gap (a step is missing before this point) and run (number of the unbroken run)."""
    w = Window.orderBy(ordinal)
    gap = F.coalesce((F.col(ordinal) - F.lag(ordinal).over(w)) > 1, F.lit(False))
    return df.withColumn("gap", gap).withColumn("run", F.sum(F.col("gap").cast("int")).over(w))


def first_last_peak(df: DataFrame, key: str, value: str) -> DataFrame:
    """First and last value of a trend, their change in percent, and its peak."""
    s = df.agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"), F.max_by(key, F.struct(F.col(value), key)).alias("peak"))
    return s.withColumn("change", F.when(F.col("first") != 0, F.bround((F.col("last") - F.col("first")).cast("decimal(24,4)") * 100 / F.col("first").cast("decimal(20,4)"), 2)))


def top_categories(df: DataFrame, column: str, n: int = 6) -> DataFrame:
    """(name, n): the most frequent categories, the rest as ``Other``."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "name").limit(n)
    rest = counts.join(F.broadcast(top.select("name")), "name", "left_anti").agg(F.sum("n").alias("n")).filter("n is not null")
    return top.unionByName(rest.select(F.lit("Other").alias("name"), "n"))


def statistics(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The statistics that questions may ask for, per group, in one pass of sums; the quantile is exact and comes from counted values."""
    sums = df.groupBy(group).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("stdev"), F.stddev_pop(x).alias("pstdev"), F.var_samp(x).alias("variance"), F.var_pop(x).alias("pvariance"), F.corr(x, y).alias("correlation"),
        F.covar_samp(x, y).alias("covariance"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.exp(F.avg(F.log(x))).alias("geometric_mean"), (F.count(x) / F.sum(1 / F.col(x))).alias("harmonic_mean"),
    )
    q90 = exclusive_quantile(df, [group], x, 0.9).select(F.col(group).alias("_g"), F.col("quantile").alias("q90"))
    return sums.join(q90, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def modes(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each group's most frequent value, ties to the one seen first."""
    return majority(df, [group], value, order)


def scatter(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Points with both values, and how many rows were skipped for want of one."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.filter(both).select(x, y), df.agg(F.count_if(~both).alias("skipped"))


def unit_series(df: DataFrame, label: str, value: str, unit: str, row: str) -> DataFrame:
    """Points in the column's majority unit; points in others are left out and counted."""
    most = majority(df.select(F.lit(1).alias("_g"), unit, row), ["_g"], unit, row).first()
    main = most[unit] if most else None
    same = F.col(unit).eqNullSafe(F.lit(main))
    return df.filter(same).select(label, value, unit, (df.filter(~same).agg(F.count(F.lit(1)))).scalar().alias("omitted"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return keep_first(df, [key], [F.desc(order)])


def graph_parameters(df: DataFrame, columns: list[str], read, row: str = "_row") -> DataFrame:
    """(name, unit, points): columns that a graph can show, by a reader of measures (``read``: Column -> struct of value and unit).

    A column counts when four of five of its filled cells are measures; its
    unit is the most frequent one, ties to the first seen. One pass over the
    table turned long.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns if not ID_LIKE.search(c)])
    long = df.select(F.col(row).alias("_row"), F.explode(cells).alias("_c")).select("_row", "_c.name", "_c.cell").filter("trim(cell) <> ''").withColumn("_m", F.explode(F.array(read(F.col("cell")))))
    sizes = long.groupBy("name").agg(F.count(F.lit(1)).alias("filled"), F.count("_m").alias("hits"))
    units = long.filter("_m is not null").groupBy("name", F.col("_m.unit").alias("unit")).agg(F.count(F.lit(1)).alias("points"), F.min("_row").alias("_first"))
    best = units.groupBy("name").agg(F.max_by(F.struct("unit", "points"), F.struct("points", -F.col("_first"))).alias("_b"))
    return sizes.filter(F.col("hits") >= F.greatest(F.lit(1), F.ceil(0.8 * F.col("filled")))).join(best, "name").select("name", "_b.unit", "_b.points")


def graph_series(df: DataFrame, x: str, y: str, unit: str, read) -> tuple[DataFrame, DataFrame]:
    """Points (x, value, raw) of a column in its unit, and how many filled cells were left out."""
    measured = df.withColumn("_m", F.explode(F.array(read(F.col(y)))))
    same = F.coalesce(F.col("_m.unit") == unit, F.lit(False))
    points = measured.filter(same).select(F.col(x).alias("x"), F.col("_m.value").alias("value"), F.trim(y).alias("raw"))
    return points, measured.agg(F.count_if(~same & (F.trim(F.coalesce(y, F.lit(""))) != "")).alias("omitted"))
