"""Query plans: filters, one grouping, one aggregate, a sort and a top-N with the rest folded.

A plan is data. ``check_plan`` validates it against a table's columns, and
``run_plan`` turns it into one grouped DataFrame plus one accounting row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbers import half_even, read_number
from brindle.functions.periods import bucket
from brindle.operators.quantiles import middle
from brindle.operators.typing import ColumnProfile

AGGREGATES = ("count", "sum", "avg", "min", "max", "median", "distinct")
OPERATORS = ("search", "present", "contains", "in", "notIn", "gte", "lte", "between")
SORTS = ("value-desc", "value-asc", "label", "time")
NUMERIC = ("number", "money", "percent")


@dataclass(frozen=True)
class Filter:
    op: str
    column: str | None = None
    values: tuple = ()
    bucket: str | None = None


@dataclass(frozen=True)
class Query:
    agg: str = "count"
    measure: str | None = None
    group_by: str | None = None
    filters: tuple[Filter, ...] = ()
    sort: str | None = None
    limit: int | None = None
    bucket: str | None = None
    other: bool = False


@dataclass
class Result:
    rows: DataFrame
    accounting: DataFrame
    stale: bool = False
    notes: list[str] = field(default_factory=list)


class PlanError(ValueError):
    """A plan that the table can't answer."""


def check_plan(q: Query, profile: dict[str, ColumnProfile]) -> Query:
    """Raises PlanError for an unknown aggregate, column, operator or sort, and for kinds that don't fit."""
    def need(name: str | None, kinds: tuple[str, ...] | None = None) -> None:
        if name not in profile:
            raise PlanError(f"no column {name!r}")
        if kinds and profile[name].kind not in kinds:
            raise PlanError(f"column {name!r} is not one of {kinds}")

    if q.agg not in AGGREGATES or (q.sort and q.sort not in SORTS):
        raise PlanError("unknown aggregate or sort")
    if q.agg == "distinct":
        need(q.measure)
    elif q.agg != "count":
        need(q.measure, NUMERIC)
    if q.group_by is not None:
        need(q.group_by)
    if q.limit is not None and not 1 <= q.limit <= 50:
        raise PlanError("a limit is 1 to 50")
    if len(q.filters) > 6 or any(len(f.values) > 20 for f in q.filters):
        raise PlanError("at most 6 filters of 20 values")
    for f in q.filters:
        if f.op not in OPERATORS:
            raise PlanError(f"unknown operator {f.op!r}")
        if f.op != "search":
            need(f.column, NUMERIC if f.op in ("gte", "lte", "between") else None)
    return q


def bound_of(value) -> Decimal | None:
    """A filter's bound: a number, or words such as "5 lakh" read as a cell would be; None where it can't be read."""
    try:
        return Decimal(str(value))
    except InvalidOperation:
        return read_number(str(value))


def condition(f: Filter, profile: dict[str, ColumnProfile], columns: list[str]) -> Column:
    """One predicate over typed columns; never null, so a missing cell is decided and not lost."""
    no = F.lit(False)
    if f.op == "search":
        needle = str(f.values[0]).strip().lower() if f.values else ""
        return F.lit(True) if not needle else F.exists(F.array(*[F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns]), lambda x: F.contains(x, F.lit(needle)))
    kind, name = profile[f.column].kind, f.column
    number = F.col(f"{name}__num") if kind in NUMERIC else None
    if f.op == "present":
        return (number if number is not None else F.col(f"{name}__key")).isNotNull()
    if f.op == "contains":
        return F.coalesce(F.contains(F.lower(F.col(f"`{name}`").cast("string")), F.lit(str(f.values[0]).lower())), no)
    if f.op in ("in", "notIn"):
        key = bucket(F.col(f"{name}__key"), f.bucket) if f.bucket else F.col(f"{name}__key")
        inside = F.coalesce(key.isin(*[" ".join(str(v).split()) if f.bucket or kind == "period" else " ".join(str(v).split()).lower() for v in f.values]), no)
        return inside if f.op == "in" else ~inside
    bounds = [bound_of(v) for v in f.values[: 2 if f.op == "between" else 1]]
    if None in bounds or len(bounds) < (2 if f.op == "between" else 1):
        return no
    low, high = (bounds[0] if f.op != "lte" else None), (bounds[-1] if f.op != "gte" else None)
    test = F.lit(True)
    if low is not None:
        test = test & (number >= F.lit(low))
    if high is not None:
        test = test & (number <= F.lit(high))
    return F.coalesce(test, no)


#: What a group keeps of its rows for each aggregate, how two such parts merge, and the value that they give.
def _parts(agg: str, scale: int) -> tuple[dict[str, Column], dict[str, Column], Column]:
    v = F.col("_v")
    if agg == "avg":
        return {"_s": F.sum(v), "_c": F.count(v)}, {"_s": F.sum("_s"), "_c": F.sum("_c")}, half_even(F.col("_s"), F.col("_c"), scale + 2, f"decimal(24,{max(scale, 1)})")
    if agg == "count":
        return {}, {}, F.col("rows").cast("decimal(38,0)")
    f = {"sum": F.sum, "min": F.min, "max": F.max}[agg]
    return {"_s": f(v)}, {"_s": f("_s")}, F.col("_s")


def _half(ranked: Column, scale: int) -> Column:
    """The mean of the two middle values, half-even at one digit more than they have."""
    both = F.get(ranked, F.lit(0)) + F.get(ranked, F.lit(1))
    return F.bround(both.cast(f"decimal(28,{max(scale, 1)})") / F.lit(2).cast("decimal(2,0)"), scale + 1)


def _values(used: DataFrame, keys: list[str], agg: str, scale: int) -> DataFrame:
    """keys and value of the aggregates whose parts do not merge: the median and the number of different values."""
    if agg == "median":
        return middle(used, keys, "_v").select(*keys, _half(F.col("ranked"), scale).alias("value"))
    kinds = used.select(*keys, "_m").filter("_m is not null").distinct()
    return kinds.groupBy(*keys).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("value"))


def run_plan(df: DataFrame, profile: dict[str, ColumnProfile], q: Query, columns: list[str], row: str = "_row") -> Result:
    """Rows (label, key, value, rows, overall) and the accounting of what was left out.

    The table is read and parsed once: rows are summed to one small part a
    group, and the groups, the overall value and ``other`` (the groups past the
    limit) all follow from these parts, whose exchange Spark reuses. A median
    or a number of different values has no such parts; there the overall value
    and ``other`` are worked out from counted values.
    """
    missing = [c for c in (q.measure, q.group_by, *(f.column for f in q.filters if f.op != "search")) if c is not None and c not in profile]
    if missing:
        empty = df.sparkSession.createDataFrame([], "label string, key string, value decimal(38,6), rows long, overall decimal(38,6)")
        return Result(empty, df.sparkSession.createDataFrame([], "matched long, used long, blank long, ranged long, excluded long"), True, missing)
    check_plan(q, profile)
    matched = df
    for f in q.filters:
        matched = matched.filter(condition(f, profile, columns))
    scale = profile[q.measure].scale if q.measure and profile[q.measure].kind in NUMERIC else 0
    numeric = q.agg not in ("count", "distinct")
    key = F.lit("all rows") if q.group_by is None else (bucket(F.col(f"{q.group_by}__key"), q.bucket) if q.bucket else F.col(f"{q.group_by}__key"))
    label = F.lit("All rows") if q.group_by is None else (key if q.bucket else F.col(f"{q.group_by}__label"))
    none = F.lit(None)
    rows = matched.select(
        F.col(row).alias("_row"),
        key.alias("key"),
        label.alias("_label"),
        (F.col(f"{q.measure}__num").cast(f"decimal(28,{max(scale, 1)})") if numeric else none.cast("decimal(28,1)")).alias("_v"),
        (F.col(f"{q.measure}__key") if q.agg == "distinct" else none.cast("string")).alias("_m"),
        (F.col(f"{q.measure}__excl") if numeric else none.cast("string")).alias("_why"),
        (F.col(f"{q.measure}__ranged") if numeric else F.lit(False)).alias("_ranged"),
    )
    usable = F.col("key").isNotNull() & (F.col("_v").isNotNull() if numeric else F.lit(True))
    accounting = rows.agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(usable).alias("used"),
        F.count_if(~usable & F.col("_why").isNull()).alias("blank"),
        F.count_if(usable & F.col("_ranged")).alias("ranged"),
        F.count_if(F.col("_why").isNotNull()).alias("excluded"),
    )
    used = rows.filter(usable)
    label_, rows_ = {"label": F.min_by("_label", "_row")}, {"rows": F.count(F.lit(1))}
    merging = q.agg not in ("median", "distinct")
    if merging:
        first, again, value = _parts(q.agg, scale)
        # In the order in which the result uses them, and all used by the overall value too: so both have one and the same exchange.
        parts = used.groupBy("key").agg(*[c.alias(n) for n, c in (label_ | first | rows_).items()])
        total = parts.agg(F.max("label").alias("_any"), *[c.alias(n) for n, c in again.items()], F.sum("rows").alias("rows"))
        overall = total.select(F.when(F.col("_any").isNotNull() | F.col("rows").isNotNull(), value)).scalar()
        groups = parts.withColumn("value", value).withColumn("overall", overall)
    else:
        parts = used.groupBy("key").agg(*[c.alias(n) for n, c in (label_ | rows_).items()])
        overall = _values(used, [], q.agg, scale).select("value").scalar()
        groups = parts.join(_values(used, ["key"], q.agg, scale), "key", "left").withColumn("overall", overall)
        if q.agg == "distinct":
            groups = groups.withColumn("value", F.coalesce("value", F.lit(0).cast("decimal(38,0)")))
    sort = q.sort or ("time" if q.group_by and profile[q.group_by].kind == "period" else "value-desc")
    orders = {
        "value-desc": [F.desc_nulls_last("value"), F.lower("label")],
        "value-asc": [F.asc_nulls_first("value"), F.lower("label")],
        "label": [F.lower("label")],
        "time": [F.col("key")] if q.group_by and (profile[q.group_by].kind == "period" or q.bucket) else [F.lower("label")],
    }[sort]
    out = ["label", "key", "value", "rows", "overall"]
    if q.limit is None:
        return Result(groups.select(*out).orderBy(*orders, "key"), accounting)
    top = groups.select(*out).orderBy(*orders, "key", "rows").limit(q.limit)  # keys differ; rows are named so that every use of the parts has the same columns
    if not q.other or q.group_by is None:
        return Result(top, accounting)
    names = F.broadcast(top.select("key"))  # at most 50 rows
    others = parts.join(names, "key", "left_anti")
    count = [F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("_k")]
    if merging:
        folded = others.agg(F.max("label").alias("_any"), *[c.alias(n) for n, c in again.items()], *count).filter("rows > 0 or _any is not null").withColumn("value", value)
    else:
        rest = _values(used.join(names, "key", "left_anti"), [], q.agg, scale).select("value").scalar()
        folded = others.agg(*count).filter("rows > 0").withColumn("value", rest)
    other = folded.select(F.concat(F.lit("Other ("), F.col("_k").cast("string"), F.lit(")")).alias("label"), F.lit("__other").alias("key"), "value", "rows")
    return Result(top.unionByName(other.withColumn("overall", overall).select(*out)), accounting)
