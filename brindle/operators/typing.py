"""Profiles of text tables and their typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import add_number
from brindle.functions.periods import parse_period
from brindle.functions.text import MISSING, collapse, group_key, is_missing, is_url, site_of

#: Header words that decide a column's kind (fixed values).
MEASURE_NAME = r"(?i)price|cost|amount|revenue|sales|range|battery|power|speed|capacity|score|count|qty|quantity|value|volume|percentage|percent|charging.*time|duration"
CATEGORY_NAME = r"(?i)segment|type|class|category|variant|grade|tier|size|model|code"
ID_NAME = r"(?i)(^|\b|_)(id|no|sr|s\.?no|serial|rank|index|#)(\b|_|$)"
TIME_NAME = r"(?i)date|year|month|quarter|period|time|day"


@dataclass(frozen=True)
class ColumnProfile:
    """What one aggregate pass learned about a column."""

    name: str
    kind: str
    filled: int
    missing: int
    distinct: int
    scale: int
    currency: str | None
    suffix: str | None
    id_like: bool
    grain: str | None = None


def cells_of(df: DataFrame, columns: list[str], row: str = "_row") -> DataFrame:
    """One row per cell (row, name, cell): the table turned long, so one job reads all columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("cell")) for c in columns])
    return df.select(F.col(row).alias("_row"), F.explode(cells).alias("_c")).select("_row", "_c.name", "_c.cell")


def profile_table(df: DataFrame, columns: list[str], row: str = "_row") -> DataFrame:
    """One row per column: counts, kind, scale, majority currency, suffix and grain.

    Equal cells are counted first, so each is read once however often it
    occurs; what is read is summed by (column, currency, suffix, grain), and
    counts and majorities all come from that small table.
    """
    cells = cells_of(df, columns, row).groupBy("name", F.lower(collapse(F.col("cell"))).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("cell", "_row").alias("cell"), F.min("_row").alias("first"), F.max("_row").alias("last"), F.sum(F.char_length("cell")).alias("length")
    )
    cells = add_number(cells, "cell", "num").withColumn("there", ~F.col("key").isin(*MISSING))
    cells = cells.withColumn("period", F.explode(F.array(F.when(F.col("there"), parse_period(F.col("cell"))))))
    there, value = F.col("there"), F.col("num.value")
    decimals = F.when(value.isNotNull(), F.char_length(F.regexp_replace(F.regexp_extract(value.cast("string"), r"\.(\d+)$", 1), "0+$", "")))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    parts = cells.groupBy("name", F.col("num.currency").alias("currency"), F.col("num.suffix").alias("suffix"), F.col("period.grain").alias("grain")).agg(
        F.sum("n").alias("rows"),
        total(there).alias("filled"),
        F.count_if(there).alias("distinct"),
        total(there & is_url(F.col("cell"))).alias("urls"),
        total(F.col("num").isNotNull()).alias("numbers"),
        total(F.col("num.currency").isNotNull()).alias("monies"),
        total(F.coalesce(F.col("num.percent"), F.lit(False))).alias("percents"),
        total(F.col("period").isNotNull()).alias("periods"),
        total(there & F.col("cell").rlike(r"^\d{4}$")).alias("plain_years"),
        total(there & F.col("cell").rlike(r"(?i)^\d{1,2}[a-z]{1,4}$")).alias("codes"),
        F.sum(F.when(there, F.col("length"))).alias("length"),
        F.max(decimals).alias("scale"),
        F.min(F.when(there, F.col("first"))).alias("first"),
        F.count_if((F.col("n") == 1) & (value == F.col("first") + 1)).alias("in_order"),
    )
    for c in ("currency", "suffix", "grain"):
        own = Window.partitionBy("name", c)
        parts = parts.withColumn(f"_{c}", F.when(F.col(c).isNotNull(), F.struct(F.sum("filled").over(own).alias("n"), (-F.min("first").over(own)).alias("first"))))
    sums = [F.sum(c).alias(c) for c in ("rows", "filled", "distinct", "urls", "numbers", "monies", "percents", "periods", "plain_years", "codes", "in_order")]
    s = parts.groupBy("name").agg(
        *sums, F.coalesce(F.max("scale"), F.lit(0)).alias("scale"), (F.sum("length") / F.nullif(F.sum("filled"), F.lit(0))).alias("mean_length"), *[F.max_by(c, f"_{c}").alias(c) for c in ("currency", "suffix", "grain")]
    ).withColumn("missing", F.col("rows") - F.col("filled"))
    most = F.greatest(F.lit(1), F.ceil(0.8 * F.col("filled")))
    named, timed, grouped = F.col("name").rlike(MEASURE_NAME), F.col("name").rlike(TIME_NAME), F.col("name").rlike(CATEGORY_NAME)
    few = (F.col("distinct") <= F.when(grouped, 20).otherwise(12)) & (F.col("distinct") <= 0.5 * F.col("filled"))
    code_like = few & ((F.col("codes") >= most) | grouped)
    numeric = ((F.col("numbers") >= most) | (named & (F.col("numbers") >= 2) & (F.col("numbers") >= 0.2 * F.col("filled")))) & ~code_like
    period = (F.col("periods") >= most) & (timed | ((F.col("periods") > F.col("numbers")) & (F.col("plain_years") < F.col("filled"))))
    category = (F.col("distinct") >= 1) & (F.col("mean_length") <= 48) & ((F.col("distinct") <= 12) | (F.col("distinct") <= F.ceil(0.6 * F.col("filled"))))
    kind = (
        F.when(F.col("filled") == 0, "empty").when(F.col("urls") >= most, "url").when(period, "period")
        .when(numeric & (F.col("monies") > 0.5 * F.col("numbers")), "money").when(numeric & (F.col("percents") > 0.5 * F.col("numbers")), "percent")
        .when(numeric, "number").when(category, "category").otherwise("text")
    )
    id_like = numeric & (F.col("name").rlike(ID_NAME) | ((F.col("in_order") == F.col("filled")) & (F.col("filled") > 2)))
    return s.select("name", kind.alias("kind"), "rows", "filled", "missing", "distinct", "scale", "currency", "suffix", id_like.alias("id_like"), "grain")


def collect_profile(df: DataFrame, columns: list[str], row: str = "_row") -> dict[str, ColumnProfile]:
    """The profile on the driver: a row for each column of the table."""
    return {
        r["name"]: ColumnProfile(r["name"], r["kind"], r["filled"], r["missing"], r["distinct"], r["scale"], r["currency"], r["suffix"], r["id_like"], r["grain"])
        for r in profile_table(df, columns, row).collect()
    }


def add_typed(df: DataFrame, profile: dict[str, ColumnProfile], columns: list[str]) -> DataFrame:
    """Adds c__key, c__label and, by kind, c__num, c__ranged, c__excl or c__period to each named column."""
    for name in columns:
        p = profile[name]
        cell = F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
        label = site_of(cell) if p.kind == "url" else collapse(cell)
        df = df.withColumn(f"{name}__key", F.when(~is_missing(cell), group_key(label))).withColumn(f"{name}__label", label)
        if p.kind in ("number", "money", "percent"):
            df = add_number(df.withColumn("_cell", cell), "_cell", "_num")
            odd = (F.col("_num.currency") != F.lit(p.currency)) if p.currency else F.lit(False)
            unit = (F.col("_num.suffix") != F.lit(p.suffix)) if p.suffix else F.lit(False)
            why = F.when(is_missing(cell), None).when(F.col("_num").isNull(), "unreadable").when(odd, "other currency").when(unit, "other unit")
            df = df.withColumn(f"{name}__excl", why).withColumn(f"{name}__num", F.when(why.isNull(), F.col("_num.value")))
            df = df.withColumn(f"{name}__ranged", F.col(f"{name}__num").isNotNull() & F.coalesce(F.col("_num.ranged"), F.lit(False))).drop("_cell", "_num")
        elif p.kind == "period":
            df = df.withColumn("_p", F.explode(F.array(parse_period(cell)))).withColumn(f"{name}__period", F.when(F.col("_p.grain") == F.lit(p.grain), F.col("_p"))).drop("_p")
            df = df.withColumn(f"{name}__key", F.col(f"{name}__period.key")).withColumn(f"{name}__label", F.col(f"{name}__period.label"))
    return df
