"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import numbers, periods, text
from brindle.operators import charts, core, merge, places, rows, typing
from brindle.plans.query import Filter, Query, run_plan
from brindle.sources import readers
from brindle.streaming import limits, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_row"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.to_date("o_orderdate").cast("string").alias("ordered"),
    )


_ORDER_COLUMNS = ["priority", "status", "price", "ordered"]
_ORDER_PROFILE = {
    "priority": typing.ColumnProfile("priority", "category", 0, 0, 5, 0, None, None, False),
    "status": typing.ColumnProfile("status", "category", 0, 0, 3, 0, None, None, False),
    "price": typing.ColumnProfile("price", "number", 0, 0, 0, 2, None, None, False),
    "ordered": typing.ColumnProfile("ordered", "period", 0, 0, 0, 0, None, None, False, "day"),
}


def _plan(spark: SparkSession, sf_dir: str, q: Query) -> DataFrame:
    names = {c for c in (q.measure, q.group_by, *(f.column for f in q.filters)) if c}
    typed = typing.add_typed(_orders(spark, sf_dir), _ORDER_PROFILE, sorted(names))
    return run_plan(typed, _ORDER_PROFILE, q, _ORDER_COLUMNS).rows.select("label", F.col("value").cast("double").alias("value"), "rows", F.col("overall").cast("double").alias("overall"))


_P = "CAST(o_totalprice AS DECIMAL(18,2))"


def _agg_sql(value: str) -> str:
    return f"SELECT o_orderpriority AS label, CAST({value} AS DOUBLE) AS value, count(*) AS rows, (SELECT CAST({value} AS DOUBLE) FROM orders) AS overall FROM orders GROUP BY o_orderpriority"


# ---------------------------------------------------------------- aggregates
@register(_agg_sql("count(*)"))
def agg_count(spark, sf_dir):
    return _plan(spark, sf_dir, Query("count", group_by="priority"))


@register(_agg_sql(f"sum({_P})"))
def agg_sum(spark, sf_dir):
    return _plan(spark, sf_dir, Query("sum", "price", "priority"))


@register(_agg_sql(f"round_even(CAST(sum({_P}) AS DECIMAL(38,6)) / count(*), 4)"))
def agg_avg(spark, sf_dir):
    return _plan(spark, sf_dir, Query("avg", "price", "priority"))


@register(_agg_sql(f"min({_P})"))
def agg_min(spark, sf_dir):
    return _plan(spark, sf_dir, Query("min", "price", "priority"))


@register(_agg_sql(f"max({_P})"))
def agg_max(spark, sf_dir):
    return _plan(spark, sf_dir, Query("max", "price", "priority"))


@register(_agg_sql(f"median(CAST({_P} AS DECIMAL(20,3)))"))
def agg_median(spark, sf_dir):
    return _plan(spark, sf_dir, Query("median", "price", "priority"))


@register(_agg_sql("count(DISTINCT o_orderstatus)"))
def agg_distinct(spark, sf_dir):
    return _plan(spark, sf_dir, Query("distinct", "status", "priority"))


@register(f"SELECT 'All rows' AS label, CAST(sum({_P}) AS DOUBLE) AS value, count(*) AS rows, CAST(sum({_P}) AS DOUBLE) AS overall FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0")
def agg_no_key(spark, sf_dir):
    return _plan(spark, sf_dir, Query("sum", "price", filters=(Filter("in", "status", ("f",)),)))


@register(f"""
    WITH g AS (SELECT o_orderpriority AS k, sum({_P}) AS v, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, lower(k)) AS rn FROM g)
    SELECT CASE WHEN rn <= 3 THEN k ELSE 'Other (' || (SELECT count(*) - 3 FROM g) || ')' END AS label, CAST(sum(v) AS DOUBLE) AS value, CAST(sum(n) AS BIGINT) AS rows,
           (SELECT CAST(sum(v) AS DOUBLE) FROM g) AS overall
    FROM r GROUP BY 1
""")
def topn_other(spark, sf_dir):
    return _plan(spark, sf_dir, Query("sum", "price", "priority", limit=3, other=True))


@register(f"""
    SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS label, CAST(sum({_P}) AS DOUBLE) AS value, count(*) AS rows,
           (SELECT CAST(sum({_P}) AS DOUBLE) FROM orders) AS overall FROM orders GROUP BY 1
""")
def period_bucket_quarter(spark, sf_dir):
    return _plan(spark, sf_dir, Query("sum", "price", "ordered", bucket="quarter"))


@register("SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(count(*) AS DOUBLE) AS value, count(*) AS rows, (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS overall FROM orders GROUP BY 1")
def period_bucket_month(spark, sf_dir):
    return _plan(spark, sf_dir, Query("count", group_by="ordered", bucket="month"))


@register("SELECT strftime(o_orderdate, '%Y') AS label, CAST(count(*) AS DOUBLE) AS value, count(*) AS rows, (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS overall FROM orders GROUP BY 1")
def period_bucket_year(spark, sf_dir):
    return _plan(spark, sf_dir, Query("count", group_by="ordered", bucket="year"))


def _messy_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    cell = (
        F.when(F.col("p_partkey") % 7 == 0, F.lit("N/A")).when(F.col("p_partkey") % 11 == 0, F.lit("Contact us"))
        .when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("₹"), n, F.lit(".5 Lakh"))).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("₹ "), n, F.lit(",000")))
        .when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("₹"), n, F.lit(" – ₹"), (F.col("p_size") + 10).cast("string"), F.lit(" Lakh"))).otherwise(F.concat(F.lit("Rs. "), n))
    )
    return p.select(F.col("p_partkey").alias("_row"), F.col("p_brand").alias("brand"), cell.alias("price_inr"))


_MESSY = """
    SELECT p_partkey, p_brand, p_size,
           CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN (p_size + 0.5) * 100000 WHEN p_partkey % 3 = 0 THEN p_size * 1000.0
                WHEN p_partkey % 13 = 0 THEN p_size * 100000.0 ELSE p_size * 1.0 END AS v,
           p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 13 = 0 AS ranged
    FROM part
"""


@register(f"SELECT p_partkey, CAST(v AS DOUBLE) AS value, CASE WHEN v IS NOT NULL THEN 'INR' END AS currency, CASE WHEN v IS NOT NULL THEN ranged END AS ranged FROM ({_MESSY})")
def parse_number_messy(spark, sf_dir):
    df = numbers.add_number(_messy_parts(spark, sf_dir), "price_inr", "n")
    return df.select(F.col("_row").alias("p_partkey"), F.col("n.value").cast("double").alias("value"), F.col("n.currency").alias("currency"), F.col("n.ranged").alias("ranged"))


@register("""
    SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN -p_size * 1000.0 WHEN 1 THEN p_size + 0.4 WHEN 2 THEN p_size * 10000000.0 WHEN 3 THEN p_size * 1.0 WHEN 4 THEN NULL ELSE p_size * 1000000.0 END AS DOUBLE) AS value,
           CASE p_partkey % 6 WHEN 3 THEN 'km' END AS suffix, CASE WHEN p_partkey % 6 <> 4 THEN p_partkey % 6 = 1 END AS percent,
           CASE p_partkey % 6 WHEN 2 THEN 'crore' WHEN 5 THEN 'million' END AS scale
    FROM part
""")
def parse_number_forms(spark, sf_dir):
    n = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("("), n, F.lit(",000)")), F.concat(n, F.lit(".4%")), F.concat(n, F.lit(" Cr")), F.concat(n, F.lit(" km")), F.concat(n, F.lit("-"), n), F.concat(F.lit("$"), n, F.lit("m"))]
    cell = F.element_at(F.array(*forms), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    df = numbers.add_number(read(spark, sf_dir, "part").select("p_partkey", cell.alias("cell")), "cell", "n")
    return df.select("p_partkey", F.col("n.value").cast("double").alias("value"), F.col("n.suffix").alias("suffix"), F.col("n.percent").alias("percent"), F.col("n.scale").alias("scale"))


@register(f"""
    SELECT count(*) AS matched, count(v) AS used, count(*) FILTER (v IS NULL AND p_partkey % 7 = 0) AS blank, count(*) FILTER (ranged AND v IS NOT NULL) AS ranged,
           count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 11 = 0) AS excluded FROM ({_MESSY})
""")
def agg_accounting(spark, sf_dir):
    profile = {"brand": typing.ColumnProfile("brand", "category", 0, 0, 0, 0, None, None, False), "price_inr": typing.ColumnProfile("price_inr", "money", 0, 0, 0, 1, "INR", None, False)}
    typed = typing.add_typed(_messy_parts(spark, sf_dir), profile, ["brand", "price_inr"])
    return run_plan(typed, profile, Query("avg", "price_inr", "brand"), ["brand", "price_inr"]).accounting


@register("""
    WITH s AS (SELECT count(*) AS rows, count(*) FILTER (p_partkey % 7 <> 0) AS filled, count(*) FILTER (p_partkey % 7 = 0) AS missing FROM part)
    SELECT 'brand' AS name, 'category' AS kind, rows, rows AS filled, CAST(0 AS BIGINT) AS missing, CAST(NULL AS VARCHAR) AS currency FROM s
    UNION ALL SELECT 'price_inr', 'money', rows, filled, missing, 'INR' FROM s
""")
def profile_columns(spark, sf_dir):
    return typing.profile_table(_messy_parts(spark, sf_dir), ["brand", "price_inr"]).select("name", "kind", "rows", "filled", "missing", "currency")


# ---------------------------------------------------------------- filters
def _typed_orders(spark, sf_dir, *names):
    return typing.add_typed(_orders(spark, sf_dir), _ORDER_PROFILE, list(names))


def _filtered(spark, sf_dir, *filters: Filter) -> DataFrame:
    q = Query("count", filters=filters)
    df = _typed_orders(spark, sf_dir, *sorted({f.column for f in filters if f.column}))
    from brindle.plans.query import condition

    for f in q.filters:
        df = df.filter(condition(f, _ORDER_PROFILE, _ORDER_COLUMNS))
    return df.select(F.col("_row").alias("o_orderkey"))


@register("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent') OR contains(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'urgent') OR contains(strftime(o_orderdate, '%Y-%m-%d'), 'urgent')")
def flt_search(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("search", values=(" URGENT ",)))


@register("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'high')")
def flt_contains(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("contains", "priority", ("HIGH",)))


@register("SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus IN ('F', 'O'), FALSE)")
def flt_in(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("in", "status", ("f", "O")))


@register("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus IN ('F'), FALSE)")
def flt_not_in(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("notIn", "status", ("F",)))


@register("SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 150000")
def flt_gte(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("gte", "price", (150000,)))


@register("SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) <= 150000")
def flt_lte(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("lte", "price", (150000,)))


@register("SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) BETWEEN 100000 AND 200000")
def flt_between(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("between", "price", (100000, 200000)))


@register("SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL")
def flt_present(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("present", "priority"), Filter("present", "price"))


@register("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1995-03', '1996-07')")
def flt_in_bucket(spark, sf_dir):
    return _filtered(spark, sf_dir, Filter("in", "ordered", ("1995-03", "1996-07"), "month"))


@register("SELECT p_partkey, p_partkey % 4 IN (0, 2) AS missing FROM part")
def flt_missing(spark, sf_dir):
    cells = F.array(F.lit(" N/A "), F.lit("0"), F.lit("not   Available"), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", text.is_missing(F.element_at(cells, (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))).alias("missing"))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def flt_period_limit(spark, sf_dir):
    from datetime import date

    low, high = periods.limit_of("orders between 1995 and 1996", date(2024, 6, 1))
    cell = F.when(F.col("o_orderkey") % 10 == 0, F.lit("undated")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    day = periods.parse_date(cell)
    return read(spark, sf_dir, "orders").filter(day.isNull() | day.between(low, high)).select("o_orderkey")


# ---------------------------------------------------------------- periods
@register("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_date_forms(spark, sf_dir):
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d MMM yyyy"), F.date_format(d, "MMMM d, yyyy"), F.concat(F.date_format(d, "dd-MM-yyyy"), F.lit(" [3]"))]
    return read(spark, sf_dir, "orders").select("o_orderkey", periods.parse_date(F.element_at(F.array(*forms), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))).alias("day"))


@register("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)
           ELSE 'FY' || strftime(o_orderdate, '%Y') || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') END AS key,
           CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter' ELSE 'fiscal' END AS grain FROM orders
""")
def parse_period_forms(spark, sf_dir):
    d = F.col("o_orderdate")
    forms = [
        F.date_format(d, "d-MMM-yyyy"), F.date_format(d, "MMMM yyyy"), F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string")),
        F.concat(F.lit("FY "), F.year(d).cast("string"), F.lit("-"), (F.year(d) + 1).cast("string")),
    ]
    p = periods.parse_period(F.element_at(F.array(*forms), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int")))
    return read(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.key", "p.grain")


@register("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS key, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS ordinal FROM orders")
def period_keys(spark, sf_dir):
    key = F.date_format("o_orderdate", "yyyy-MM")
    return read(spark, sf_dir, "orders").select(key.alias("key"), periods.ordinal(key).alias("ordinal")).distinct()


# ---------------------------------------------------------------- charts and statistics
@register("""
    WITH e AS (SELECT CAST(ts AS DATE) AS d FROM events), b AS (SELECT min(d) AS a, max(d) AS z FROM e), c AS (SELECT d, count(*) AS n FROM e GROUP BY d)
    SELECT CAST(s.step AS DATE) AS step, coalesce(c.n, 0) AS n FROM b, generate_series(b.a, b.z, INTERVAL 1 DAY) AS s(step) LEFT JOIN c ON c.d = CAST(s.step AS DATE)
""")
def timeline_gap_fill(spark, sf_dir):
    return charts.timeline(read(spark, sf_dir, "events"), F.to_date("ts"))


@register("""
    WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
    p AS (SELECT lo, hi, pow(10, floor(log10((hi - lo) / 6))) AS e FROM b),
    s AS (SELECT lo, hi, CASE WHEN e * 6 >= hi - lo - 1e-9 THEN e WHEN 2 * e * 6 >= hi - lo - 1e-9 THEN 2 * e WHEN 2.5 * e * 6 >= hi - lo - 1e-9 THEN 2.5 * e WHEN 5 * e * 6 >= hi - lo - 1e-9 THEN 5 * e ELSE 10 * e END AS w FROM p),
    t AS (SELECT w, floor(lo / w) * w AS a, greatest(0, ceil((hi - floor(lo / w) * w) / w - 1e-9) - 1) AS last FROM s),
    c AS (SELECT least(floor((p_retailprice - a) / w + 1e-9), last) AS b, count(*) AS n FROM part, t GROUP BY 1)
    SELECT CAST(r.i AS INTEGER) AS bin, a + r.i * w AS lower, a + (r.i + 1) * w AS upper, coalesce(n, 0) AS n FROM t, range(0, CAST((SELECT last FROM t) AS BIGINT) + 1) AS r(i) LEFT JOIN c ON c.b = r.i
""")
def histogram(spark, sf_dir):
    return charts.histogram(read(spark, sf_dir, "part"), "p_retailprice")


@register("""
    WITH g AS (SELECT lang AS name, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k FROM g)
    SELECT CASE WHEN k <= 2 THEN name ELSE 'Other' END AS name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1
""")
def top_categories(spark, sf_dir):
    return charts.top_categories(read(spark, sf_dir, "documents"), "lang", 2)


@register("""
    WITH v AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    l AS (SELECT g, list_sort(list(x)) AS s, count(*) AS n FROM v GROUP BY g),
    q AS (SELECT g, s, n, least(greatest(0.9 * (n + 1), 1.0), n) AS pos FROM l)
    SELECT v.g AS l_returnflag, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stdev, round(corr(x, y), 6) AS correlation, round(regr_slope(y, x), 4) AS slope,
           round(exp(avg(ln(x))), 6) AS geometric_mean, round(count(x) / sum(1 / x), 6) AS harmonic_mean,
           round(any_value(s[CAST(floor(pos) AS BIGINT)] + (s[least(CAST(floor(pos) AS BIGINT) + 1, n)] - s[CAST(floor(pos) AS BIGINT)]) * (pos - floor(pos))), 6) AS q90
    FROM v JOIN q USING (g) GROUP BY v.g
""")
def stats_by_group(spark, sf_dir):
    s = charts.statistics(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return s.select("l_returnflag", *[F.round(c, 4 if c == "slope" else 6).alias(c) for c in ("mean", "stdev", "correlation", "slope", "geometric_mean", "harmonic_mean", "q90")])


@register("""
    WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS ordinal, count(*) AS n FROM orders WHERE month(o_orderdate) NOT IN (4, 5) GROUP BY 1),
    g AS (SELECT *, coalesce(ordinal - lag(ordinal) OVER (ORDER BY ordinal) > 1, FALSE) AS gap FROM m)
    SELECT CAST(ordinal AS BIGINT) AS ordinal, n, gap, CAST(sum(CAST(gap AS INTEGER)) OVER (ORDER BY ordinal) AS BIGINT) AS run FROM g
""")
def trend_gaps(spark, sf_dir):
    m = read(spark, sf_dir, "orders").filter(~F.month("o_orderdate").isin(4, 5)).groupBy(periods.ordinal(F.date_format("o_orderdate", "yyyy-MM")).alias("ordinal")).agg(F.count(F.lit(1)).alias("n"))
    return charts.with_gaps(m, "ordinal")


@register("""
    WITH g AS (SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders GROUP BY 1)
    SELECT y, n, CAST(round_even(CAST(n AS DECIMAL(20,4)) * 100 / sum(n) OVER (), 2) AS DOUBLE) AS share, n > avg(n) OVER () AS above,
           CAST(round_even(CAST((n - lag(n) OVER (ORDER BY y)) AS DECIMAL(20,4)) * 100 / lag(n) OVER (ORDER BY y), 2) AS DOUBLE) AS growth FROM g
""")
def share_and_growth(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    every, before = Window.partitionBy(F.lit(1)), F.lag("n").over(Window.orderBy("y"))
    return g.select("y", "n", numbers.percent_of(F.col("n"), F.sum("n").over(every)).cast("double").alias("share"), (F.col("n") > F.avg("n").over(every)).alias("above"), numbers.percent_of(F.col("n") - before, before).cast("double").alias("growth"))


@register("SELECT count(*) AS rows, CAST(5 AS INTEGER) AS columns, CAST(round(CAST(count(doc_id) + count(text) + count(lang) + count(source) + count(n_chars) AS DOUBLE) / (count(*) * 5), 4) AS DOUBLE) AS fill_rate, count(DISTINCT source) AS sources FROM documents")
def dataset_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    filled = sum((F.count(c) for c in ("text", "lang", "source", "n_chars")), F.count("doc_id"))
    return d.agg(F.count(F.lit(1)).alias("rows"), F.lit(5).alias("columns"), F.round(filled / (F.count(F.lit(1)) * 5), 4).alias("fill_rate"), F.count_distinct("source").alias("sources"))


@register("SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS site, count(*) AS n FROM pages GROUP BY 1")
def rows_per_site(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(text.site_of(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT lower(c_mktsegment) AS key, count(*) AS n, arg_min(c_mktsegment, c_custkey) AS label FROM customer GROUP BY 1")
def value_list(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy(text.group_key(F.col("c_mktsegment")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min_by("c_mktsegment", "c_custkey").alias("label"))


# ---------------------------------------------------------------- joins and sets
@register("SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE length(d.text) > 50 AND l.toxic = 0 ORDER BY l.doc_id DESC LIMIT 10")
def join_inner_newest(spark, sf_dir):
    pair = read(spark, sf_dir, "labels").filter("toxic = 0").join(read(spark, sf_dir, "documents").filter(F.length("text") > 50), "doc_id")
    return pair.select("doc_id", "quality", "lang").orderBy(F.desc("doc_id")).limit(10)


@register("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("SELECT n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON n_nationkey = c_nationkey")
def join_counts(spark, sf_dir):
    n = read(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return core.join_small(read(spark, sf_dir, "nation"), n, "n_nationkey").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@register("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS v FROM customer UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier")
def back_fill(spark, sf_dir):
    """All customers with a third of the names blank, and a reference of all customers and suppliers."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    table = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("v"))
    reference = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")).union(s.select(-1 - F.col("s_suppkey"), "s_name"))
    return merge.back_fill(table, reference, "k", ["v"])


@register("SELECT r.r_name AS area, n.n_name AS term, (n.t - r.a + 25) % 25 AS shift FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS a FROM region) r, (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS t FROM nation) n")
def latin_square(spark, sf_dir):
    areas = read(spark, sf_dir, "region").select(F.col("r_name").alias("area"), (F.row_number().over(Window.orderBy("r_regionkey")) - 1).alias("a"))
    terms = read(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), (F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("t"))
    return places.search_order(areas, terms).select("area", "term", F.col("shift").cast("long").alias("shift"))


@register("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def group_cap(spark, sf_dir):
    return core.first_per_group(read(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("doc_id", "source")


@register("SELECT min(doc_id) AS doc_id, md5(lower(coalesce(text, ''))) AS k, count(*) AS n FROM documents GROUP BY 2")
def keep_first(spark, sf_dir):
    """Documents by a digest of their lower-cased text, so that the window moves no texts."""
    k = F.md5(F.lower(F.coalesce("text", F.lit(""))))
    d = read(spark, sf_dir, "documents").select("doc_id", k.alias("k"))
    counts = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return core.keep_first(d, ["k"], ["doc_id"]).join(counts, "k").select("doc_id", "k", "n")


@register("SELECT r_name AS name, row_number() OVER (ORDER BY r_name) AS place FROM region UNION ALL SELECT n_name, row_number() OVER (ORDER BY n_name) FROM nation")
def interleave(spark, sf_dir):
    a = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(1).alias("list"))
    b = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(2).alias("list"))
    place = F.row_number().over(Window.partitionBy("list").orderBy("name"))
    return a.unionByName(b).withColumn("place", place).orderBy("place", "list").select("name", F.col("place").cast("long").alias("place"))


@register("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)")
def key_difference(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_orderkey").exceptAll(o.filter("o_totalprice < 100000").select("o_orderkey"))


@register("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def page_rows(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(100).limit(50)


# ---------------------------------------------------------------- merge
@register("SELECT s.c_nationkey AS k, count(*) AS n_rows, arg_min(c_name, c_custkey) FILTER (c_custkey % 4 <> 0) AS name, arg_min(c_mktsegment, c_custkey) AS segment FROM customer s GROUP BY 1")
def merge_fold(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    return merge.coalesce_fold(c, "k", "c_custkey", ["name", "segment"]).select("k", "n_rows", "name", "segment")


@register("SELECT c_custkey, substr(sha1(lower(c_name) || '|' || lower(c_mktsegment)), 1, 12) AS h FROM customer")
def row_hash(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.row_hash(F.col("c_name"), F.col("c_mktsegment")).alias("h"))


@register("SELECT c_custkey AS k, c_mktsegment AS v, FALSE AS is_new FROM customer UNION ALL SELECT -1 - s_suppkey, s_name, TRUE FROM supplier")
def upsert_rows(spark, sf_dir):
    """All customers are stored; all of them change and all suppliers are new."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(1).alias("seq"))
    new = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit(2).alias("seq")).union(s.select(-1 - F.col("s_suppkey"), "s_name", F.lit(2)))
    return merge.upsert(old, new, "k", "seq").select("k", "v", "is_new")


@register("SELECT c_nationkey AS page, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 THEN c_mktsegment || '|' || substr(sha1(lower(c_name)), 1, 12) ELSE c_mktsegment END AS ident FROM customer")
def duplicate_ids(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_mktsegment").alias("ident"), "c_name")
    return merge.duplicate_ids(c, "page", "ident", ["c_name"]).select("page", "ident")


# ---------------------------------------------------------------- text, sites, JSON
@register("SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '')) AS site FROM pages")
def site_of(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.site_of(F.col("url")).alias("site"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_get(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@register("""
    WITH s AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 4 ELSE 0 END) + (CASE WHEN contains(lower(text), 'token') THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(text), 'disgusting') THEN 1 ELSE 0 END) AS score FROM documents)
    SELECT doc_id, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS tier FROM s
""")
def keyword_score(spark, sf_dir):
    score = text.keyword_score(F.col("text"), {"license": 4, "token": 5, "the": 2, "disgusting": 1})
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("score"), text.tier(score).alias("tier"))


@register("""
    WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')), ' '), lambda x: x <> '')) AS w FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(a.w || b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) ELSE 0 END, 6) AS share
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def jaccard_turns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("text"), F.col("after")), 6).alias("share"))


@register()
def html_tables(spark, sf_dir):
    return readers.scan_html_tables(read(spark, sf_dir, "pages"))


@register("""
    WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, html, trim(regexp_replace(t, '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) AS text FROM a)
    SELECT page_id, text, length(html) >= 5000 AND length(text) < 4000 AND length(text) < 0.02 * length(html) AS needs_script FROM b
""")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"), text.needs_script(F.col("html")).alias("needs_script"))


@register("""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\\s*[\\[(]\\s*at\\s*[\\])]\\s*', '@', 'g'), '\\s*[\\[(]\\s*dot\\s*[\\])]\\s*', '.', 'g') AS t FROM documents),
    b AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,}'))) AS emails FROM a)
    SELECT doc_id, emails FROM b WHERE len(emails) > 0
""")
def email_list(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.emails(F.col("text")).alias("emails")).filter(F.size("emails") > 0)


# ---------------------------------------------------------------- live rules over events
@register("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, TRUE AS allowed, [t] AS log FROM e WHERE rn = 1
          UNION ALL
          SELECT e.user_id, e.event_id, e.rn, len(list_filter(f.log, lambda x: x > e.t - 86400000000)) < 3,
                 CASE WHEN len(list_filter(f.log, lambda x: x > e.t - 86400000000)) < 3 THEN list_append(list_filter(f.log, lambda x: x > e.t - 86400000000), e.t) ELSE list_filter(f.log, lambda x: x > e.t - 86400000000) END
          FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, user_id, allowed FROM f
""")
def rate_limit(spark, sf_dir):
    return limits.sliding_limit(read(spark, sf_dir, "events"), "user_id", "ts", 3, 86_400).select("event_id", "user_id", "allowed")


@register("""
    WITH RECURSIVE e AS (SELECT event_id AS seq, user_id, CAST(ts AS DATE) AS day, event_id % 5 + 1 AS calls, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, seq, day, calls, rn, TRUE AS charged, calls AS d, calls AS m FROM e WHERE rn = 1
          UNION ALL
          SELECT user_id, seq, day, calls, rn, ok, d + CASE WHEN ok THEN calls ELSE 0 END, m + CASE WHEN ok THEN calls ELSE 0 END FROM (
              SELECT e.*, CASE WHEN f.day = e.day THEN f.d ELSE 0 END AS d, CASE WHEN strftime(f.day, '%Y-%m') = strftime(e.day, '%Y-%m') THEN f.m ELSE 0 END AS m,
                     (CASE WHEN f.day = e.day THEN f.d ELSE 0 END) + e.calls <= 8 AND (CASE WHEN strftime(f.day, '%Y-%m') = strftime(e.day, '%Y-%m') THEN f.m ELSE 0 END) + e.calls <= 60 AS ok
              FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
    SELECT user_id, seq, day, calls, charged FROM f
""")
def usage_meter(spark, sf_dir):
    usage = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), (F.pmod("event_id", F.lit(5)) + 1).cast("long").alias("calls"))
    return limits.metered(usage, 8, 60)


@register("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3")
def last_events(spark, sf_dir):
    return live.keep_recent(read(spark, sf_dir, "events"), "user_id", "event_id", 3).select("event_id", "user_id")


@register("SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS n FROM events WHERE event_id <= (SELECT max(event_id) FROM events) GROUP BY 1")
def replay_state(spark, sf_dir):
    """Each user's state as of the last event of the log."""
    e = read(spark, sf_dir, "events")
    return live.state_at(e, "user_id", "event_id", "event_type", e.agg(F.max("event_id")).scalar())


@register("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def visits_without_repeats(spark, sf_dir):
    return live.without_repeats(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type")


@register("SELECT strftime(ts, '%Y-%m') AS month, user_id, CAST(coalesce(sum(event_id % 5 + 1), 0) AS BIGINT) AS calls FROM events GROUP BY 1, 2")
def usage_by_month(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").agg(F.coalesce(F.sum(F.pmod("event_id", F.lit(5)) + 1), F.lit(0)).alias("calls"))


@register("""
    SELECT s_suppkey, least(100, CASE WHEN s_suppkey % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN s_suppkey % 50 / 10.0 >= 4.0 THEN 20 ELSE 0 END + CASE WHEN s_suppkey * 3 >= 50 THEN 15 ELSE 0 END
           + CASE WHEN s_acctbal > 0 THEN 10 ELSE 0 END + CASE WHEN s_suppkey % 3 <> 0 THEN 30 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 = 0 THEN 20 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 5 ELSE 0 END) AS score FROM supplier
""")
def lead_score(spark, sf_dir):
    k = F.col("s_suppkey")
    mark = lambda n: F.when(k % n == 0, F.lit("1"))
    score = places.lead_score((k % 50) / 10.0, k * 3, mark(2), F.when(F.col("s_acctbal") > 0, "Operational").otherwise("Closed"), k % 3 == 0, True, k % 4 == 0, mark(5))
    return read(spark, sf_dir, "supplier").select("s_suppkey", score.alias("score"))


# ---------------------------------------------------------------- rows
@register("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Home' WHEN 1 THEN 'x' WHEN 2 THEN 'What is it?' ELSE c_name END AS name FROM customer WHERE c_custkey % 5 > 2")
def junk_rows(spark, sf_dir):
    k = F.col("c_custkey") % 5
    df = read(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "Home").when(k == 1, "x").when(k == 2, "What is it?").otherwise(F.col("c_name")).alias("name"))
    return df.filter(~rows.junk_row(F.col("name")))


@register("SELECT c_custkey, c_mktsegment || ' ' || c_name AS title, c_mktsegment AS c_mkt_segment, '' AS gone FROM customer")
def map_columns(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    out = rows.map_columns(df, {"c_custkey": ["c_custkey"], "title": ["c_mktsegment", "c_name"], "c_mkt_segment": [], "gone": ["nope"]})
    return out.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@register("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def value_filter(spark, sf_dir):
    return rows.value_filter(read(spark, sf_dir, "customer"), "c_mktsegment", ["building", " Machinery"]).select("c_custkey")


@register("SELECT c_custkey FROM customer")
def value_filter_no_match(spark, sf_dir):
    return rows.value_filter(read(spark, sf_dir, "customer"), "c_mktsegment", ["nothing of it"]).select("c_custkey")


@register("""
    SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'failed' WHEN event_id % 6 = 1 THEN 'failed' WHEN event_id % 6 = 2 THEN 'blocked' WHEN event_id % 6 = 3 THEN 'failed' WHEN event_id % 6 = 4 THEN 'empty' ELSE 'ok' END AS outcome FROM events
""")
def page_outcomes(spark, sf_dir):
    k = F.pmod("event_id", F.lit(6))
    status = F.when(k == 1, 404).when(k == 2, 403).when(k == 3, 502).when(k > 3, 200)
    return read(spark, sf_dir, "events").select("event_id", rows.page_outcome(status, F.col("event_type"), F.when(k == 5, 2).otherwise(0))["outcome"].alias("outcome"))


@register("SELECT doc_id FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 20000")
def within_budget(spark, sf_dir):
    return rows.within_budget(read(spark, sf_dir, "documents"), ["source"], ["doc_id"], F.col("n_chars"), 20_000).select("doc_id")


@register("SELECT r_regionkey AS k, r_name, CAST(NULL AS VARCHAR) AS n_name FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def align_schemas(spark, sf_dir):
    return rows.align(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name"), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"))


@register("SELECT c_custkey, n FROM customer JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) USING (c_nationkey)")
def fan_out(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    kinds = c.groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("n"))
    return rows.fan_out(c.select("c_custkey", "c_nationkey"), "c_nationkey", lambda hosts: hosts.join(kinds, "c_nationkey")).select("c_custkey", "n")


@register("SELECT DISTINCT 'n' || n_nationkey AS url, CASE WHEN n_nationkey < 10 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'used' WHEN n_nationkey < 15 THEN 'planned' ELSE 'found' END AS status, CASE WHEN n_nationkey < 10 THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) ELSE 0 END AS n FROM nation")
def sources_of(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("url"))
    s = read(spark, sf_dir, "supplier").filter("s_nationkey < 10").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("url"))
    return rows.sources_of(n.filter("n_nationkey < 15"), n.filter("n_nationkey >= 5"), s)


@register("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_wins(spark, sf_dir):
    return rows.last_wins(read(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@register("WITH m AS (SELECT max(CAST(ts AS DATE)) AS t FROM events) SELECT event_id, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN 'Previous 7 days' WHEN d <= 30 THEN 'Previous 30 days' ELSE 'Older' END AS bucket FROM (SELECT event_id, t - CAST(ts AS DATE) AS d FROM events, m)")
def day_buckets(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    return e.select("event_id", rows.day_bucket(F.col("day"), e.agg(F.max("day")).scalar()).alias("bucket"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '1,23,' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ',000' ELSE CAST(p_size AS VARCHAR) END AS text FROM part")
def indian_grouping(spark, sf_dir):
    n = F.when(F.col("p_partkey") % 3 == 0, F.lit(12_300_000) + F.col("p_size") * 1000).otherwise(F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", rows.grouped_digits(n).alias("text"))


@register("""
    WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS key FROM orders) SELECT o_orderkey, key FROM m
""")
def month_and_year(spark, sf_dir):
    month, year = periods.parse_period(F.date_format("o_orderdate", "MMMM")), periods.parse_period(F.date_format("o_orderdate", "yyyy"))
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.struct(month.alias("m"), year.alias("y")))).alias("p"))
    return df.select("o_orderkey", periods.month_and_year(F.col("p.m"), F.col("p.y"))["key"].alias("key"))


@register("""
    WITH u AS (SELECT o_orderpriority AS label, CASE WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'INR' END AS unit, o_totalprice AS value, o_orderkey AS k FROM orders)
    SELECT k, unit, (SELECT count(*) FROM u WHERE unit <> 'INR') AS omitted FROM u WHERE unit = 'INR'
""")
def majority_unit(spark, sf_dir):
    u = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, "USD").otherwise("INR").alias("unit"), F.col("o_totalprice").alias("value"))
    return charts.unit_series(u, "k", "value", "unit", "k").select("k", "unit", "omitted")


@register("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS v FROM customer")
def fill_if_empty(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.lit("[]")).otherwise(F.col("c_name")).alias("v"))
    return merge.fill_if_empty(old, c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), "k", ["v"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total price by priority, highest first, top 3 and the rest, with the overall value."""
    return _plan(spark, sf_dir, Query("sum", "price", "priority", limit=3, other=True))
