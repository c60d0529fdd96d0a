"""Registered queries of records, reports, orders, links and pages, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import links, numbers, periods, text
from brindle.operators import charts, merge, places, quantiles, records, reports, rows, typing
from brindle.plans.query import Filter, Query, run_plan
from brindle.queries import ORACLE_SQL, _ORDER_COLUMNS, _ORDER_PROFILE, _orders, _typed_orders, read, register
from brindle.sources import delimited, pages, readers, sinks
from brindle.streaming import keyed, limits, live
from brindle.tables import new_path


def _text(c) -> F.Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- projects
def _projects(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("running", "idle", "paused", "error")]), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("nation "), _text("s_nationkey")).alias("source"), F.lit("made of Rows").alias("detail"), status.alias("status"),
        F.when(k % 3 == 0, "file").otherwise("web").alias("kind"), (k % 2 == 0).alias("live"), (k % 7).alias("rows"), (k % 5).alias("added"), (k % 2).alias("cycle"),
        F.date_add(F.lit(date(2024, 1, 1)), (k % 10).cast("int")).cast("timestamp").alias("updated_at"), F.lit(date(2023, 1, 1)).cast("timestamp").alias("created_at"), _text("s_nationkey").alias("user_id"),
    )


_PROJECTS = """
    (SELECT s_suppkey AS id, s_name AS title, ['running', 'idle', 'paused', 'error'][s_suppkey % 4 + 1] AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'file' ELSE 'web' END AS kind, s_suppkey % 2 = 0 AS live,
            s_suppkey % 7 AS rows, s_suppkey % 5 AS added, s_suppkey % 2 AS cycle, DATE '2024-01-01' + CAST(s_suppkey % 10 AS INTEGER) AS updated, s_nationkey FROM supplier)
"""


@register(f"SELECT id, status FROM {_PROJECTS} WHERE kind = 'web' AND live AND status <> 'error' AND contains(lower(title), '0001')")
def project_filter(spark, sf_dir):
    return reports.project_report(_projects(spark, sf_dir), " 0001 ", "live").select("id", "status")


@register(f"SELECT id, 'most-rows' AS preset FROM {_PROJECTS} WHERE rows > 0 UNION ALL SELECT id, 'today' FROM {_PROJECTS} WHERE updated >= DATE '2024-01-09' UNION ALL SELECT id, 'new-rows' FROM {_PROJECTS} WHERE added > 0 "
          f"UNION ALL SELECT id, 'failed' FROM {_PROJECTS} WHERE status = 'error' UNION ALL SELECT id, 'never-ran' FROM {_PROJECTS} WHERE kind = 'web' AND status = 'idle' AND cycle = 0 AND rows = 0")  # fmt: skip
def project_presets(spark, sf_dir):
    p, today = _projects(spark, sf_dir), F.lit(date(2024, 1, 9))
    out = None
    for name in ("most-rows", "today", "new-rows", "failed", "never-ran"):
        own = reports.project_report(p, preset=name, today=today).select("id", F.lit(name).alias("preset"))
        out = own if out is None else out.union(own)
    return out


@register(f"SELECT id, title FROM {_PROJECTS} WHERE s_nationkey = 7")
def owner_scope(spark, sf_dir):
    return reports.owned_by(_projects(spark, sf_dir), "7").select("id", "title")


@register(f"SELECT id, row_number() OVER (ORDER BY rows DESC, id) AS place FROM {_PROJECTS}")
def project_sort(spark, sf_dir):
    p = _projects(spark, sf_dir)
    ranked = p.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*reports.project_order("rows"), "id")))
    return ranked.select("id", F.col("place").cast("long").alias("place"))


@register("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus IN ('F', 'O') AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-03-01' AND '1996-08-31'")
def slicers(spark, sf_dir):
    s = reports.Slicers(" Urgent", {"status": ("f", "o"), "priority": ()}, "ordered", "1995-03-01", "1996-08-31")
    return reports.sliced(_typed_orders(spark, sf_dir, "status", "ordered"), _ORDER_PROFILE, _ORDER_COLUMNS, s).select(F.col("_row").alias("o_orderkey"))


@register("SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 200000")
def flt_gte_words(spark, sf_dir):
    """A bound in words: "2 lakh"."""
    from brindle.plans.query import condition

    return _typed_orders(spark, sf_dir, "price").filter(condition(Filter("gte", "price", ("2 lakh",)), _ORDER_PROFILE, _ORDER_COLUMNS)).select(F.col("_row").alias("o_orderkey"))


@register("SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) BETWEEN 100000 AND 200000")
def flt_between_words(spark, sf_dir):
    from brindle.plans.query import condition

    return _typed_orders(spark, sf_dir, "price").filter(condition(Filter("between", "price", ("1 lakh", "0.02 crore")), _ORDER_PROFILE, _ORDER_COLUMNS)).select(F.col("_row").alias("o_orderkey"))


# ---------------------------------------------------------------- orders and pages of rows
@register("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part QUALIFY place > 50 AND place <= 100")
def grid_sort(spark, sf_dir):
    """The second page of a grid in natural text order: "item 9" before "item 10"."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Item "), _text("p_size")).alias("name__label"))
    page = reports.grid_page(p, reports.grid_order("name", "text"), page=1, row="p_partkey")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*reports.grid_order("name", "text"), "p_partkey"))
    return page.select("p_partkey", (place + 50).cast("long").alias("place"))


@register("SELECT s_suppkey, s_suppkey % 50 AS score, s_suppkey % 9 AS reviews FROM supplier ORDER BY score DESC, reviews DESC, lower(s_name) LIMIT 20")
def lead_order(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("score"), (F.col("s_suppkey") % 9).alias("reviews"), F.col("s_name").alias("name"))
    return reports.lead_order(s).limit(20).select("s_suppkey", "score", "reviews")


@register("SELECT c_custkey FROM customer ORDER BY lower(c_mktsegment), c_custkey LIMIT 100")
def merged_order(spark, sf_dir):
    return reports.merged_order(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey").limit(100).select("c_custkey")


@register("SELECT page_id FROM (SELECT page_id, url, starts_with(url, 'https') AS s, page_id % 3 AS t, (page_id % 7) / 7.0 AS l, (page_id % 5) / 5.0 AS r FROM pages) ORDER BY s DESC, t > 0 DESC, (l + r) / 2 DESC, url LIMIT 40")
def candidate_order(spark, sf_dir):
    k = F.col("page_id")
    c = read(spark, sf_dir, "pages").select("page_id", "url", F.startswith("url", F.lit("https")).alias("https_ok"), (k % 3).alias("tables"), ((k % 7) / 7.0).alias("legit"), ((k % 5) / 5.0).alias("relevance"))
    return reports.candidate_order(c).limit(40).select("page_id")


@register("SELECT s_suppkey FROM supplier ORDER BY CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END, s_suppkey % 11 DESC, s_suppkey LIMIT 60")
def source_order(spark, sf_dir):
    state = F.element_at(F.array(*[F.lit(x) for x in reports.SOURCE_STATES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", state.alias("state"), (F.col("s_suppkey") % 11).alias("rows"))
    return reports.source_order(s, "s_suppkey").limit(60).select("s_suppkey")


# ---------------------------------------------------------------- sources
@register("""
    WITH v AS (SELECT 'n' || n_nationkey || '.org' AS site FROM nation WHERE n_nationkey < 12), w AS (SELECT 'n' || s_nationkey || '.org' AS site, count(*) AS n FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1),
    x AS (SELECT 'n' || n_nationkey || '.org' AS site FROM nation WHERE n_nationkey BETWEEN 5 AND 20), r AS (SELECT 'n' || n_nationkey || '.org' AS site, 'no ' || n_name AS reason FROM nation WHERE n_nationkey > 8),
    s AS (SELECT site FROM v UNION SELECT site FROM w UNION SELECT site FROM x UNION SELECT site FROM r), t AS (SELECT sum(n) AS t FROM w)
    SELECT s.site, CASE WHEN w.n > 0 THEN 'used' WHEN r.site IS NOT NULL THEN 'rejected' WHEN v.site IS NOT NULL THEN 'validated' ELSE 'visited' END AS state, CAST(coalesce(w.n, 0) AS BIGINT) AS rows,
           CAST(CASE WHEN w.n > 0 THEN round_even(CAST(w.n AS DECIMAL(20,4)) * 100 / t.t, 2) END AS DOUBLE) AS share, CASE WHEN w.n IS NULL THEN r.reason END AS reason
    FROM s CROSS JOIN t LEFT JOIN v USING (site) LEFT JOIN w USING (site) LEFT JOIN x USING (site) LEFT JOIN r USING (site)
""")
def merge_sites(spark, sf_dir):
    url = lambda k: F.concat(F.lit("https://www.N"), _text(k), F.lit(".org/a?b")).alias("url")
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    out = reports.merge_sites(
        n.filter("n_nationkey < 12").select(url("n_nationkey")), s.filter("s_nationkey % 2 = 0").select(url("s_nationkey")), n.filter("n_nationkey between 5 and 20").select(url("n_nationkey")),
        n.filter("n_nationkey > 8").select(url("n_nationkey"), F.concat(F.lit("no "), "n_name").alias("reason")),
    )
    return out.withColumn("share", F.col("share").cast("double"))


@register("SELECT n_regionkey AS k, CAST(pos AS INTEGER) AS pos, a[pos + 1] AS names, b[pos + 1] AS sizes FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS a, list(n_nationkey ORDER BY n_nationkey) AS b, unnest(range(0, count(*))) AS pos FROM nation GROUP BY 1)")
def by_position(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "k")
    g = n.groupBy("k").agg(F.sort_array(F.collect_list("n_name")).alias("names"), F.sort_array(F.collect_list("n_nationkey")).alias("sizes"))
    return reports.by_position(g.select("k", "names"), g.select("k", "sizes"), "k", "names", "sizes")


@register("SELECT count(*) FILTER (event_type = 'view') AS read, count(*) FILTER (value > 20) AS emails, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value IS NULL) AS skipped FROM events")
def enrichment_counters(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return reports.counters(e, read=F.col("event_type") == "view", emails=F.col("value") > 20, failed=F.col("event_type") == "error", skipped=F.col("value").isNull())


@register("SELECT count(*) AS accepted, CAST(0 AS BIGINT) AS partial, CAST(0 AS BIGINT) AS rejected FROM orders")
def rescored(spark, sf_dir):
    return reports.rescored(read(spark, sf_dir, "orders"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 WHEN p_size % 4 > 0 THEN p_size % 4 ELSE 7 END AS n FROM part")
def rendered_rows(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", reports.rendered_rows(F.col("p_partkey") % 5, F.col("p_size") % 4, F.lit(7)).alias("n"))


@register("SELECT p_partkey, greatest(10, least(40, p_size)) AS size, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || '.25' END AS json FROM part")
def clamped_numbers(spark, sf_dir):
    n = F.col("p_size") + F.when(F.col("p_size") % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.25))
    return read(spark, sf_dir, "part").select("p_partkey", reports.clamp(F.col("p_size"), 10, 40).cast("int").alias("size"), reports.json_number(n.cast("decimal(12,4)")).alias("json"))


# ---------------------------------------------------------------- ranks and sets
@register("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def queue_position(spark, sf_dir):
    q = reports.queue_position(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return q.select("event_id", "user_id", F.col("position").cast("long").alias("position"))


@register("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) > ceil(1.5 * 1000 / 5) AS deferred FROM events")
def term_cap(spark, sf_dir):
    return reports.deferred(read(spark, sf_dir, "events"), "event_type", "event_id", reports.term_cap(1000, 5)).select("event_id", "event_type", "deferred")


@register("SELECT n_regionkey, url, row_number() OVER (PARTITION BY n_regionkey ORDER BY k) AS rank FROM (SELECT n_regionkey, 'u' || s_suppkey % 8 AS url, min(s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)")
def reranked(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    url = F.concat(F.lit("u"), (F.col("s_suppkey") % 8).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "/").otherwise(""))
    out = reports.reranked(s.select("n_regionkey", url.alias("url"), F.col("s_suppkey").alias("rank")), "n_regionkey", "url", "rank")
    return out.select("n_regionkey", F.regexp_replace("url", "/$", "").alias("url"), F.col("rank").cast("long").alias("rank"))


@register("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'P' AND p.o_custkey = o.o_custkey)")
def first_answering(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return reports.first_answering([o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus = 'F'")], "o_custkey").select("o_custkey", "o_orderkey")


@register("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def allowed_keys(spark, sf_dir):
    listed = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return reports.allowed(read(spark, sf_dir, "customer"), listed, "c_nationkey").select("c_custkey")


# ---------------------------------------------------------------- records
@register("""
    SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Rs. ' || c_custkey ELSE '' END AS price, 'site' || c_nationkey || '.com' AS source, c_mktsegment AS market_segment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), '', 'site' || c_nationkey || '.com', c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0
""")
def canonical_rows(spark, sf_dir):
    k = F.col("c_custkey")
    r = read(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("number"), F.when(k % 3 != 0, F.col("c_name")).alias("Title"), F.when(k % 2 == 0, F.concat(F.lit("Rs. "), k.cast("string"))).otherwise(" ").alias("ex_showroom_cost"),
        F.col("c_mktsegment").alias("Market Segment"), F.concat(F.lit("https://www.site"), _text("c_nationkey"), F.lit(".com/x")).alias("_url"),
    )
    return records.canonical_rows(r, "_url", ["name", "price", "source", "market_segment"])


@register("SELECT p_partkey, 'Row ' || (p_partkey + 1) AS Observation FROM part")
def observation_axis(spark, sf_dir):
    return records.observation_axis(read(spark, sf_dir, "part").select("p_partkey"), [], "p_partkey")


@register("""
    SELECT 'p' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Book store' ELSE 'Shop' END AS category, CASE WHEN s_suppkey % 3 = 0 THEN 'yes' ELSE 'no' END AS has_website, s_suppkey % 5 + 0.5 AS rating,
           CAST(s_suppkey AS INTEGER) AS reviews, CASE WHEN s_suppkey % 7 = 1 THEN 'Temporarily closed' ELSE 'Operational' END AS business_status, 'shops' AS matched_query
    FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0
""")
def place_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 11 == 0, F.lit(None)).otherwise(F.struct(F.col("s_name").alias("text")))
    state = F.when(k % 7 == 0, "CLOSED_PERMANENTLY").when(k % 7 == 1, "CLOSED_TEMPORARILY").otherwise("OPERATIONAL")
    place = F.struct(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), name.alias("displayName"), F.when(k % 2 != 0, F.struct(F.lit("Shop").alias("text"))).alias("primaryTypeDisplayName"), F.lit("book_store").alias("primaryType"),
        state.alias("businessStatus"), F.when(k % 3 == 0, "https://x.org").alias("websiteUri"), (k % 5 + 0.5).alias("rating"), k.cast("int").alias("userRatingCount"),
    )
    df = read(spark, sf_dir, "supplier").select(F.parse_json(F.to_json(place)).alias("place"))
    return records.place_rows(df, "shops", "here").select("id", "name", "category", "has_website", "rating", "reviews", "business_status", "matched_query")


@register("SELECT r_regionkey, unnest(CASE WHEN r_regionkey % 2 = 0 THEN ['Delhi', 'Gurugram', 'Noida', 'Ghaziabad', 'Faridabad'] ELSE [r_name, 'NCR'] END) AS location FROM region")
def expanded_regions(spark, sf_dir):
    lists = F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit(" Delhi  NCR "))).otherwise(F.array(F.col("r_name"), F.lit("NCR")))
    return records.expanded_regions(read(spark, sf_dir, "region").select("r_regionkey", lists.alias("places")), "places")


@register("SELECT event_id AS id, event_type AS title, CASE WHEN event_id % 3 = 0 THEN 'j' || event_id END AS job_id, event_id % 2 = 0 AS has_intent, event_id % 4 = 0 AS keep_live FROM events")
def session_meta(spark, sf_dir):
    k = F.col("event_id")
    payload = F.to_json(F.struct(F.when(k % 2 == 0, F.lit("x")).alias("intent"), (k % 4 == 0).alias("keep_live"), F.when(k % 3 == 0, F.concat(F.lit("j"), k.cast("string"))).alias("job_id")))
    s = read(spark, sf_dir, "events").select(k.alias("id"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("job_id"), F.col("ts").alias("updated_at"), payload.alias("payload_json"))
    return records.session_meta(s).drop("updated_at")


@register("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'CG-DL-' || o_orderkey ELSE 'GAZ/2024-' || o_orderkey END AS gazette_id, lower(o_orderpriority) AS subject FROM orders WHERE o_orderkey % 3 <> 2")
def gazette_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, F.concat(F.lit("CG-DL-"), k.cast("string"))).alias("Gazette No"), F.lower("o_orderpriority").alias("Subject"),
        F.when(k % 3 == 1, F.concat(F.lit("GAZ/2024-"), k.cast("string"))).otherwise("none at all").alias("code"),
    )
    return records.gazette_rows(r).select("gazette_id", "subject")


@register("SELECT o_orderkey, 'https://files.example/w/' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE '2024' END || '/' || o_orderkey || '.pdf' AS url FROM orders")
def document_url(spark, sf_dir):
    k = _text("o_orderkey")
    ident = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CG-DL-E-"), F.date_format("o_orderdate", "ddMMyyyy"), F.lit("-"), k)).otherwise(F.concat(F.lit("CG-"), k))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, records.document_url(ident, "https://files.example/w/", 2024)).otherwise(F.concat(F.lit("https://files.example/w/2024/"), k, F.lit(".pdf"))).alias("url"))


@register("SELECT p_partkey, p_partkey % 4 <> 3 AS price FROM part")
def price_like(spark, sf_dir):
    cell = F.element_at(F.array(F.lit("₹ on request"), _text("p_size"), F.lit("two lakh"), F.lit("ask us")), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", records.looks_like_price(cell).alias("price"))


@register("""
    SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 60 + 30 WHEN 1 THEN -p_size * 1000 WHEN 2 THEN p_size * 1e5 WHEN 3 THEN p_size + 0.5 WHEN 5 THEN p_size END AS DOUBLE) AS value,
           CASE p_partkey % 6 WHEN 0 THEN 'min' WHEN 3 THEN '%' WHEN 4 THEN NULL WHEN 5 THEN 'km' ELSE '' END AS unit FROM part
""")
def graph_measure(spark, sf_dir):
    n = _text("p_size")
    cells = [F.concat(n, F.lit(" hrs 30 min")), F.concat(F.lit("("), n, F.lit(",000)")), F.concat(F.lit("₹ "), n, F.lit(" lakh")), F.concat(n, F.lit(".5%")), F.lit("unknown"), F.concat(n, F.lit(" km"))]
    m = records.graph_measure(F.element_at(F.array(*cells), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.value", "m.unit")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1997-01-01'")
def dated_rows(spark, sf_dir):
    """The column that dates the rows is found first: one that is named for dates and mostly reads as such."""
    o = read(spark, sf_dir, "orders").select(_text("o_orderkey").alias("o_orderkey"), F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "d MMM yyyy")).alias("placed_on"), F.col("o_orderpriority").alias("sale_period"))
    return records.within_period(o, o.columns, date(1997, 1, 1), None).select(F.col("o_orderkey").cast("long").alias("o_orderkey"))


@register("SELECT p_partkey, p_partkey % 3 = 0 AS vehicles, p_partkey % 3 = 1 AS parliament FROM part")
def topics(spark, sf_dir):
    request = F.element_at(F.array(F.lit("Prices of electric CARS here"), F.lit("lok sabha debates"), F.lit("careful evolution")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", records.topic_is(request, "vehicles").alias("vehicles"), records.topic_is(request, "parliament").alias("parliament"))


@register("""
    WITH f AS (SELECT p_brand AS request, lower(p_name) AS q, min(p_partkey) AS k, 0 AS s FROM part WHERE NOT contains(p_name, 'red') GROUP BY 1, 2),
    x AS (SELECT DISTINCT p_brand AS request, 'seed ' || i AS q, i AS k, 1 AS s FROM part, range(1, 6) AS r(i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY s, k) AS rn FROM (SELECT * FROM f UNION ALL SELECT * FROM x))
    SELECT request, rn AS place, q AS query FROM r WHERE rn <= 8
""")
def search_queries(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    found = p.select(F.col("p_brand").alias("request"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("query"), F.col("p_partkey").alias("place"))
    seeds = p.select(F.col("p_brand").alias("request")).distinct().select("request", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("place")).select("request", F.concat(F.lit("seed "), _text("place")).alias("query"), F.col("place").cast("long").alias("place"))
    out = records.search_queries(found, seeds, "(?i)red", 8)
    return out.select("request", F.col("place").cast("long").alias("place"), F.lower("query").alias("query"))


# ---------------------------------------------------------------- sinks
@register("SELECT c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT -1 - n_nationkey, arg_min(s_name, s_suppkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def insert_new(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = s.select((-1 - F.col("s_nationkey")).cast("long").alias("k"), F.col("s_name").alias("v"), F.col("s_suppkey").alias("seq")).union(c.select("c_custkey", F.lit("late"), "c_custkey"))
    return records.insert_new(old, new, ["k"], "seq").select("k", "v")


@register("SELECT c_custkey AS k, CASE WHEN length(c_mktsegment) > length(c_name) - 8 THEN c_mktsegment ELSE substr(c_name, 9) END AS v FROM customer")
def longest_text(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return records.longest_text(c.select(F.col("c_custkey").alias("k"), F.substring("c_name", 9, 100).alias("v")), c.select(F.col("c_custkey").alias("k"), F.concat(F.col("c_mktsegment"), F.lit("  ")).alias("v")), "k", "v").withColumn("v", F.trim("v"))


@register("SELECT event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def cascade_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("user_id"))
    return records.without_jobs(read(spark, sf_dir, "events"), gone, "user_id").select("event_id")


@register("SELECT event_id FROM events WHERE (SELECT max(ts) FROM events) - ts < INTERVAL 30 DAY")
def cache_ttl(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return records.unexpired(e, "ts", e.agg(F.max("ts")).scalar(), 30).select("event_id")


@register("""
    SELECT c_custkey, coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0), c_mktsegment) AS status,
           coalesce((SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0), c_name) AS title FROM customer
""")
def update_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    changes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(k % 2 == 0, F.col("o_orderstatus")).alias("status"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("title"))
    stored = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"), F.col("c_name").alias("title"))
    return records.update_fields(stored, changes, "c_custkey", "o_orderkey", ["status", "title"])


@register("SELECT CAST(page_id AS VARCHAR) AS page_id, coalesce(url, '') AS source, coalesce(url, '') AS source_url FROM pages")
def export_table(spark, sf_dir):
    return records.export_table(read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source")))


@register("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_lines(spark, sf_dir):
    """A round trip through JSON Lines in the scratch folder."""
    return _round_trip(spark, read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), sinks.write_json_lines, lambda p, s: spark.read.schema(s).json(p))


@register("SELECT c_custkey, '''=' || c_name AS c_name FROM customer")
def csv_guarded(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("="), "c_name").alias("c_name"))
    return _round_trip(spark, df, sinks.write_delimited, lambda p, s: spark.read.schema(s).csv(p, header=True, escape='"'))


@register("SELECT c_custkey, c_name || ' x' AS c_name FROM customer")
def tsv_spaces(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("\tx")).alias("c_name"))
    return _round_trip(spark, df, lambda d, p: sinks.write_delimited(d, p, "\t"), lambda p, s: spark.read.schema(s).csv(p, header=True, sep="\t"))


@register("SELECT c_custkey, c_name FROM customer")
def xml_rows(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return _round_trip(spark, df, sinks.write_xml, lambda p, s: spark.read.schema(s).format("xml").option("rowTag", "row").load(p))


def _round_trip(spark, df: DataFrame, write, load) -> DataFrame:
    write(df, path := new_path(spark, "trip"))
    return load(path, df.schema)


@register("SELECT count(*) AS statements, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT 25 AS n FROM range(1))")
def sql_script(spark, sf_dir):
    lines = sinks.sql_script(read(spark, sf_dir, "nation").coalesce(1), "My nations", dialect="mysql")
    return lines.agg(F.count(F.lit(1)).alias("statements"), F.sum(F.size(F.split("line", "\n")) - 1).cast("long").alias("rows"))


@register("SELECT 'o_orderkey' AS name, 'BIGINT' AS kind UNION ALL SELECT 'o_totalprice', 'NUMERIC(' || (SELECT max(length(CAST(floor(o_totalprice) AS BIGINT)::VARCHAR)) + 2 FROM orders) || ', 2)'")
def sheet_types(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("decimal(20,0)").alias("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    return spark.createDataFrame(list(sinks.sheet_types(o, ["o_orderkey", "o_totalprice"]).items()), "name string, kind string")


# ---------------------------------------------------------------- links
#: Pages' addresses, some of them null, blank or without a scheme.
_SOME_URLS = "(SELECT page_id, html, CASE page_id % 10 WHEN 0 THEN NULL WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN ' ' ELSE url END AS url FROM pages)"


def _some_urls(spark, sf_dir) -> DataFrame:
    k, url = F.col("page_id") % 10, F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", "html", F.when(k == 0, None).when(k == 1, F.regexp_replace(url, "^[a-z]+://", "")).when(k == 2, " ").otherwise(url).alias("url"))


@register(f"SELECT page_id, CASE WHEN trim(url) = '' THEN '' ELSE 'https://' || lower(regexp_extract(url, '^(?:[a-z]+://)?([^/?#]*)', 1)) || regexp_replace(url, '^(?:[a-z]+://)?[^/?#]*', '') END AS url FROM {_SOME_URLS}")
def secure_url(spark, sf_dir):
    return _some_urls(spark, sf_dir).select("page_id", links.secure(F.col("url")).alias("url"))


@register(f"""
    WITH listed AS {_SOME_URLS},
    p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS s FROM listed WHERE url LIKE 'http%')
    SELECT page_id, root || '/' || array_to_string(s[1:n], '/') AS parent FROM (SELECT *, unnest(range(greatest(0, len(s) - 3), len(s))) AS n FROM p)
""")
def parent_pages(spark, sf_dir):
    return _some_urls(spark, sf_dir).select("page_id", F.explode(links.parent_pages(F.col("url"))).alias("parent"))


@register("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#]*)\"', 1)) AS h FROM pages WHERE url LIKE 'http%') GROUP BY 1")
def page_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages").filter("url like 'http%'")
    found = p.select("page_id", F.explode(links.links(F.col("html"), F.col("url"))).alias("l"), "url")
    return found.filter(F.startswith("l.url", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'https://x.org/a/c.csv' WHEN 1 THEN 'https://x.org/d/e?p=1' WHEN 2 THEN 'https://y.net/z' ELSE 'https://x.org/a/b/f' END AS url FROM supplier")
def absolute_url(spark, sf_dir):
    href = F.element_at(F.array(F.lit("../c.csv#top"), F.lit("/d/./e?p=1"), F.lit("//y.net/z"), F.lit("f")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", links.absolute(F.lit("https://x.org/a/b/page.html?q=2"), href).alias("url"))


@register("SELECT s_suppkey, 'https://x.org/list?page=' || (s_suppkey + 1) AS url FROM supplier WHERE s_suppkey % 3 < 2")
def next_page(spark, sf_dir):
    k = F.col("s_suppkey")
    after = F.concat(F.lit("/list?page="), (k + 1).cast("string"))
    html = (
        F.when(k % 3 == 0, F.concat(F.lit("<a href='/list?page=0'>Prev</a><a class=p href='"), after, F.lit("'> Next › </a>")))
        .when(k % 3 == 1, F.concat(F.lit('<link rel="next" href="'), after, F.lit('"><a href="https://other.org/next">next</a>'))).otherwise(F.lit("<a href='https://other.org/n'>next</a>"))
    )
    found = read(spark, sf_dir, "supplier").select("s_suppkey", links.next_page(html, F.lit("https://x.org/list?page=x")).alias("url"))
    return found.filter("url is not null")


@register("SELECT s_suppkey, ['https://raw.githubusercontent.com/o/r/main/d' || s_suppkey || '.csv', 'https://x.org/b.xlsx?v=1'] AS urls FROM supplier")
def data_links(spark, sf_dir):
    name = F.concat(F.lit("https://github.com/o/r/blob/main/d"), _text("s_suppkey"), F.lit(".csv"))
    html = F.concat(F.lit('<a href="'), name, F.lit('">d</a><a href="/b.xlsx?v=1">b</a><a href="/b.html">c</a><a href="'), name, F.lit('">again</a>'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", links.data_links(html, F.lit("https://x.org/p")).alias("urls"))


@register("""
    SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'instagram' WHEN 1 THEN 'facebook' WHEN 2 THEN 'linkedin' WHEN 3 THEN 'whatsapp' END AS kind,
           CASE s_suppkey % 6 WHEN 0 THEN 'https://www.instagram.com/u' || s_suppkey || '/' WHEN 1 THEN 'https://www.facebook.com/profile.php?id=' || s_suppkey WHEN 2 THEN 'https://www.linkedin.com/company/c' || s_suppkey WHEN 3 THEN 'https://wa.me/' || s_suppkey END AS link FROM supplier
""")
def profile_links(spark, sf_dir):
    k = _text("s_suppkey")
    forms = [("https://instagram.com/u", "/?hl=en"), ("https://m.facebook.com/profile.php?id=", "&x=1"), ("https://in.linkedin.com/Company/c", "/about"), ("https://api.whatsapp.com/send?phone=%2B", ""), ("https://facebook.com/sharer/", ""), ("https://x.org/", "")]
    url = F.element_at(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in forms]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", links.profile_link(url).alias("p")).select("s_suppkey", "p.kind", "p.link")


@register("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'Drupal' WHEN 2 THEN 'Shopify' ELSE '' END AS platform, CASE WHEN s_suppkey % 2 = 0 THEN 2021 END AS year FROM supplier")
def site_prints(spark, sf_dir):
    marks = ["<link href='/wp-content/a.css'>", "<meta name='generator' content='Drupal 10'>", "<script src='https://cdn.shopify.com/x'>", "<a href='https://wordpress.org'>"]
    html = F.concat(F.element_at(F.array(*[F.lit(m) for m in marks]), (F.col("s_suppkey") % 4 + 1).cast("int")), F.when(F.col("s_suppkey") % 2 == 0, "© 2015 – 2021 us, (c) 2019").otherwise(""))
    return read(spark, sf_dir, "supplier").select("s_suppkey", links.platform(html).alias("platform"), links.copyright_year(html).alias("year"))


@register("SELECT s_suppkey, 'info' || s_suppkey || '@shop.org' AS email FROM supplier")
def protected_email(spark, sf_dir):
    """Addresses coded by XOR with their first byte are read back."""
    plain = F.concat(F.lit("info"), _text("s_suppkey"), F.lit("@shop.org"))
    coded = F.concat(F.lit("5A"), F.array_join(F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c).bitwiseXOR(F.lit(0x5A))), 2, "0")), ""))
    return read(spark, sf_dir, "supplier").select("s_suppkey", links.protected_email(coded).alias("email"))


@register("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'zoe@shop.org' WHEN 1 THEN 'sales@mail.net' ELSE '' END AS email FROM supplier")
def best_email(spark, sf_dir):
    found = F.element_at(
        F.array(F.array(F.lit("info@mail.net"), F.lit(" Zoe@shop.org.")), F.array(F.lit("bob@mail.net"), F.lit("sales@mail.net"), F.lit("noreply@mail.net")), F.array(F.lit("x@example.com"), F.lit("logo@2x.png"))),
        (F.col("s_suppkey") % 3 + 1).cast("int"),
    )
    return read(spark, sf_dir, "supplier").select("s_suppkey", links.best_email(found, F.lit("shop.org")).alias("email"))


@register("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '<a title=\"A Light in the Attic ' || s_suppkey || '\">A Light in the Attic ' || s_suppkey || '</a>' ELSE '<a title=\"Other\">A Light in the ...</a>' END AS html FROM supplier")
def untruncated_links(spark, sf_dir):
    html = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('<a title="A Light in the Attic '), _text("s_suppkey"), F.lit('">A Light in the ...</a>'))).otherwise(F.lit('<a title="Other">A Light in the ...</a>'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", links.untruncated(html).alias("html"))


# ---------------------------------------------------------------- pages and texts
def _trees(spark, sf_dir) -> DataFrame:
    """One tree for each nation: a menu, and a table of its suppliers."""
    node = lambda i, parent, role, name, kids: F.struct(i.alias("id"), parent.alias("parent"), F.lit(role).alias("role"), name.alias("name"), F.lit(False).alias("ignored"), kids.alias("children"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("ks"))
    key = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    nodes = F.concat(
        F.array(node(F.lit("0"), none, "RootWebArea", F.lit("page"), F.array(F.lit("m"), F.lit("t"))), node(F.lit("m"), F.lit("0"), "navigation", F.lit("Menu of many words, longer than fifty characters in all"), empty), node(F.lit("t"), F.lit("0"), "table", F.lit(""), F.transform("ks", lambda k: key("r", k)))),
        F.transform("ks", lambda k: node(key("r", k), F.lit("t"), "row", F.lit(""), F.array(key("c", k), key("d", k)))),
        F.transform("ks", lambda k: node(key("c", k), key("r", k), "cell", key("Supplier ", k), F.array(key("x", k)))),
        F.transform("ks", lambda k: node(key("x", k), key("c", k), "StaticText", key("", k), empty)),
        F.transform("ks", lambda k: node(key("d", k), key("r", k), "cell", F.lit("a long enough description of it"), empty)),
    )
    return s.select(F.col("s_nationkey").cast("long").alias("page_id"), nodes.alias("nodes"))


@register("""
    SELECT CAST(s_nationkey AS BIGINT) AS page_id, 'table' || chr(10) || string_agg('  row: Supplier ' || s_suppkey || ' | a long enough description of it', chr(10) ORDER BY s_suppkey) AS text,
           CAST(CASE WHEN count(*) > 1 THEN count(*) - 1 ELSE 0 END AS INTEGER) AS items FROM supplier GROUP BY 1 HAVING count(*) >= 1
""")
def tree_lines(spark, sf_dir):
    t = pages.tree_text(_trees(spark, sf_dir))
    return t.select("page_id", "text", pages.item_estimate(F.col("text")).alias("items"))


_DIGEST_HTML = """coalesce(html, '') || repeat('<table>' || repeat('<tr><td>cell</td><td>' || page_id || '</td></tr>', page_id % 4 + 1) || '</table>', page_id % 9) || repeat('<script type="application/ld+json">{"a": 1}</script>', page_id % 6)"""


@register(rf"""
    WITH h AS (SELECT page_id, {_DIGEST_HTML} AS html FROM pages)
    SELECT page_id, CASE WHEN page_id % 4 >= 2 THEN least(6, page_id % 9) ELSE 0 END AS tables, CASE WHEN page_id % 4 >= 2 AND page_id % 9 > 0 THEN array_to_string(list_transform(range(0, page_id % 4 + 1), lambda i: 'cell | ' || page_id), chr(10)) END AS first_table,
           least(4, page_id % 6) AS json_blocks,
           length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) AS chars
    FROM h
""".replace("\\\\", "\\"))
def page_digest(spark, sf_dir):
    """Every page with tables and JSON-LD blocks of known number and size added."""
    d = pages.page_digests(read(spark, sf_dir, "pages").select("page_id", F.expr(_DIGEST_HTML.replace("page_id %", "cast(page_id AS int) %")).alias("html")))
    return d.select("page_id", F.size("tables").cast("long").alias("tables"), F.get("tables", F.lit(0))["text"].alias("first_table"), F.size("json_ld").cast("long").alias("json_blocks"), F.char_length("text").cast("long").alias("chars"))


@register("SELECT CAST(n_nationkey AS BIGINT) AS page_id, CAST(0 AS INTEGER) AS table_no, CAST(s.rn AS INTEGER) AS row_no, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey ELSE 'row-0-' || s.rn END AS ident FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) s ON s_nationkey = n_nationkey")
def mapped_tables(spark, sf_dir):
    """Tables of a page's HTML as records by column place, with a fallback id."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda r: F.concat(F.lit("<tr><td>"), F.when(r["s_suppkey"] % 2 == 0, F.concat(F.lit("S"), r["s_suppkey"].cast("string"))).otherwise(""), F.lit("</td><td>"), r["s_name"], F.lit("</td></tr>")))
    p = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.concat(F.lit("<table><tr><th>id</th><th>name</th></tr>"), F.array_join(row, ""), F.lit("<tr><td></td><td> </td></tr></table>")).alias("html"))
    return pages.mapped_tables(readers.scan_html_tables(p), {"ident": 0, "name": 1}, "ident").select("page_id", "table_no", "row_no", "name", "ident")


@register("SELECT event_id, user_id FROM (SELECT *, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id DESC) AS seen FROM events) WHERE NOT seen")
def until_known(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    known = e.filter("event_type = 'error'").select("event_id")
    return pages.until_known(e.withColumn("place", -F.col("event_id")), known, "user_id", "event_id", "place").select("event_id", "user_id")


@register("SELECT CAST(s_nationkey AS BIGINT) AS page_id, 'u' || s_nationkey AS url, count(*) AS n FROM supplier GROUP BY ALL HAVING count(*) >= 3")
def feed_recognition(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    page = s.groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.array_join(F.collect_list("s_name"), " and ").alias("text"), F.to_json(F.collect_list(F.struct("s_name", "s_acctbal"))).alias("body"))
    good = page.select("page_id", F.concat(F.lit("u"), _text("page_id")).alias("url"), "body")
    other = page.select("page_id", F.lit("filters").alias("url"), F.lit('[{"facet":"something else","n":1},{"facet":"another thing","n":2},{"facet":"third of them","n":3}]').alias("body"))
    return pages.recognised(good.union(other), page).select("page_id", "url", "n")


@register("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'yyyy-MM-dd' WHEN 1 THEN CASE WHEN day(o_orderdate) > 12 THEN 'MM/dd/yyyy' ELSE 'dd/MM/yyyy' END WHEN 2 THEN 'dd-MM-yyyy' END AS form FROM orders")
def feed_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    cell = F.element_at(F.array(F.date_format(d, "yyyy-MM-dd'T'HH"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "dd-MM-yyyy"), F.lit("later")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", pages.feed_dates(cell).alias("form"))


@register("SELECT c_mktsegment AS key, count(*) AS n, list_sort(list_distinct(list(CAST(c_nationkey AS VARCHAR))))[1:12] AS examples FROM customer GROUP BY 1")
def key_examples(spark, sf_dir):
    return pages.sampled_values(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), _text("c_nationkey").alias("value")), "key", "value")


_REPORT = ["=== SOURCE DISCOVERY ===", "Goal: all", "VALIDATED SOURCES (2)", "[1] First %s", "   URL: https://a.org/%s", "   Notes: fine", "[2] Second", "   URL: https://b.org", "REJECTED (1)", "• Bad %s", "https://c.org/x", "Reason: no table",
           "Fill validation", "• https://a.org/%s — **good** (fill rate 87%%)", "--- Master dataset (%s rows) ---", "a | b"]


def _reports(spark, sf_dir) -> DataFrame:
    parts = [F.lit(line.replace("%%", "%")) if "%s" not in line else F.concat(*[x for i, p in enumerate(line.replace("%%", "%").split("%s")) for x in ([F.lit(p)] if i == 0 else [_text("s_suppkey"), F.lit(p)])]) for line in _REPORT]
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("\n", *parts).alias("text"))


@register("""
    SELECT s_suppkey, 'validated' AS section, CAST(1 AS BIGINT) AS place, 'First ' || s_suppkey AS title, 'https://a.org/' || s_suppkey AS url, NULL AS reason FROM supplier UNION ALL SELECT s_suppkey, 'validated', 2, 'Second', 'https://b.org', NULL FROM supplier
    UNION ALL SELECT s_suppkey, 'rejected', 1, 'Bad ' || s_suppkey, 'https://c.org/x', 'no table' FROM supplier
""")
def report_sources(spark, sf_dir):
    return pages.report_sources(pages.report_lines(_reports(spark, sf_dir), "s_suppkey", "text"), "s_suppkey")


@register("SELECT s_suppkey, 'https://a.org/' || s_suppkey AS url, 'good' AS status, 87 AS fill_rate FROM supplier")
def fill_checks(spark, sf_dir):
    return pages.fill_checks(pages.report_lines(_reports(spark, sf_dir), "s_suppkey", "text"), "s_suppkey")


@register("SELECT s_suppkey, CAST(s_suppkey AS INTEGER) AS removed, 14 AS lines FROM supplier")
def report_head(spark, sf_dir):
    cut = _reports(spark, sf_dir).select("s_suppkey", pages.without_master_table(F.col("text")).alias("c"))
    return cut.select("s_suppkey", "c.removed", F.size(F.split("c.text", "\n")).alias("lines"))


@register("""
    SELECT doc_id, list_distinct(regexp_extract_all(text, '[Ss]ection\\s+\\d+[A-Za-z]*'))[1:5] AS clauses, CASE WHEN contains(lower(text), 'license') THEN 'rules' WHEN contains(lower(text), 'token') THEN 'tokens' ELSE 'notice' END AS impact FROM documents
""")
def clause_tags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clauses(F.col("text")).alias("clauses"), text.first_tag(F.col("text"), [(("license",), "rules"), (("token",), "tokens")], "notice").alias("impact"))


# ---------------------------------------------------------------- periods
@register("SELECT strftime(o_orderdate, '%Y') AS label, count(*) AS rows FROM orders GROUP BY 1")
def automatic_bucket(spark, sf_dir):
    """A day axis of many months is shown by year."""
    keys = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("k"))
    n = keys.agg(F.count_distinct("k").alias("days"), F.count_distinct(F.substring("k", 1, 7)).alias("months")).first()
    to = periods.automatic_bucket("day", n["days"], n["months"])
    return keys.groupBy(periods.bucket(F.col("k"), to).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


@register("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN date_trunc('month', o_orderdate)::DATE END AS date, CASE WHEN o_orderkey % 4 = 2 THEN CAST(year(o_orderdate) AS INTEGER) END AS number,
           CASE WHEN o_orderkey % 4 = 3 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END AS text FROM orders
""")
def exported_periods(spark, sf_dir):
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MMM yyyy"), F.date_format(d, "yyyy"), F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))]
    p = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(periods.parse_period(F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))))).alias("p"))
    return p.select("o_orderkey", periods.exported(F.col("p")).alias("e")).select("o_orderkey", "e.date", "e.number", "e.text")


# ---------------------------------------------------------------- live rules
@register("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 20")
def fan_out_queue(spark, sf_dir):
    return live.fan_out_queue(read(spark, sf_dir, "events"), "user_id", "event_id", 20).select("event_id", "user_id")


@register("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 20")
def fan_out_first(spark, sf_dir):
    return live.fan_out_queue(read(spark, sf_dir, "events"), "user_id", "event_id", 20, "newest").select("event_id", "user_id")


@register("SELECT c_custkey AS id, c_name AS v FROM customer UNION ALL SELECT -1 - s_nationkey, arg_min(s_name, s_suppkey) FROM supplier GROUP BY 1")
def snapshot_replay(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    frames = s.select((-1 - F.col("s_nationkey")).cast("long").alias("id"), F.col("s_name").alias("v"), F.col("s_suppkey").alias("seq")).union(c.select("c_custkey", F.lit("stale"), "c_custkey"))
    return live.replayed(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v")), frames, "id", "seq").select("id", "v")


@register("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, TRUE AS told, t AS last FROM e WHERE rn = 1
          UNION ALL SELECT e.user_id, e.event_id, e.rn, e.t - f.last >= 36000000000, CASE WHEN e.t - f.last >= 36000000000 THEN e.t ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, user_id, told FROM f
""")
def status_throttle(spark, sf_dir):
    return live.throttled(read(spark, sf_dir, "events"), "user_id", "ts", 36_000).select("event_id", "user_id", "told")


@register("""
    WITH r AS (SELECT event_id, user_id, event_id // 3 AS request, event_id % 5 = 0 AS changed FROM events),
    m AS (SELECT *, max(CASE WHEN NOT changed THEN request END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS applied FROM r)
    SELECT event_id, user_id, NOT changed AND request > coalesce(applied, 0) AS accepted FROM m
""")
def accepted_reads(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 3).alias("request"), F.lit(0).alias("begun"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("change"))
    return live.accepted_reads(e, "user_id", "event_id").select("event_id", "user_id", "accepted")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id DESC LIMIT 10")
def next_work(spark, sf_dir):
    return live.next_work(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", "doc_id").select("doc_id")


@register("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey LIMIT 40")
def in_source_order(spark, sf_dir):
    return live.in_source_order(read(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").limit(40).select("s_suppkey", "s_nationkey")


@register("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE arg_max(event_type, event_id) END AS event_type FROM events GROUP BY 1")
def final_status(spark, sf_dir):
    return live.final_status(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["purchase"])


# ---------------------------------------------------------------- operators that had no query
@register("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size * 60 + 30 AS DOUBLE) WHEN 1 THEN CAST(p_size AS DOUBLE) END AS minutes FROM part")
def durations(spark, sf_dir):
    n = _text("p_size")
    cell = F.element_at(F.array(F.concat(n, F.lit(" hours 30 min")), F.concat(n, F.lit(" mins")), F.lit("soon")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", numbers.duration_minutes(cell).cast("double").alias("minutes"))


@register("SELECT c_custkey, lower(regexp_replace(c_name, '#', '')) AS name, CASE WHEN c_custkey % 4 = 0 THEN 'v' || substr(sha1('12 3|' || lower(c_mktsegment)), 1, 12) ELSE lower(regexp_replace(c_name, '#', '')) END AS key FROM customer")
def merge_keys(spark, sf_dir):
    first = F.when(F.col("c_custkey") % 4 == 0, F.lit("12 3")).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.plain_name(F.col("c_name")).alias("name"), merge.merge_key(first, F.col("c_mktsegment")).alias("key"))


@register("""
    WITH p AS (SELECT a.o_orderkey, a.o_orderpriority || ' level' AS x, CASE WHEN a.o_orderkey % 11 = 0 THEN NULL WHEN a.o_orderstatus = 'O' THEN 'the ' || a.o_orderpriority || ' level' WHEN a.o_orderstatus = 'F' THEN b.o_orderpriority || ' level' ELSE 'Level, ' || b.o_orderpriority END AS y
        FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1),
    q AS (SELECT o_orderkey, regexp_replace(lower(x), '[^a-z0-9 ]', '', 'g') AS x, regexp_replace(lower(y), '[^a-z0-9 ]', '', 'g') AS y FROM p),
    t AS (SELECT *, replace(x, ' ', '') AS p, replace(y, ' ', '') AS q, string_split(x, ' ') AS u, string_split(y, ' ') AS v FROM q)
    SELECT o_orderkey, coalesce(contains(p, q) OR contains(q, p) OR len(list_intersect(u, v)) * 2 >= len(list_distinct(list_concat(u, v))), FALSE) AS similar FROM t
""")
def similar_cells(spark, sf_dir):
    """Every order's priority against a cell made of its own or of the next one's: equal, contained, sharing words, unlike, or missing."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderpriority").alias("after"))
    own = F.concat("o_orderpriority", F.lit(" level"))
    other = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderstatus") == "O", F.concat(F.lit("the "), own)).when(F.col("o_orderstatus") == "F", F.concat("after", F.lit(" level"))).otherwise(F.concat(F.lit("Level, "), "after"))
    return o.join(after, "o_orderkey").select("o_orderkey", text.similar_cells(own, other).alias("similar"))


@register("SELECT c_custkey, 'x.org|' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE substr(md5('x.org|' || c_custkey || '|' || c_mktsegment), 1, 16) END AS id FROM customer")
def record_ids(spark, sf_dir):
    k = _text("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", text.record_id(F.lit("x.org"), [F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit(" ")], [k, F.col("c_mktsegment")]).alias("id"))


@register(f"SELECT page_id, coalesce(url LIKE 'http%' OR url LIKE 'www.%', FALSE) AS is_url FROM {_SOME_URLS}")
def url_test(spark, sf_dir):
    return _some_urls(spark, sf_dir).select("page_id", text.is_url(F.col("url")).alias("is_url"))


@register("SELECT p_partkey, p_brand AS price_column, p_partkey % 2 = 0 AS walled FROM part")
def block_test(spark, sf_dir):
    cell = F.when(F.col("p_partkey") % 2 == 0, "Access denied: please solve the CAPTCHA").otherwise("Access denied to nobody")
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("price_column"), rows.walled(cell).alias("walled"))


@register("SELECT s_suppkey, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS maker FROM supplier")
def maker_sites(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select("s_suppkey", rows.maker_site(F.when(k % 2 == 0, "https://www.tatamotors.com/x").otherwise("https://news.org"), F.when(k % 3 == 0, "manufacturer").otherwise("blog")).alias("maker"))


@register("SELECT n_regionkey AS a, r AS b, list_has_all((SELECT list(n_nationkey) FROM nation WHERE n_regionkey = r), list(n_nationkey)) AS inside FROM nation, range(0, 5) AS t(r) GROUP BY n_regionkey, r")
def file_subsets(spark, sf_dir):
    g = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("files"))
    pairs = g.select(F.col("n_regionkey").alias("a"), "files", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("b")).join(g.select(F.col("n_regionkey").alias("b"), F.col("files").alias("others")), "b")
    return pairs.select("a", F.col("b").cast("long").alias("b"), rows.subset(F.col("files"), F.col("others")).alias("inside"))


@register("SELECT p_partkey, n FROM (SELECT p_partkey, CAST((CASE WHEN contains(' ' || p_name || ' ', ' red ') THEN 1 ELSE 0 END) + (CASE WHEN contains(' ' || p_name || ' ', ' ring ') THEN 1 ELSE 0 END) AS INTEGER) AS n FROM part) WHERE n > 0 ORDER BY n DESC, p_partkey LIMIT 2")
def link_choice(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", rows.word_overlap(F.lit("red ring"), F.col("p_name")).alias("n"))
    return p.filter("n > 0").orderBy(F.desc("n"), "p_partkey").limit(2)


@register("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '1.5K' WHEN s_suppkey % 4 = 1 THEN '2M' WHEN s_suppkey % 4 = 2 THEN '3.2B' ELSE '12' END AS short FROM supplier")
def compact_numbers(spark, sf_dir):
    n = F.element_at(F.array(F.lit(1500), F.lit(2_000_000), F.lit(3_210_000_000), F.lit(12)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", rows.compact(n).alias("short"))


@register("SELECT s_suppkey, greatest(0.0, least(1.0, round(s_suppkey % 10 / 10.0 + CASE s_suppkey % 3 WHEN 0 THEN 0.15 WHEN 1 THEN -0.3 ELSE 0 END, 6))) AS score FROM supplier")
def trust_scores(spark, sf_dir):
    k = F.col("s_suppkey")
    host = F.element_at(F.array(F.lit("x.edu"), F.lit("me.blogspot.com"), F.lit("shop.com")), (k % 3 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(places.trust_score(host, (k % 10) / 10.0), 6).alias("score"))


@register("""
    WITH a AS (SELECT DISTINCT n_regionkey AS area, 0.2 * (1 + n_regionkey) AS side FROM nation),
    g AS (SELECT *, greatest(1, ceil(side * 111.32 / 12))::BIGINT AS m, greatest(1, ceil(side * 111.32 * cos(radians(side / 2)) / 12))::BIGINT AS n FROM a),
    t AS (SELECT *, unnest(range(0, m * n)) AS idx FROM g)
    SELECT area, idx, row_number() OVER (PARTITION BY area ORDER BY pow(idx // n + 0.5 - m / 2, 2) + pow(idx % n + 0.5 - n / 2, 2), idx) AS position FROM t
""")
def area_tiles(spark, sf_dir):
    """Squares of growing size in tiles, each with its place from the centre."""
    side = 0.2 * (1 + F.col("area"))
    a = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("area")).distinct().select("area", F.lit(0.0).alias("low_lat"), F.lit(0.0).alias("low_lng"), side.alias("high_lat"), side.alias("high_lng"))
    return places.tiles(a, 12).select("area", F.col("idx").cast("long").alias("idx"), F.col("position").cast("long").alias("position"))


@register("SELECT DISTINCT c_nationkey, lower(c_mktsegment) AS tag, round(1.0 / count(DISTINCT lower(c_mktsegment)) OVER (PARTITION BY c_nationkey), 4) AS weight FROM customer")
def tag_weights(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("tags"))
    return g.select("c_nationkey", F.explode(places.equal_weights(F.col("tags"))).alias("w")).select("c_nationkey", "w.tag", "w.weight")


@register("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') || '|' || p_type AS plain FROM part")
def without_indic(spark, sf_dir):
    """Part names whose vowels are written in Indic scripts, with them dropped."""
    return read(spark, sf_dir, "part").select("p_partkey", text.without_indic(F.concat(F.translate("p_name", "aeiou", "अइउऎஎ"), F.lit("|"), F.col("p_type"))).alias("plain"))


@register("SELECT doc_id, list_filter(['license', 'token', 'the', 'der', 'est'], lambda w: regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{L}\\p{N}_])' || w || '($|[^\\p{L}\\p{N}_])')) AS tags FROM documents".replace("\\\\", "\\"))
def gazetteer(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.tagged(F.col("text"), ["license", "token", "the", "der", "est"]).alias("tags"))


@register("SELECT min_by(n, y) AS first, max_by(n, y) AS last, arg_max(y, struct_pack(a := n, b := y)) AS peak, CAST(round_even(CAST(max_by(n, y) - min_by(n, y) AS DECIMAL(24,4)) * 100 / min_by(n, y), 2) AS DOUBLE) AS change FROM (SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders GROUP BY 1)")
def first_last_peak(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return charts.first_last_peak(g, "y", "n").withColumn("change", F.col("change").cast("double"))


@register("SELECT p_partkey AS x, p_retailprice AS y FROM part WHERE p_partkey % 5 <> 0")
def scatter_points(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("y"))
    return charts.scatter(p, "x", "y")[0]


@register("SELECT p_brand, (list_sort(list(p_size))[CAST(ceil(count(*) / 2.0) AS BIGINT)] + list_sort(list(p_size))[CAST(floor(count(*) / 2.0) + 1 AS BIGINT)]) / 2.0 AS median FROM part GROUP BY 1")
def exact_medians(spark, sf_dir):
    m = quantiles.middle(read(spark, sf_dir, "part"), ["p_brand"], "p_size")
    return m.select("p_brand", ((F.get("ranked", F.lit(0)) + F.get("ranked", F.lit(1))) / 2.0).alias("median"))


@register("SELECT 'k' || c_nationkey || CASE WHEN rn > 1 AND odd THEN '#' || rn ELSE '' END AS entity, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey, c_custkey % 2 = (SELECT min(c_custkey) % 2 FROM customer d WHERE d.c_nationkey = c.c_nationkey) AS odd, dense_rank() OVER (PARTITION BY c_nationkey, c_custkey % 2 ORDER BY f) AS rn FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 2, c_mktsegment) AS f FROM customer) c) GROUP BY 1")
def split_entities(spark, sf_dir):
    """A different row of the same key from the key's first source is an entity of its own."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("k"), _text("c_nationkey")).alias("k"), "c_custkey", (F.col("c_custkey") % 2).alias("src"), F.col("c_mktsegment").alias("v"))
    return merge.split_same_source(c, "k", "src", "c_custkey", ["v"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def capped_rows(spark, sf_dir):
    """A row cap is a parameter of the caller."""
    return read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").orderBy("o_orderkey").limit(25).select("o_orderkey")


@register("SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 12")
def sorted_by_time(spark, sf_dir):
    typed = typing.add_typed(_orders(spark, sf_dir), _ORDER_PROFILE, ["ordered"])
    r = run_plan(typed, _ORDER_PROFILE, Query("count", group_by="ordered", bucket="month", sort="time", limit=12), _ORDER_COLUMNS).rows
    return r.select("label", F.col("value").cast("double").alias("value"))


@register("SELECT o_orderpriority AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1 ORDER BY lower(o_orderpriority) LIMIT 3")
def sorted_by_label(spark, sf_dir):
    typed = typing.add_typed(_orders(spark, sf_dir), _ORDER_PROFILE, ["priority"])
    r = run_plan(typed, _ORDER_PROFILE, Query("count", group_by="priority", sort="label", limit=3), _ORDER_COLUMNS).rows
    return r.select("label", F.col("value").cast("double").alias("value"))


@register("SELECT o_orderpriority AS label, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def profiled_plan(spark, sf_dir):
    """Profile, typing and plan together: the kinds are learned from the table itself."""
    o = _orders(spark, sf_dir)
    profile = typing.collect_profile(o, _ORDER_COLUMNS)
    q = Query("sum", "price", "priority", (Filter("in", "status", ("F",)),))
    return run_plan(typing.add_typed(o, profile, ["price", "priority", "status"]), profile, q, _ORDER_COLUMNS).rows.select("label", F.col("value").cast("double").alias("value"))


@register("SELECT s_suppkey, s_suppkey % 3 AS pos, 'N' || (s_suppkey * 10 + i) AS name, CASE WHEN i = 1 THEN 'a, b' ELSE '' END AS tags FROM supplier, range(1, 3) AS r(i)")
def json_records(spark, sf_dir):
    """The largest list of records of each JSON text, nested values flattened, a cut-off text closed first."""
    k = F.col("s_suppkey")
    one = lambda i: F.struct(F.struct(F.concat(F.lit("N"), (k * 10 + i).cast("string")).alias("name")).alias("who"), (F.array(F.lit("a"), F.lit("b")) if i == 1 else F.array().cast("array<string>")).alias("tags"))
    body = F.concat(F.regexp_replace(F.to_json(F.struct(F.lit(1).alias("n"), F.struct(F.array(one(1), one(2)).alias("rows")).alias("data"))), r"\]\}\}$", ""), F.lit(', {"who": {"na'))
    df = read(spark, sf_dir, "supplier").select(k.alias("id"), body.alias("body"))
    out = readers.scan_json(df, "id", "body")
    return out.select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).alias("pos"), F.col("cells")["who"].alias("name"), F.coalesce(F.col("cells")["tags"], F.lit("")).alias("tags"))


@register("SELECT s_suppkey, s_suppkey * 2 AS total FROM supplier")
def envelope_total(spark, sf_dir):
    body = F.to_json(F.struct(F.struct((F.col("s_suppkey") * 2).alias("totalElements")).alias("meta"), F.array(F.lit(1)).alias("records")))
    paths = ["total", "totalElements", "meta.total", "meta.totalElements", "page.total", "count"]
    v = F.try_parse_json(body)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(*[F.try_variant_get(v, f"$.{p}", "long") for p in paths]).alias("total"))


@register("SELECT s_suppkey, to_json({a: s_name, b: [s_nationkey]}) AS j, s_nationkey AS first FROM supplier")
def json_columns(spark, sf_dir):
    """JSON text columns written and read back."""
    j = F.to_json(F.struct(F.col("s_name").alias("a"), F.array("s_nationkey").alias("b")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", j.alias("j"), F.get(F.from_json(j, "a string, b array<int>")["b"], F.lit(0)).alias("first"))


# ---------------------------------------------------------------- questions
_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


def _vocabulary(spark, sf_dir):
    from brindle.plans.ask import vocabulary_of

    o = _orders(spark, sf_dir)
    profile = typing.collect_profile(o, _ORDER_COLUMNS)
    typed = typing.add_typed(o, profile, _ORDER_COLUMNS)
    return typed, vocabulary_of(typed, profile)


def _asked(spark, sf_dir, question: str) -> DataFrame:
    """A question read and answered: profile, vocabulary, plan and rows."""
    from brindle.plans.ask import read_question

    typed, vocabulary = _vocabulary(spark, sf_dir)
    plan = read_question(question, vocabulary).plan
    return run_plan(typed, vocabulary.profile, plan, _ORDER_COLUMNS).rows.select("label", F.col("value").cast("double").alias("value"))


@register(f"SELECT o_orderpriority AS label, CAST(round_even(CAST(sum({_PRICE}) AS DECIMAL(38,6)) / count(*), 4) AS DOUBLE) AS value FROM orders GROUP BY 1")
def ask_average(spark, sf_dir):
    return _asked(spark, sf_dir, "What is the average price per priority?")


@register(f"SELECT o_orderpriority AS label, CAST(sum({_PRICE}) AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'F' AND {_PRICE} >= 200000 GROUP BY 1 ORDER BY 2 DESC LIMIT 2")
def ask_top_filtered(spark, sf_dir):
    return _asked(spark, sf_dir, "Top 2 priority by price above 2 lakh for status F")


@register("SELECT o_orderpriority AS label, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE strftime(o_orderdate, '%Y') = '1996' GROUP BY 1")
def ask_count_in_year(spark, sf_dir):
    return _asked(spark, sf_dir, "How many rows by priority in 1996?")


@register(f"SELECT o_orderpriority AS label, CAST(sum({_PRICE}) AS DOUBLE) AS value FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def ask_compare(spark, sf_dir):
    return _asked(spark, sf_dir, "compare price of 1-urgent vs 5-low")


@register("SELECT 'priority' AS column, 'donut' AS chart UNION ALL SELECT 'status', 'donut' UNION ALL SELECT 'ordered', 'line'")
def graph_ideas(spark, sf_dir):
    """The charts that a table's profile suggests: by group column."""
    from brindle.plans.ask import graph_ideas as ideas

    typed, vocabulary = _vocabulary(spark, sf_dir)
    found = ideas(vocabulary.profile, 1 << 40, "year")
    return spark.createDataFrame(sorted({(q.group_by, chart) for chart, q in found if q.group_by}), "column string, chart string")


@register(f"SELECT 'total' AS what, CAST(sum({_PRICE}) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'highest', CAST(max(s) AS DOUBLE) FROM (SELECT sum({_PRICE}) AS s FROM orders GROUP BY o_orderstatus)")
def follow_up_answers(spark, sf_dir):
    """Two of the suggested follow-up questions, answered by their own plans."""
    from brindle.plans.ask import follow_ups

    typed, vocabulary = _vocabulary(spark, sf_dir)
    plans = dict(follow_ups(vocabulary.profile, "year"))
    run = lambda q, what: run_plan(typed, vocabulary.profile, q, _ORDER_COLUMNS).rows.select(F.lit(what).alias("what"), F.col("value").cast("double").alias("value"))
    return run(plans["What is the total price?"], "total").union(run(next(q for t, q in plans.items() if t.startswith("Which") and q.sort == "value-desc"), "highest"))


@register("SELECT 'reach' AS name, 'km' AS unit, count(*) FILTER (p_partkey % 5 <> 0) AS points FROM part")
def graph_parameters(spark, sf_dir):
    n = _text("p_size")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("_row"), F.when(F.col("p_partkey") % 5 == 0, F.concat(n, F.lit(" mi"))).otherwise(F.concat(n, F.lit(" km"))).alias("reach"), n.alias("serial_no"), F.col("p_brand").alias("brand"))
    return charts.graph_parameters(p, ["reach", "serial_no", "brand"], records.graph_measure)


@register("SELECT p_partkey AS x, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey % 5 <> 0")
def graph_series(spark, sf_dir):
    n = _text("p_size")
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat(n, F.lit(" mi"))).otherwise(F.concat(n, F.lit(" km"))).alias("reach"))
    return charts.graph_series(p, "p_partkey", "reach", "km", records.graph_measure)[0].select("x", "value")


@register(f"SELECT o_orderpriority AS label, CAST(sum({_PRICE}) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1")
def engine_plan(spark, sf_dir):
    """A planner's plan names a year on a column of days; the engine reads it as a bucket."""
    from brindle.plans.ask import engine_plan as fitted

    q = fitted(_ORDER_PROFILE, Query("sum", "price", "priority", (Filter("in", "ordered", (" 1997 ",)),)))
    return run_plan(_typed_orders(spark, sf_dir, "price", "priority", "ordered"), _ORDER_PROFILE, q, _ORDER_COLUMNS).rows.select("label", F.col("value").cast("double").alias("value"))


@register("SELECT n_regionkey AS region, CAST(count(*) AS DOUBLE) AS nations FROM nation GROUP BY 1")
def user_function(spark, sf_dir):
    """A checked user function with an import of an allowed module, its answer as a typed table."""
    from brindle.functions import udf

    source = "from math import fsum\ndef answer(rows):\n    out = {}\n    for r in rows:\n        out.setdefault(r['n_regionkey'], []).append(1)\n    return [{'region': k, 'nations': fsum(v)} for k, v in out.items()]"
    value = udf.call(source, read(spark, sf_dir, "nation").select("n_regionkey"))
    return udf.as_table(spark, value).withColumn("region", F.col("region").cast("int"))


@register("SELECT c_custkey, c_name AS label, c_acctbal AS balance FROM customer")
def header_match(spark, sf_dir):
    """Fields matched to a table's headers by letters and digits, then by words."""
    c = read(spark, sf_dir, "customer").select(_text("c_custkey").alias("c_custkey"), F.col("c_name").alias("Label"), F.col("c_acctbal").cast("string").alias("Account Balance (USD)"))
    out = rows.map_columns(c, records.header_map(c.columns, ["c_custkey", "label", "balance"]))
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "label", F.col("balance").cast("double").alias("balance"))


@register("SELECT count(*) AS n, CAST(0 AS BIGINT) AS dropped FROM orders")
def stored_plan(spark, sf_dir):
    """A stored question keeps its plan: run again on the same columns, dropped when they have changed."""
    signature = live.column_signature(_ORDER_COLUMNS)
    kept, gone = live.stored_answer({"agg": "count"}, signature, _ORDER_COLUMNS), live.stored_answer({"agg": "count"}, signature, _ORDER_COLUMNS[1:])
    r = run_plan(_typed_orders(spark, sf_dir), _ORDER_PROFILE, Query(**kept), _ORDER_COLUMNS).rows
    return r.select(F.col("value").cast("long").alias("n"), F.lit(0 if gone is None else 1).cast("long").alias("dropped"))


# ---------------------------------------------------------------- twins
@register("""
WITH RECURSIVE c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '1995-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS block, o_custkey % 3 AS src,
    CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority ELSE '' END AS a, o_orderstatus AS b, right(o_custkey::VARCHAR, 1) AS c, (floor(o_totalprice / 20000)::BIGINT % 10)::VARCHAR AS d FROM orders),
o AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY id) AS n, {'id': id, 'src': src, 'a': a, 'b': b, 'c': c, 'd': d} AS r FROM c),
g AS (SELECT block, n, [r] AS kept, r.id AS id, NULL::BIGINT AS twin_of FROM o WHERE n = 1
    UNION ALL
    SELECT block, n, CASE WHEN m IS NULL THEN list_append(kept, r) ELSE kept END, r.id, m FROM (
        SELECT g.block, o.n, o.r, g.kept, list_filter(g.kept, lambda k: k.src <> o.r.src
            AND (k.a = o.r.a AND k.a <> '')::INT + (k.b = o.r.b)::INT + (k.c = o.r.c)::INT + (k.d = o.r.d)::INT >= CASE WHEN k.a <> '' AND o.r.a <> '' THEN 3 ELSE 2 END)[1].id AS m
        FROM g JOIN o ON o.block = g.block AND o.n = g.n + 1))
SELECT id, twin_of FROM g
""")
def twins_by_date(spark, sf_dir):
    """Orders of one day that are the same item from two sources; a third of all orders stand under one day."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("1995-01-01")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("block"), (F.col("o_custkey") % 3).alias("src"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).alias("a"), F.col("o_orderstatus").alias("b"), (F.col("o_custkey") % 10).cast("string").alias("c"),
        (F.floor(F.col("o_totalprice") / 20000) % 10).cast("string").alias("d"),
    )
    return merge.twins(rows, "block", "src", "id", ["a", "b", "c", "d"]).select("id", "twin_of")


# ---------------------------------------------------------------- tables kept current
@register("""SELECT user_id, event_id, ts, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def kept_current(spark, sf_dir):
    """The last event of each user after four batches, merged on read."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    table = keyed.KeyedTable(spark, new_path(spark, "kept"), "user_id", "event_id", events.schema, buckets=8, most=2)
    for n in range(4):
        table.apply(events.filter(F.col("event_id") % 4 == n), n)
    return table.read()


# ---------------------------------------------------------------- delimited files
@register("SELECT doc_id::VARCHAR AS doc_id, md5('[' || coalesce(text, '') || ']') AS text_md5 FROM documents")
def delimited_documents(spark, sf_dir):
    """Whole texts, line breaks and all, through quoted CSV and back, read split by split."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("["), F.coalesce("text", F.lit("")), F.lit("]")).alias("text"))
    docs.write.csv(path := new_path(spark, "csv"), header=True, quoteAll=True, escape='"')
    return delimited.read_delimited(spark, path, ["doc_id", "text"], ",").select("doc_id", F.md5("text").alias("text_md5"))


def _streamed(spark, sf_dir, table: str, change, columns: list[str]) -> DataFrame:
    """What ``change`` makes of a table that is read as a stream, once through."""
    source = spark.readStream.schema(read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parquet*")
    query = change(source).select(*columns).writeStream.format("parquet").option("path", path := new_path(spark, "stream")).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


@register(ORACLE_SQL["rate_limit"])
def rate_limit_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, "events", lambda e: limits.limit_stream(e.select("event_id", "user_id", "ts"), "user_id", "ts", 3, 86_400), ["event_id", "user_id", "allowed"])


@register(ORACLE_SQL["usage_meter"])
def usage_meter_stream(spark, sf_dir):
    def metered(events):
        usage = events.select("user_id", F.col("event_id").alias("seq"), "ts", F.to_date("ts").alias("day"), (F.pmod("event_id", F.lit(5)) + 1).cast("long").alias("calls"))
        return limits.meter_stream(usage, 8, 60)

    return _streamed(spark, sf_dir, "events", metered, ["user_id", "seq", "day", "calls", "charged"])


# ---------------------------------------------------------------- values named in questions
@register("""SELECT CAST(round_even(CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DECIMAL(38, 6)) / count(*), 4) AS DOUBLE) AS value
    FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)""")
def ask_value_of_many(spark, sf_dir):
    """A question that names, with a typing error, one of as many customers as there are."""
    from brindle.plans import values
    from brindle.plans.ask import read_question

    columns = ["name", "balance"]
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("balance"))
    profile = typing.collect_profile(c, columns)
    typed = typing.add_typed(c, profile, columns)
    first = c.agg(F.min("name")).first()[0]
    question, vocabulary = values.understood(spark, values.value_index(typed, profile), profile, f"Average balance of {first[:3]}{first[4:]}?")
    return run_plan(typed, profile, read_question(question, vocabulary).plan, columns).rows.select(F.col("value").cast("double").alias("value"))


# ---------------------------------------------------------------- searches in turn
@register("""
    WITH RECURSIVE t AS (SELECT user_id AS queue, event_type AS term, event_id AS seq, event_id % 4 AS brought FROM events),
    c AS (SELECT queue, ceil(40.0 * 3 / 2 / count(DISTINCT term)) AS cap, count(DISTINCT term) > 1 AS capped FROM t GROUP BY queue),
    d AS (SELECT t.*, cap, capped, row_number() OVER (PARTITION BY t.queue, term ORDER BY seq) AS k FROM t JOIN c ON t.queue = c.queue),
    f AS (SELECT *, FALSE AS deferred, brought AS got FROM d WHERE k = 1
        UNION ALL SELECT d.*, d.capped AND f.got >= d.cap, f.got + CASE WHEN d.capped AND f.got >= d.cap THEN 0 ELSE d.brought END FROM f JOIN d ON d.queue = f.queue AND d.term = f.term AND d.k = f.k + 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY deferred, seq) AS position FROM f),
    r AS (SELECT queue, seq, term, deferred, position, TRUE AS ran, brought AS total FROM o WHERE position = 1
        UNION ALL SELECT o.queue, o.seq, o.term, o.deferred, o.position, r.total < 40, r.total + CASE WHEN r.total < 40 THEN o.brought ELSE 0 END FROM r JOIN o ON o.queue = r.queue AND o.position = r.position + 1)
    SELECT queue, seq, term, deferred, position, ran FROM r
""")
def capped_turns(spark, sf_dir):
    """Searches of several categories until the target is reached: a category that had its share waits until no other does."""
    tasks = read(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), F.col("event_type").alias("term"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("brought"))
    return reports.capped_turns(tasks, "queue", "term", "seq", "brought", 40).select("queue", "seq", "term", "deferred", F.col("position").cast("long").alias("position"), "ran")


# ---------------------------------------------------------------- timelines and gates
@register("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id)),
    f AS (SELECT event_id, user_id, rn, t, 0::BIGINT AS clock, 0::BIGINT AS last, TRUE AS shown FROM e WHERE rn = 1
          UNION ALL SELECT e.event_id, e.user_id, e.rn, e.t, f.clock + least(40000, e.t - f.t), CASE WHEN f.clock + least(40000, e.t - f.t) - f.last >= 50000 THEN f.clock + least(40000, e.t - f.t) ELSE f.last END,
                 f.clock + least(40000, e.t - f.t) - f.last >= 50000 OR e.rn = e.n FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, user_id, shown FROM f
""")
def thinned_timeline(spark, sf_dir):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", seconds.alias("at"))
    return live.thinned_rows(events, "user_id", "at", "event_id", 50_000, 40_000).select("event_id", "user_id", "shown")


@register("""
    WITH RECURSIVE k AS (SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN 'begin' WHEN 1 THEN 'finish' WHEN 2 THEN CASE event_id % 5 WHEN 0 THEN 'reset' WHEN 1 THEN 'drop' ELSE 'finish' END ELSE 'frame' END AS kind, CAST(event_id % 3 > 0 AS BIGINT) AS view FROM events),
    c AS (SELECT *, count(*) FILTER (kind IN ('begin', 'reset')) OVER (PARTITION BY user_id ORDER BY event_id) - CAST(event_id % 4 = 0 AS BIGINT) AS gen, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM k),
    f AS (SELECT event_id, user_id, kind, rn, CAST(kind IN ('begin', 'reset') AS BIGINT) AS now, CASE WHEN kind = 'begin' THEN view END AS shown, 0::BIGINT AS buffer, CASE WHEN kind = 'finish' THEN FALSE END AS accepted,
                 kind IN ('drop', 'reset') OR (kind = 'finish' AND gen = 0) AS ends FROM c WHERE rn = 1
          UNION ALL
          SELECT c.event_id, c.user_id, c.kind, c.rn, f.now + CAST(c.kind IN ('begin', 'reset') AS BIGINT), CASE WHEN c.kind = 'begin' THEN c.view ELSE f.shown END, f.buffer + CAST(f.ends AS BIGINT),
                 CASE WHEN c.kind = 'finish' THEN coalesce(c.gen = f.now AND c.view = f.shown, FALSE) END, c.kind IN ('drop', 'reset') OR (c.kind = 'finish' AND c.gen = f.now)
          FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1)
    SELECT a.user_id, a.event_id, b.event_id AS published_by FROM f a JOIN f b ON a.kind = 'frame' AND b.accepted AND a.user_id = b.user_id AND a.buffer = b.buffer
""")
def gated_frames(spark, sf_dir):
    """Frames that snapshots replay: each user's events read as begins, finishes (some stale), drops, resets and frames."""
    e, k = F.col("event_id"), F.col("event_id") % 7
    kind = F.when(k == 0, "begin").when(k == 1, "finish").when(k == 2, F.when(e % 5 == 0, "reset").when(e % 5 == 1, "drop").otherwise("finish")).otherwise("frame")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"), (e % 3 > 0).cast("long").alias("view"))
    begun = F.count_if(F.col("kind").isin("begin", "reset")).over(Window.partitionBy("user_id").orderBy("event_id"))
    events = events.withColumn("gen", begun - (e % 4 == 0).cast("long"))
    return live.published(live.gated(events, "user_id", "event_id", "kind", "gen", "view"), "user_id", "event_id", "kind")
