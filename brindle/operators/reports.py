"""Reports over projects, sources and searches: filters, slicers, orders, site-keyed merges, counters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import site_of
from brindle.operators.core import keep_first
from brindle.operators.typing import ColumnProfile
from brindle.plans.query import Filter, condition

#: States of a source, the most alive first (fixed values).
SOURCE_STATES = ("reading", "used", "validated", "visited", "rejected")


# ---------------------------------------------------------------- projects
def _shown(name: str) -> Column:
    """Filters of a project list by name."""
    c = F.col
    named = {
        "all": F.lit(True), "running": c("status") == "running", "live": (c("kind") == "web") & c("live") & (c("status") != "error"), "paused": c("status") == "paused", "error": c("status") == "error",
        "data": c("rows") > 0, "empty": c("rows") == 0, "uploaded": c("kind") == "file",
    }
    return named[name]


def _preset(name: str, today: Column) -> tuple[Column, str | None]:
    """A one-click question about projects: its test, and the sort that it sets."""
    c = F.col
    named = {
        "most-rows": (c("rows") > 0, "rows"), "today": (F.to_date("updated_at") >= today, "updated"), "new-rows": (c("added") > 0, "rows"), "failed": (c("status") == "error", "updated"),
        "never-ran": ((c("kind") == "web") & (c("status") == "idle") & (c("cycle") == 0) & (c("rows") == 0), None),
    }
    return named[name]


def project_order(sort: str) -> list[Column]:
    return {"updated": [F.desc("updated_at")], "created": [F.desc("created_at")], "rows": [F.desc("rows")], "title": [F.lower("title")]}[sort]


def project_report(projects: DataFrame, search: str = "", shown: str = "all", preset: str | None = None, sort: str = "updated", today: Column | None = None) -> DataFrame:
    """Projects (title, source, detail, status, kind, live, rows, added, cycle, updated_at, created_at) that pass a filter, a preset and a text search, in order."""
    test = F.coalesce(_shown(shown), F.lit(False))
    if preset:
        own, set_sort = _preset(preset, F.current_date() if today is None else today)
        test, sort = test & F.coalesce(own, F.lit(False)), set_sort or sort
    if needle := search.strip().lower():
        test = test & (F.contains(F.lower("title"), F.lit(needle)) | F.contains(F.lower("source"), F.lit(needle)) | F.contains(F.lower("detail"), F.lit(needle)))
    return projects.filter(test).orderBy(*project_order(sort))


def owned_by(df: DataFrame, owner: str, column: str = "user_id") -> DataFrame:
    """The rows of one owner. An empty owner is an error: it must never widen a read to all."""
    if not isinstance(owner, str) or not owner.strip():
        raise ValueError("an owner is required")
    return df.filter(F.col(column) == owner)


# ---------------------------------------------------------------- slicers
@dataclass(frozen=True)
class Slicers:
    """What a dashboard's reader has picked: a search, values by column, and a range of period keys of the time column."""

    search: str = ""
    picks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    time: str | None = None
    low: str | None = None
    high: str | None = None

    def active(self) -> int:
        return bool(self.search.strip()) + sum(bool(v) for v in self.picks.values()) + bool(self.time and (self.low or self.high))


def sliced(df: DataFrame, profile: dict[str, ColumnProfile], columns: list[str], s: Slicers) -> DataFrame:
    """Typed rows that pass every slicer; both ends of the period range count, rows without a period don't."""
    out = df
    if s.search.strip():
        out = out.filter(condition(Filter("search", values=(s.search,)), profile, columns))
    for column, keys in s.picks.items():
        if keys:
            out = out.filter(condition(Filter("in", column, keys), profile, columns))
    if s.time and (s.low or s.high):
        key = F.col(f"{s.time}__key")
        inside = key.isNotNull() & (key >= s.low if s.low else F.lit(True)) & (key <= s.high if s.high else F.lit(True))
        out = out.filter(F.coalesce(inside, F.lit(False)))
    return out


# ---------------------------------------------------------------- orders
def natural_key(c: Column) -> Column:
    """A text that sorts as people count: runs of digits are padded, so "item 9" comes before "item 10"."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")


def grid_order(column: str, kind: str, descending: bool = False) -> list[Column]:
    """Order of a data grid: typed numbers and periods by value, text as people count; cells without a value last when ascending."""
    key = {"number": F.col(f"{column}__num"), "period": F.col(f"{column}__key")}.get(kind, natural_key(F.col(f"{column}__label")))
    return [key.desc_nulls_first() if descending else key.asc_nulls_last()]


def grid_page(df: DataFrame, order: list[Column], page: int = 0, size: int = 50, row: str = "_row") -> DataFrame:
    """One page of a grid on a total order."""
    return df.orderBy(*order, row).offset(page * size).limit(size)


def lead_order(df: DataFrame) -> DataFrame:
    """Leads: best score first, then most reviews, then name."""
    return df.orderBy(F.desc("score"), F.coalesce("reviews", F.lit(0)).desc(), F.lower("name"))


def merged_order(df: DataFrame, name: str, row: str) -> DataFrame:
    """A merged table by lower-cased name, equal names as they came."""
    return df.orderBy(F.lower(name), row)


def candidate_order(df: DataFrame) -> DataFrame:
    """Candidate pages: secure ones first, then those with tables, then by the mean of their two scores."""
    return df.orderBy(F.desc("https_ok"), (F.col("tables") > 0).desc(), ((F.col("legit") + F.col("relevance")) / 2).desc(), "url")


def source_order(df: DataFrame, row: str) -> DataFrame:
    """Sources: the one being read first, rejected ones last, most rows first, ties as they came."""
    place = F.when(F.col("state") == "reading", 0).when(F.col("state") == "rejected", 2).otherwise(1)
    return df.orderBy(place, F.desc("rows"), row)


# ---------------------------------------------------------------- sources
def merge_sites(validated: DataFrame, rows: DataFrame, visits: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per site: site, state, rows, share of all rows, reason.

    All four sides have a url; ``rejected`` a reason too. Rows beat a
    rejection, a rejection beats what was only validated or visited.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    one = lambda df, name, extra=F.lit(None).cast("string"): df.select(site_of(F.col("url")).alias("site"), F.lit(name).alias("_from"), extra.alias("_reason"))
    counted = rows.filter("url is not null and trim(url) <> ''").groupBy(site_of(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("_n")).select("site", F.lit("used").alias("_from"), F.lit(None).cast("string").alias("_reason"), "_n")
    others = one(validated, "validated").union(one(visits, "visited")).union(one(rejected, "rejected", F.col("reason"))).withColumn("_n", F.lit(0).cast("long"))
    said = lambda name: F.bool_or(F.col("_from") == name)
    g = others.union(counted).groupBy("site").agg(F.sum("_n").alias("rows"), said("validated").alias("v"), said("rejected").alias("r"), F.min(F.when(F.col("_from") == "rejected", F.col("_reason"))).alias("reason"))
    state = F.when(F.col("rows") > 0, "used").when(F.col("r"), "rejected").when(F.col("v"), "validated").otherwise("visited")
    share = F.when(F.col("rows") > 0, F.bround(F.col("rows").cast("decimal(20,4)") * 100 / total.cast("decimal(18,0)"), 2))
    return g.select("site", state.alias("state"), "rows", share.alias("share"), F.when(state == "rejected", F.col("reason")).alias("reason"))


def by_position(left: DataFrame, right: DataFrame, key: str, left_list: str, right_list: str) -> DataFrame:
    """Pairs two lists of one key by position: key, pos, and the two elements, null where a list is shorter."""
    pairs = F.posexplode(F.arrays_zip(F.col(left_list).alias("a"), F.col(right_list).alias("b")))
    return left.join(right, key).select(key, pairs.alias("pos", "_p")).select(key, "pos", F.col("_p")["a"].alias(left_list), F.col("_p")["b"].alias(right_list))


def counters(df: DataFrame, **tests: Column) -> DataFrame:
    """How many rows pass each named test, in one pass."""
    return df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])


def rescored(rows: DataFrame) -> DataFrame:
    """The count that a new scoring starts from: every row accepted."""
    return rows.agg(F.count(F.lit(1)).alias("accepted"), F.lit(0).cast("long").alias("partial"), F.lit(0).cast("long").alias("rejected"))


def rendered_rows(feed_total: Column, table_rows: Column, tree_items: Column) -> Column:
    """How many records a page lists: its feed's total, else its largest table, else its tree's items."""
    return F.coalesce(F.nullif(feed_total, F.lit(0)), F.nullif(table_rows, F.lit(0)), tree_items, F.lit(0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def json_number(c: Column) -> Column:
    """A number as JSON text: whole ones without a point."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"))


# ---------------------------------------------------------------- ranks
def queue_position(df: DataFrame, queue: str, order: list[str | Column]) -> DataFrame:
    """Adds position: 1 for the next of its queue."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(queue).orderBy(*order)))


def term_cap(target: int, terms: int) -> int:
    """What one category may bring while others wait: one and a half times its even share."""
    return -(-3 * target // (2 * max(1, terms)))


def deferred(df: DataFrame, term: str, order: str, cap: int) -> DataFrame:
    """Adds deferred: true for rows of a category that has had its share."""
    before = F.count(F.lit(1)).over(Window.partitionBy(term).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("deferred", F.coalesce(before, F.lit(0)) >= cap)


def capped_turns(tasks: DataFrame, queue: str, term: str, order: str, brought: str, target: int) -> DataFrame:
    """Adds deferred, position and ran: searches of a queue in the order in which they are made until ``target`` new rows are there.

    A category that has brought one and a half times its even share of the
    target waits; when nothing else is left to search, what waits follows in
    its own order and the cap no longer holds. With one category nothing waits.
    What was brought before a category reached its share is the sum of all its
    earlier searches, so a running sum decides who waits; a second one, in the
    order of the searches, says which are still made.
    """
    own = Window.partitionBy(queue, term).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    terms = tasks.groupBy(F.col(queue).alias("_queue")).agg(F.count_distinct(term).alias("_terms"))
    all_ = tasks.join(terms, F.col(queue).eqNullSafe(F.col("_queue")))
    cap = F.ceil(F.lit(target * 1.5) / F.greatest(F.lit(1), F.col("_terms")))
    waits = (F.col("_terms") > 1) & (F.coalesce(F.sum(brought).over(own), F.lit(0)) >= cap)
    turns = all_.withColumn("deferred", waits)
    made = Window.partitionBy(queue).orderBy("deferred", order)
    before = F.coalesce(F.sum(brought).over(made.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumns({"position": F.row_number().over(made), "ran": before < target}).drop("_queue", "_terms")


def reranked(df: DataFrame, group: str, url: str, rank: str) -> DataFrame:
    """Ranked sites of a group, the first of each url kept, numbered 1 to n again."""
    plain = df.withColumn("_url", F.regexp_replace(url, "/+$", ""))
    return keep_first(plain, [group, "_url"], [rank]).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(rank))).drop("_url")


def first_answering(backends: list[DataFrame], key: str) -> DataFrame:
    """Each key's rows from the first backend that has any for it."""
    both = backends[0].withColumn("_b", F.lit(0))
    for k, df in enumerate(backends[1:], 1):
        both = both.unionByName(df.withColumn("_b", F.lit(k)))
    least = both.groupBy(key).agg(F.min("_b").alias("_least"))
    return both.join(least, key).filter("_b = _least").drop("_b", "_least")


def allowed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list."""
    return df.join(listed.select(key).distinct(), key, "left_semi")
