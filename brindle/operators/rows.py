"""Row-level rules of ingestion: mapping, aliases, junk, acceptance, budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import collapse, site_of
from brindle.operators.core import keep_first

#: Words that make a row a navigation row when they stand alone (fixed values).
NAVIGATION = ("home", "menu", "login", "sign in", "sign up", "search", "next", "previous", "more", "read more", "contact", "contact us", "about", "about us", "back", "close", "share")
#: Phrases of pages that block readers (fixed values).
WALLS = ("captcha", "access denied", "are you a robot", "unusual traffic", "enable javascript", "checking your browser", "forbidden", "cloudflare", "verify you are human")
#: Parts of host names that mark a maker's own site (fixed values).
MAKER_HINTS = ("motors", "auto", "cars", "vehicles", "mobility", "electric")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def first_filled(*cells: Column) -> Column:
    return F.coalesce(*[F.when(~blank(c), F.trim(c)) for c in cells])


def map_columns(records: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Output columns from record fields: several are joined by a space; a column without fields takes the one of the same letters and digits."""
    plain = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in reversed(records.columns)}
    out = []
    for name, fields in mapping.items():
        there = [f for f in fields if f in records.columns] or [plain[k] for k in [re.sub(r"[^a-z0-9]", "", name.lower())] if k in plain]
        cell = F.concat_ws(" ", *[F.when(~blank(F.col(f"`{f}`")), F.trim(F.col(f"`{f}`").cast("string"))) for f in there]) if there else F.lit("")
        out.append(cell.alias(name))
    return records.select(*out)


def pick_alias(columns: list[str], aliases: list[str]) -> list[str]:
    """Columns that may hold a field, best first: exact alias, alias in any case, alias inside the name; names with a leading underscore are left out."""
    free = [c for c in columns if not c.startswith("_")]
    exact = [a for a in aliases if a in free]
    same = [c for a in aliases for c in free if c.lower() == a.lower()]
    inside = [c for a in aliases for c in free if a.lower() in c.lower()]
    return list(dict.fromkeys([*exact, *same, *inside]))


def value_filter(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose cell equals one of the values, ignoring case; all rows where no row does. One plan, no job of its own."""
    hit = F.lower(collapse(F.col(column))).isin(*[" ".join(v.lower().split()) for v in values])
    any_hit = df.agg(F.coalesce(F.bool_or(hit), F.lit(False))).scalar()
    return df.filter(F.coalesce(hit, F.lit(False)) | ~any_hit)


def junk_row(name: Column) -> Column:
    """Rows without a name, with a name of one character, a navigation word, a question or a bare link."""
    text = F.lower(collapse(F.coalesce(name, F.lit(""))))
    return (F.char_length(text) <= 1) | text.isin(*NAVIGATION) | F.endswith(text, F.lit("?")) | text.rlike(r"^(https?://|www\.)\S+$")


def headline(name: Column) -> Column:
    """A text that reads like a headline and not like a product's name."""
    text = F.lower(collapse(F.coalesce(name, F.lit(""))))
    return text.rlike(r"^(how|what|why|when|which|top \d+|best|\d+ (best|things))\b") | (F.size(F.split(text, " ")) > 10)


def page_outcome(status: Column, title: Column, tables: Column) -> Column:
    """Struct (outcome, reason) of a page that was opened."""
    named = lambda o, r: F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"))
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(status.isNull(), named("failed", "no answer")).when(status == 404, named("failed", "not found")).when(status.isin(401, 403, 429), named("blocked", "refused"))
        .when(status >= 500, named("failed", "server error")).when(low.rlike("not found|error 404"), named("failed", "not found")).when(walled(low), named("blocked", "wall")).when(F.coalesce(tables, F.lit(0)) == 0, named("empty", "no tables")).otherwise(named("ok", ""))
    )


def walled(text: Column, least: int = 2) -> Column:
    """Whether a page shows at least two of the wall phrases."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in WALLS[1:]), F.contains(low, F.lit(WALLS[0])).cast("int")) >= least


def maker_site(url: Column, category: Column) -> Column:
    return F.coalesce(category.isin("manufacturer", "brand", "dealer"), F.lit(False)) | site_of(url).rlike("|".join(MAKER_HINTS))


def within_budget(df: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows in order while their running size stays within the budget of their key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= budget).drop("_sum")


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Live append: columns that only one side has are added at the end and left empty on the other."""
    return left.unionByName(right, allowMissingColumns=True)


def fan_out(rows: DataFrame, host: str, read) -> DataFrame:
    """Reads each host once and gives every row of that host the result; ``read`` maps a frame of hosts to one with more columns."""
    return rows.join(read(rows.select(host).distinct()), host, "left")


def sources_of(planned: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Planned and discovered sources, first of each url, with the number of their rows and a status."""
    both = planned.select("url", F.lit(0).alias("_p")).unionByName(found.select("url", F.lit(1).alias("_p")))
    n = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    joined = keep_first(both, ["url"], ["_p"]).join(n, "url", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("url", F.when(F.col("n") > 0, "used").when(F.col("_p") == 0, "planned").otherwise("found").alias("status"), "n")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Replace-and-move-to-end: the latest row of each key."""
    return keep_first(df, [key], [F.desc(order)])


def day_bucket(day: Column, today: Column) -> Column:
    """History groups of local days."""
    ago = F.date_diff(today, day)
    return F.when(ago <= 0, "Today").when(ago == 1, "Yesterday").when(ago <= 7, "Previous 7 days").when(ago <= 30, "Previous 30 days").otherwise("Older")


def subset(a: Column, b: Column) -> Column:
    """Whether every element of ``a`` is in ``b``."""
    return F.size(F.array_except(a, b)) == 0


def word_overlap(a: Column, b: Column) -> Column:
    words = lambda c: F.array_remove(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), "")
    return F.size(F.array_intersect(words(a), words(b)))


def grouped_digits(n: Column) -> Column:
    """A whole number with Indian grouping: the last three digits, then twos."""
    text = F.abs(n).cast("string")
    head = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(F.char_length(text) - 3, F.lit(0))), r"(?<=\d)(?=(\d\d)+$)", ",")
    body = F.when(F.char_length(text) > 3, F.concat(head, F.lit(","), F.right(text, F.lit(3)))).otherwise(text)
    return F.when(n < 0, F.concat(F.lit("-"), body)).otherwise(body)


def compact(n: Column) -> Column:
    """1.2K, 3.4M, 5B with at most one decimal."""
    size = F.abs(n)
    cut = lambda d, s: F.concat(F.regexp_replace(F.format_string("%.1f", n / d), r"\.0$", ""), F.lit(s))
    return F.when(size >= 1e9, cut(1e9, "B")).when(size >= 1e6, cut(1e6, "M")).when(size >= 1e3, cut(1e3, "K")).otherwise(F.regexp_replace(F.format_string("%.1f", n * 1.0), r"\.0$", ""))
