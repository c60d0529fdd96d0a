"""Pages and run texts as tables: accessibility trees, digests, feeds on screen, report sections."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.links import untruncated
from brindle.functions.text import strip_html
from brindle.operators.core import keep_first
from brindle.sources.readers import html_tables, largest_records
from brindle.tables import written

#: Roles that print no line of their own, page furniture, and cells (fixed values).
SILENT_ROLES = frozenset({"none", "presentation", "generic", "InlineTextBox", "LineBreak", "ListMarker", "RootWebArea", "WebArea"})
LANDMARKS = frozenset({"navigation", "banner", "contentinfo", "complementary"})
CELLS = frozenset({"cell", "gridcell", "columnheader", "rowheader"})
#: Roles whose text is one line: how the line starts and what stands between its words (fixed values).
LINE_ROLES = {"row": ("row: ", " "), "listitem": ("- ", " "), "article": ("article: ", " ; "), "StaticText": ("", " ")}
#: Roles that hold others when they have no name, and roles that are printed even without one (fixed values).
HOLDERS = frozenset({"list", "table", "grid"})
NAMED_ROLES = frozenset({"heading", "button", "link", "textbox", "combobox", "tab"})
#: Doublings of the way up a tree: nodes deeper than 2^ROUNDS, or on a ring, hang on no root and say nothing.
ROUNDS = 20


# ---------------------------------------------------------------- trees
def _ways(trees: DataFrame) -> DataFrame:
    """page_id, way: for each node that hangs on its page's root, the nodes from the root down to itself (at: place among its siblings, role, name, shown). Ways double in length each round."""
    listed = trees.filter(F.size("nodes") > 0).select("page_id", "nodes", F.coalesce(F.filter("nodes", lambda n: F.coalesce(n["parent"], F.lit("")) == "")[0]["id"], F.col("nodes")[0]["id"]).alias("root"))
    nodes = listed.select("page_id", "root", F.explode("nodes").alias("n")).select("page_id", "root", "n.*").dropDuplicates(["page_id", "id"])
    edges = nodes.select("page_id", F.col("id").alias("up"), F.posexplode("children").alias("at", "id"))
    name, role = F.trim(F.coalesce("name", F.lit(""))), F.coalesce("role", F.lit(""))
    shown = ~F.coalesce("ignored", F.lit(False)) & ~role.isin(*SILENT_ROLES)
    placed = nodes.drop("children").join(edges, ["page_id", "id"], "left").select(
        "page_id", "id", F.when(F.col("id") != F.col("root"), F.coalesce("up", F.lit(""))).alias("up"),
        F.array(F.struct(F.coalesce("at", F.lit(0)).alias("at"), role.alias("role"), name.alias("name"), shown.alias("shown"))).alias("way"),
    ).dropDuplicates(["page_id", "id"])
    for _ in range(ROUNDS):
        placed = written(placed)
        if placed.filter("up is not null").isEmpty():
            break
        above = placed.select("page_id", F.col("id").alias("up"), F.col("up").alias("higher"), F.col("way").alias("before"))
        longer = placed.filter("up is not null").join(above, ["page_id", "up"]).select("page_id", "id", F.col("higher").alias("up"), F.concat("before", "way").alias("way"))
        placed = placed.filter("up is null").union(longer)
    return placed.filter("up is null").select("page_id", "way")


def tree_text(trees: DataFrame) -> DataFrame:
    """page_id, text: accessibility trees (page_id, nodes: array of id, parent, role, name, ignored, children) as compact lines.

    A node's line, its indent and the line that takes in its words all follow
    from the nodes above it, so every node is judged by itself and lines are
    put in order at the end. Menus, headers and footers are left out, unless
    hardly anything is left. A page without nodes has an empty text.
    """
    ways = _ways(trees)
    size, me = F.size("way"), F.element_at("way", -1)
    closes = lambda n: n["shown"] & n["role"].isin(*LINE_ROLES)
    closed = F.array_position(F.transform("way", closes), True).cast("int")  # the first node whose line takes in all below it
    ways = ways.withColumn("head", F.when(closed > 0, closed).otherwise(size)).withColumn("line", F.slice("way", F.lit(1), F.col("head")))
    top = F.element_at("line", -1)
    indents = lambda n: n["shown"] & (n["role"].isin(*HOLDERS) | (n["name"] != ""))
    ways = ways.select(
        "page_id", "way", "head", F.transform("line", lambda n: n["at"]).alias("path"), top.alias("top"), F.exists("line", lambda n: n["role"].isin(*LANDMARKS)).alias("aside"),
        F.repeat(F.lit("  "), F.size(F.filter(F.slice("line", F.lit(1), F.col("head") - 1), indents))).alias("pad"),
    )
    # Words of rows belong to cells and are told apart from their cell on; those of other lines from the line's own node on.
    in_row, head = F.col("top.role") == "row", F.col("head")
    cell = F.when(in_row, F.when((size > head) & F.get("way", head)["role"].isin(*CELLS), F.get("way", head)["at"])).when((F.col("top.role") != "StaticText") | (size == head), 0)
    start = F.when(in_row, head + 1).otherwise(head)
    above = F.slice("way", start, F.greatest(size - start, F.lit(0)))
    told = F.exists(F.filter(above, lambda n: n["shown"] & (n["name"] != "")), lambda n: F.contains(n["name"], me["name"]))
    word = F.when(me["shown"] & (me["name"] != "") & ~told, me["name"])
    keys = ["page_id", "path", "top", "aside", "pad"]
    speaking = ways.filter(closes(F.col("top"))).withColumn("cell", cell).filter("cell is not null")
    cells = speaking.withColumn("word", word).groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(F.struct(F.transform("way", lambda n: n["at"]).alias("p"), F.col("word").alias("w")))).alias("words"))
    between = F.when(F.col("top.role") == "article", LINE_ROLES["article"][1]).otherwise(" ")
    joined = cells.withColumn("said", F.array_join(F.transform("words", lambda x: x["w"]), "\u0000")).withColumn("said", F.replace("said", F.lit("\u0000"), between))
    closed_lines = joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "said"))), lambda x: x["said"]), " | ").alias("said"), F.max(F.col("said") != "").alias("any")).filter("any")
    begin = F.element_at(F.create_map(*[F.lit(v) for k, (mark, _) in LINE_ROLES.items() for v in (k, mark)]), F.col("top.role"))
    closed_lines = closed_lines.select("page_id", "path", "aside", F.concat("pad", begin, "said").alias("text"))
    plain = ways.filter(~closes(F.col("top")) & F.col("top.shown"))
    name = F.col("top.name")
    plain = plain.filter((name != "") | F.col("top.role").isin(*HOLDERS, *NAMED_ROLES)).select(
        "page_id", "path", "aside", F.concat("pad", "top.role", F.when(name != "", F.concat(F.lit(' "'), F.substring(name, F.lit(1), F.lit(300)), F.lit('"'))).otherwise("")).alias("text")
    )
    lines = closed_lines.union(plain).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("path", "aside", "text"))).alias("lines"))
    text = lambda kept: F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    body = text(F.filter("lines", lambda x: ~x["aside"]))
    whole = lines.select("page_id", F.when(F.char_length(F.regexp_replace(body, r"^\s+|\s+$", "")) >= 50, body).otherwise(text(F.col("lines"))).alias("text"))
    return trees.select("page_id").join(whole, "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"))


def item_estimate(text: Column) -> Column:
    """How many items a tree's text lists: table rows without the header, cards, or list items when there are five."""
    n = lambda mark: F.regexp_count(text, F.lit(rf"(?m)^\s*{mark}"))
    rows, items = n("row:"), n("- ")
    return F.greatest(F.when(rows > 1, rows - 1).otherwise(0), n("article:"), F.when(items >= 5, items).otherwise(0))


# ---------------------------------------------------------------- pages
def page_digests(pages: DataFrame, most_tables: int = 6, table_chars: int = 60_000) -> DataFrame:
    """page_id, json_ld, app_data, tables (number, rows, text; the largest first within a budget), text: what a page says, for a reader with little room."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for html in pdf["html"]:
                grids: dict[int, list[str]] = {}
                for number, _, _, cells in html_tables(html or ""):
                    grids.setdefault(number, []).append(" | ".join(cells))
                left, kept = table_chars, []
                for number, lines in sorted(((k, v) for k, v in grids.items() if len(v) >= 3), key=lambda x: -len(x[1]))[:most_tables]:
                    shown = []
                    for line in lines:
                        if len(line) + 1 > left:
                            break
                        shown.append(line)
                        left -= len(line) + 1
                    if not shown:
                        break
                    kept.append({"number": number, "rows": len(lines), "text": "\n".join(shown)})
                out.append(kept)
            yield pd.DataFrame({"page_id": pdf["page_id"], "html": pdf["html"], "tables": out})

    grids = pages.select("page_id", untruncated(F.coalesce("html", F.lit(""))).alias("html")).mapInPandas(run, "page_id long, html string, tables array<struct<number:int,rows:int,text:string>>")
    block = lambda mark: rf"""(?is)<script[^>]+{mark}[^>]*>(.*?)</script>"""
    return grids.select(
        "page_id", F.slice(F.regexp_extract_all("html", F.lit(block(r"""type=["']application/ld\+json["']""")), F.lit(1)), 1, 4).alias("json_ld"),
        F.regexp_extract("html", block(r"""id=["']__NEXT_DATA__["']"""), 1).alias("app_data"), "tables", strip_html(F.col("html")).alias("text"),
    )


def mapped_tables(rows: DataFrame, mapping: dict[str, int], ident: str) -> DataFrame:
    """Table rows (page_id, table_no, row_no, is_header, cells) as records by column place, headers and empty rows left out; a row without an id gets its place."""
    cells = [F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(c) for c, k in mapping.items()]
    body = rows.filter(~F.col("is_header")).select("page_id", "table_no", "row_no", *cells).filter(F.concat(*[F.col(c) for c in mapping]) != "")
    return body.withColumn(ident, F.when(F.trim(ident) != "", F.col(ident)).otherwise(F.concat_ws("-", F.lit("row"), "table_no", "row_no")))


def until_known(listing: DataFrame, known: DataFrame, group: str, ident: str, order: str) -> DataFrame:
    """A list read newest first, up to the first row that is known already."""
    marked = listing.join(known.select(F.col(ident).alias("_known")).distinct(), F.col(ident) == F.col("_known"), "left")
    seen = F.max(F.col("_known").isNotNull().cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_seen", seen).filter("_seen = 0").drop("_seen", "_known")


# ---------------------------------------------------------------- feeds on screen
def recognised(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page's response whose records are the table on screen: page_id, url, n, score.

    Of three records or more, three in ten must show a value of eight
    characters or more in the page's text; most shown values win, then the longer list.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for page, url, body, text in zip(pdf["page_id"], pdf["url"], pdf["body"], pdf["text"], strict=True):
                try:
                    records = largest_records(json.loads(body))
                except ValueError:
                    continue
                if len(records) < 3:
                    continue
                shown = " ".join(text.lower().split())
                values = [[v for v in (" ".join(str(x).lower().split()) for x in r.values() if isinstance(x, (str, int, float))) if len(v) >= 8] for r in records[:30]]
                hits = [sum(v[:60] in shown for v in vs) for vs in values]
                if sum(h > 0 for h in hits) >= 0.3 * len(hits):
                    rows.append((page, url, len(records), round(sum(hits) / len(hits), 1) * 1_000_000 + len(records)))
            yield pd.DataFrame(rows, columns=["page_id", "url", "n", "score"])

    both = responses.join(pages.select("page_id", "text"), "page_id").select("page_id", "url", "body", "text")
    return keep_first(both.mapInPandas(run, "page_id long, url string, n long, score double"), ["page_id"], [F.desc("score"), "url"])


def feed_dates(cells: Column) -> Column:
    """The pattern in which a feed writes dates, from one of its cells; null where the cell is no date."""
    day = F.substring(cells, 4, 2).try_cast("int")
    return (
        F.when(cells.rlike(r"^\d{4}-\d{2}-\d{2}(?:T.*)?$"), "yyyy-MM-dd").when(cells.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.when(day > 12, "MM/dd/yyyy").otherwise("dd/MM/yyyy"))
        .when(cells.rlike(r"^\d{2}-\d{2}-\d{4}$"), "dd-MM-yyyy")
    )


def sampled_values(records: DataFrame, key: str, value: str, most: int = 12) -> DataFrame:
    """Distinct examples of each key of (key, value) records, at most ``most``, with the number of records that have the key."""
    kinds = records.filter(F.trim(value) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = kinds.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    return ranked.groupBy(key).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= most, F.col(value)))).alias("examples"))


# ---------------------------------------------------------------- run reports
#: Lines that open a section of a run's report (fixed values).
SECTIONS = (("strategies", r"^Discovery strategies"), ("validated", r"^VALIDATED SOURCES \(\d+\)"), ("rejected", r"^REJECTED \(\d+\)"), ("fills", r"^Fill validation"), ("other", r"^=== .* EXTRACTION ===|^Extractors / methods|^--- Master dataset"))


def report_lines(reports: DataFrame, ident: str, text: str) -> DataFrame:
    """A report's lines with the section that each stands in: ident, pos, line, section."""
    lines = reports.select(ident, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    opened = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS):
        opened = F.when(F.col("line").rlike(pattern), F.lit(name)).otherwise(opened)
    upto = Window.partitionBy(ident).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(opened, ignorenulls=True).over(upto), F.lit("head")))


def report_sources(lines: DataFrame, ident: str) -> DataFrame:
    """Validated and rejected sources of a report: ident, section, place, title, url, reason."""
    part = lines.filter(F.col("section").isin("validated", "rejected"))
    title = F.nullif(F.regexp_extract("line", r"^(?:\[\d+\]|•)\s+(.+)$", 1), F.lit(""))
    upto = Window.partitionBy(ident, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    item = part.withColumn("_t", title).withColumn("place", F.count("_t").over(upto)).filter("place > 0")
    url = F.coalesce(F.nullif(F.regexp_extract("line", r"^URL: (\S+)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^(\S+://\S+)$", 1), F.lit("")))
    reason = F.nullif(F.regexp_extract("line", r"^Reason: (.*)$", 1), F.lit(""))
    return item.groupBy(ident, "section", "place").agg(F.max("_t").alias("title"), F.min_by(url, F.when(url.isNotNull(), F.col("pos"))).alias("url"), F.max(reason).alias("reason"))


def fill_checks(lines: DataFrame, ident: str) -> DataFrame:
    """How full each source's rows were, as a report says: ident, url, status, fill_rate."""
    form = r"^•\s+(\S+) — \*\*(.+?)\*\* \(fill rate (\d+)%\)"
    hits = lines.filter((F.col("section") == "fills") & F.col("line").rlike(form))
    return hits.select(ident, F.regexp_extract("line", form, 1).alias("url"), F.regexp_extract("line", form, 2).alias("status"), F.regexp_extract("line", form, 3).cast("int").alias("fill_rate"))


def without_master_table(text: Column) -> Column:
    """Struct (text, removed): a report up to its table of rows, and how many rows were cut off; removed is null where there is no table."""
    mark = r"(?m)^--- Master dataset \((\d+) rows\) ---$"
    n = F.nullif(F.regexp_extract(text, mark, 1), F.lit(""))
    head = F.regexp_replace(F.regexp_replace(text, r"(?ms)^--- Master dataset \(\d+ rows\) ---$.*\z", ""), r"\s+\z", "")
    return F.struct(F.when(n.isNotNull(), head).otherwise(text).alias("text"), n.cast("int").alias("removed"))


def run_report(goal: str, queries: DataFrame, sources: DataFrame, failed: DataFrame, columns: list[str]) -> str:
    """A run's report as text: the first 12 queries, 20 sources, 10 rejected ones and 8 failed links. Only these rows reach the driver."""
    def head(df: DataFrame, order: str, n: int) -> tuple[int, list]:
        return df.count(), df.orderBy(order).limit(n).collect()

    n_queries, asked = head(queries, "place", 12)
    n_sources, used = head(sources, "place", 20)
    n_rejected, refused = head(sources.filter("blocked"), "place", 10)
    n_failed, links = head(failed, "url", 8)
    lines = ["=== SOURCE DISCOVERY ===", f"Goal: {goal}", "Status: complete", "", f"Discovery strategies ({n_queries} searches)", *(f"• {r['query']}" for r in asked), "", f"VALIDATED SOURCES ({n_sources})"]
    lines += [x for i, r in enumerate(used, 1) for x in (f"[{i}] {r['title']}", f"   URL: {r['url']}")]
    lines += ["", f"REJECTED ({n_rejected})", *(x for r in refused for x in (f"• {r['title']}", r["url"], "Reason: blocked"))]
    lines += ["", f"Links that failed ({n_failed})", *(f"- {r['url']}: {r['outcome']}" for r in links)] if n_failed else []
    return "\n".join([*lines, "", f"Expected columns: {', '.join(columns)}"] if columns else lines)


# ---------------------------------------------------------------- staging
class Staging:
    """A run's folder for downloaded files in shared storage; gone when the block ends. Files that are too large, or pages in place of files, are refused."""

    def __init__(self, spark: SparkSession, folder: str, most_bytes: int = 50 << 20) -> None:
        self.folder, self.most = folder, most_bytes
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._spark = spark

    def __enter__(self) -> Staging:
        self._fs.mkdirs(self._path)
        return self

    def __exit__(self, *_: object) -> None:
        self._fs.delete(self._path, True)

    def files(self) -> DataFrame:
        """path, length, refused (why a file is not read, null for good ones)."""
        found = self._spark.read.format("binaryFile").load(self.folder)
        start = F.lower(F.decode(F.substring("content", 1, 256), "ISO-8859-1"))
        refused = F.when(F.col("length") > self.most, "too large").when(start.rlike(r"^\s*(?:<!doctype html|<html)"), "a page, not a file")
        return found.select("path", "length", refused.alias("refused"))
