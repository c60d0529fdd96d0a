"""Main text of web pages: nearest-URL page differencing, checked by markup.

Every page goes through the differencing: it is paired with the nearest URL
paths of its host, its lines are aligned with theirs by longest common
subsequence, and shared lines are deleted. Differencing alone can't give right
results here: it deletes article lines that stand on two neighbouring URLs and
keeps menus whose links differ from page to page. So explicit markup checks its
verdicts: lines inside an article or main element are put back, and menus,
footers, adverts, forms and the like never stay. All other lines are the
differencing's to decide, beside an article too. ``markup=False`` leaves every
visible line to the differencing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize, only, slices, without
from brindle.llm.urls import split_url

#: Elements whose content is never part of the article.
SKIPPED = frozenset("script style noscript template nav footer aside form iframe object svg canvas button select textarea dialog menu title datalist audio video map".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run on inside a block; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words of class, id and role values that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu nav navbar navigation newsletter notice popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split()
)
#: Elements that no reader sees.
UNSEEN = frozenset("script style noscript template title head datalist".split())
#: Ranks on both sides among which a page looks for neighbours, neighbours that judge its lines, and the share of text from which a neighbour is a copy.
REACH, NEIGHBOURS, COPY = 4, 2, 0.9
#: Zones of a page's lines: the article, what markup leaves open, what it marks as something else. HIDDEN is no line of the page.
CONTENT, OPEN, FURNITURE, HIDDEN = range(4)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_NAME = re.compile(r"[a-z0-9]+")
_CLOSES_P = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote section article header footer nav aside form main hr address figure fieldset".split())


class _Blocks(HTMLParser):
    """Collects (zone, text) of a page's blocks in page order. Work is linear in the page: open elements are counted by tag."""

    def __init__(self, markup: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.markup = markup
        self.blocks: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, 0 or FURNITURE or HIDDEN, content
        self.opened: Counter[str] = Counter()
        self.text: list[str] = []

    def _state(self, below: int = 0) -> tuple[int, bool]:
        return self.stack[-1 - below][1:] if len(self.stack) > below else (0, False)

    def flush(self) -> None:
        line = _SPACE.sub(" ", "".join(self.text)).strip(" ")
        self.text = []
        skipped, content = self._state()
        if line and skipped != HIDDEN:
            self.blocks.append((skipped or (CONTENT if content else OPEN), line))

    def _hidden(self, tag: str, attrs: list[tuple[str, str | None]], content: bool) -> bool:
        return (tag in UNSEEN and not (tag == "head" and content)) or any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)

    def _boilerplate(self, tag: str, attrs: list[tuple[str, str | None]], content: bool) -> bool:
        """Whether an element starts something that is not the article. Outside one, words of class, id and role values count; inside one only whole class and role values."""
        if not self.markup:
            return False
        if tag in SKIPPED or (tag in ("header", "head") and not content):
            return True
        if content:
            return not BOILERPLATE.isdisjoint(w for k, v in attrs if k in ("class", "role") and v for w in v.lower().split())
        return tag not in ("article", "main") and not BOILERPLATE.isdisjoint(w for k, v in attrs if k in ("class", "id", "role") and v for w in _NAME.findall(v.lower()))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in _CLOSES_P and self.opened["p"]:
            self._close("p")
        skipped, content = self._state()
        if skipped != HIDDEN and tag not in ("html", "body"):
            if self._hidden(tag, attrs, content):
                skipped = HIDDEN
            elif not skipped and self._boilerplate(tag, attrs, content):
                skipped = FURNITURE
        content = content or (self.markup and tag in ("article", "main") and not skipped)
        self.stack.append((tag, skipped, content))
        self.opened[tag] += 1
        if tag in INLINE and (skipped, content) != self._state(1):
            top = self.stack.pop()
            self.flush()
            self.stack.append(top)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Ends the innermost open ``tag`` and all it holds; a stray end tag ends nothing."""
        if not self.opened[tag]:
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        outside = self.stack[k - 1][1:] if k else (0, False)
        if any(e[1:] != outside for e in self.stack[k:]):
            self.flush()
        for name, _, _ in self.stack[k:]:
            self.opened[name] -= 1
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def blocks_of(html: str, markup: bool = True) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in page order."""
    parser = _Blocks(markup)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def parse(pages: DataFrame, markup: bool = True) -> DataFrame:
    """page_id, url, host, path; zones, keys, sizes of all lines; lines, marks: all but furniture and their zones; t: a hash of these.

    A key is the 64-bit hash of a line, its size the code points.
    """
    schema = "page_id long, url string, host string, path string, zones array<tinyint>, keys array<long>, sizes array<int>, lines array<string>, marks array<tinyint>, t long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in slices(whole, 4)):
            zones, keys, sizes, lines, marks, t = [], [], [], [], [], []
            for html in batch.column(4).to_pylist():
                blocks = blocks_of(html, markup) if html else []
                zones.append([z for z, _ in blocks])
                found = np.fromiter((xxhash.xxh64_intdigest(x) for _, x in blocks), np.uint64, len(blocks)).view(np.int64)
                keys.append(found)
                sizes.append([len(x) for _, x in blocks])
                lines.append([x for z, x in blocks if z != FURNITURE])
                marks.append([z for z, _ in blocks if z != FURNITURE])
                t.append(xxhash.xxh64_intdigest(found[[z != FURNITURE for z, _ in blocks]].tobytes() if blocks else b""))
            made = [pa.array(zones, pa.list_(pa.int8())), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(lines, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int8())), pa.array(np.array(t, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + made, names=["page_id", "url", "host", "path", "zones", "keys", "sizes", "lines", "marks", "t"])

    host, path = split_url(F.col("url"))
    return pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html").mapInArrow(run, schema)


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are set aside, the middle is solved through increasing runs of
    matching places (Hunt and Szymanski), so memory follows the matches.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < len(a) - lo and end < len(b) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = set(range(lo)) | set(range(len(a) - end, len(a)))
    where: dict[object, list[int]] = {}
    for j in range(lo, len(b) - end):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(lo, len(a) - end):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def neighbours(rows: DataFrame) -> DataFrame:
    """(row, other): the NEIGHBOURS pages of each page's host that are nearest by URL path and say something else.

    Pages (row, host, path, t: a hash of their lines) are put in order of host
    and path once; every page gets its rank from its place in a range and the
    sizes of the ranges before, and looks at the REACH ranks on both sides. So
    range borders change nothing, and a host of any size spreads evenly. The
    nearest path needs the fewest steps up and down the tree of paths.
    """
    dealt = rows.select("row", "host", "path", "t").repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    placed = materialize(dealt.withColumn("g", F.monotonically_increasing_id()))
    part, at = F.shiftright("g", 33), F.col("g").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row for each range
    if not sizes:
        return rows.sparkSession.createDataFrame([], "row long, other long")
    starts, total = {}, 0
    for r in sizes:
        starts[r["p"]], total = total, total + r["n"]
    offsets = F.array(*[F.lit(starts.get(p, total)).cast("long") for p in range(max(starts) + 1)])
    ranked = placed.select("row", "host", F.filter(F.split("path", "/"), lambda s: s != "").alias("s"), "t", (F.get(offsets, part.cast("int")) + at).alias("rank"))
    asks = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(-REACH, REACH + 1) if k]))).withColumn("rank", F.col("rank") + F.col("k"))
    theirs = ranked.select(F.col("row").alias("other"), F.col("host").alias("host2"), F.col("s").alias("s2"), F.col("t").alias("t2"), "rank")
    met = asks.join(theirs, "rank").filter("host = host2 and t <> t2")
    same = F.aggregate(F.zip_with("s", "s2", lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, e: F.struct((a["n"] + (a["on"] & e).cast("int")).alias("n"), (a["on"] & e).alias("on")), lambda a: a["n"])
    steps = F.size("s") + F.size("s2") - 2 * same
    near = F.slice(F.sort_array(F.collect_list(F.struct(steps.alias("steps"), F.abs("k").alias("k"), "other"))), 1, NEIGHBOURS)  # of 2 x REACH at most
    return met.groupBy("row").agg(near.alias("near")).select("row", F.explode(F.transform("near", lambda x: x["other"])).alias("other"))


def shared_lines(keys: list[int], sizes: list[int], others: list[list[int]]) -> tuple[set[int], bool]:
    """(places of the lines that a neighbour has too, in common order; whether any neighbour judged). A neighbour that shares nearly all of the text is a copy and judges nothing."""
    size, gone, judged = sum(sizes), set(), False
    for other in others:
        shared = common_lines(keys, other)
        if sum(sizes[k] for k in shared) < COPY * size:
            gone |= shared
            judged = True
    return gone, judged


def checked(zones: list[int], gone: set[int], judged: bool) -> list[bool]:
    """Which lines (content and open ones) stay: article lines that the differencing deleted are put back; an open line beside an article needs a neighbour that lacks it."""
    beside = CONTENT in zones
    return [z == CONTENT or (k not in gone and (judged or not beside)) for k, z in enumerate(zones)]


def by_markup(zones: list[int]) -> list[bool]:
    """Which lines would stay if no neighbour were asked."""
    return checked(zones, set(), False)


def difference(rows: DataFrame) -> DataFrame:
    """(row, kept) of the pages (row, host, path, zones, keys, sizes, t) whose text the differencing changes; every page is aligned with its neighbours.

    Only keys are shuffled. A page's lines without furniture are aligned with
    all lines of a neighbour, so a menu that one page marks is known on another.
    """
    pairs = materialize(neighbours(rows))
    theirs = pairs.join(rows.select(F.col("row").alias("other"), F.col("keys").alias("theirs")), "other")
    grouped = theirs.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("other", "theirs"))), lambda x: x["theirs"]).alias("others"))  # NEIGHBOURS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, kept = [], []
            for row, zones, keys, sizes, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = [k for k, z in enumerate(zones) if z != FURNITURE]
                zones = [zones[k] for k in at]
                verdict = checked(zones, *shared_lines([keys[k] for k in at], [sizes[k] for k in at], others))
                if verdict != by_markup(zones):
                    numbers.append(row)
                    kept.append(verdict)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(kept, pa.list_(pa.bool_()))], names=["row", "kept"])

    return rows.select("row", "zones", "keys", "sizes").join(grouped, "row").mapInArrow(run, "row long, kept array<boolean>")


def extract(pages: DataFrame, markup: bool = True) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Every page is differenced with its neighbours; where that changes what
    markup alone leaves, its verdicts on lines are joined to the page's text.
    Blocks are joined in page order by one space; white space inside a block is
    one space; character references are decoded. Null html is empty and gives
    the empty text; a null url belongs to the empty host; repeated rows are
    extracted alike and don't judge each other; an empty table gives an empty
    result and other columns are not read.
    """
    parsed = materialize(parse(pages, markup).withColumn("row", F.monotonically_increasing_id()))
    changed = materialize(difference(parsed.select("row", "host", "path", "zones", "keys", "sizes", "t")))
    texts = parsed.select("row", "page_id", "url", "lines", "marks")
    mixed = F.array_contains("marks", F.lit(CONTENT).cast("tinyint")) & F.array_contains("marks", F.lit(OPEN).cast("tinyint"))
    plain = without(texts, changed, ["row"]).withColumn("lines", F.when(mixed, F.filter("lines", lambda x, k: F.get("marks", k) == CONTENT)).otherwise(F.col("lines")))
    judged = only(texts, changed, ["row"]).join(changed.hint("merge"), "row").withColumn("lines", F.filter("lines", lambda x, k: F.get("kept", k)))
    text = F.array_join("lines", " ")
    return plain.select("page_id", "url", "lines").union(judged.select("page_id", "url", "lines")).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
