"""Paged JSON feeds as a Spark data source, read at once or as a stream.

The driver finds the page size and the last page in a few requests (the number
of requests grows with the logarithm of the pages); tasks read runs of pages.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from brindle.sources.readers import flat, largest_records

#: Names under which envelopes give their number of records (fixed values).
TOTAL_NAMES = ("total", "totalcount", "total_count", "totalelements", "total_elements", "totalrecords", "total_records", "totalresults", "rowscount", "count", "recordsfiltered", "numfound")


def find_total(value, depth: int = 2) -> int | None:
    """The number of records that an envelope names, at most two levels down."""
    if not isinstance(value, dict):
        return None
    for k, v in value.items():
        if k.lower() in TOTAL_NAMES and isinstance(v, int) and not isinstance(v, bool) and v >= 0:
            return v
    found = (find_total(v, depth - 1) for v in value.values() if depth > 0)
    return next((n for n in found if n is not None), None)


def list_path(value, depth: int = 4) -> list | None:
    """The keys that lead to a page's records: to its longest list of two objects or more, else to the nearest list that begins with an object of two keys or more."""
    wanted = largest_records(value, depth)
    waiting: list[tuple[object, list]] = [(value, [])]
    for here, path in waiting:  # by depth: the list grows as it is read
        records = [v for v in here if isinstance(v, dict)] if isinstance(here, list) else []
        if records and (records == wanted if wanted else len(records[0]) >= 2):
            return path
        if len(path) < depth:
            inner = here.items() if isinstance(here, dict) else enumerate(here) if isinstance(here, list) else ()
            waiting += [(v, [*path, k]) for k, v in inner if isinstance(v, (dict, list))]
    return None


def at_path(value, path: list) -> list[dict]:
    for k in path:
        value = value.get(k) if isinstance(value, dict) else value[k] if isinstance(value, list) and isinstance(k, int) and k < len(value) else None
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def fetch_url(url: str) -> str:
    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


class Pages(InputPartition):
    """Pages ``first`` to ``last``; ``skip`` rows of the first were read before, ``upto`` rows of the last count (None: all)."""

    def __init__(self, first: int, last: int, size: int, skip: int = 0, upto: int | None = None):
        super().__init__((first, last))
        self.first, self.last, self.size, self.skip, self.upto = first, last, size, skip, upto


def digest(record) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()[:32]


class Feed:
    """Requests of one feed and what they say about its pages.

    Options: ``url`` with {page}, {offset} and {size}; ``paging`` (page or
    offset); ``pagesize``, one or several, the largest is tried first and the
    next where it is refused or not kept to; ``maxpages``; ``lenient``, which
    takes a page that can't be read as the end instead of failing.
    """

    def __init__(self, options: dict, fetch: Callable[[str], str] = fetch_url):
        self.url = options["url"]
        self.sizes = sorted({int(s) for s in str(options.get("pagesize", 100)).split(",")}, reverse=True)
        self.by_offset = options.get("paging", "page") == "offset"
        self.most, self.fetch = int(options.get("maxpages", 1 << 20)), fetch
        self.lenient = str(options.get("lenient", "false")).lower() == "true"
        self.path: list | None = None

    def page(self, n: int, size: int) -> tuple[list[dict], int | None]:
        """Records of page ``n``, found where those of the first page were, and the total that its envelope names."""
        found = json.loads(self.fetch(self.url.format(page=n, offset=(n - 1) * size, size=size)))
        if n == 1:
            self.path = list_path(found)
        elif self.path is None:
            self.page(1, size)
        return at_path(found, self.path) if self.path is not None else [], find_total(found)

    def records(self, n: int, size: int) -> list[dict]:
        try:
            return self.page(n, size)[0]
        except (OSError, ValueError):
            if self.lenient and n > 1:
                return []
            raise

    def size(self) -> tuple[int, list[dict], int | None]:
        """(page size that the feed keeps to, its first page, its total or None)."""
        for last in (False, True):
            for size in self.sizes:
                try:
                    records, total = self.page(1, size)
                except (OSError, ValueError):
                    if size == self.sizes[-1]:
                        raise
                    continue
                kept = len(records) == size or (total is not None and total <= len(records)) or not records
                if not kept and total is None:
                    kept = self.is_end(2, size, records)
                if kept:
                    return size, records, total
            if last or not records:
                break
            self.sizes = [len(records)]  # the feed has a size of its own
        return size, records, total

    def is_end(self, n: int, size: int, first: list[dict], before: list[dict] | None = None) -> bool:
        """Whether page ``n`` is past the end: empty, or the first page or the one before once more."""
        found = self.records(n, size)
        if not found:
            return True
        known = [first[:1], (before if before is not None else self.records(n - 1, size) if n > 2 else first)[:1]]
        return found[:1] in known

    def last_page(self, size: int, first: list[dict], total: int | None, from_page: int = 1) -> int:
        """The last page with records. A total is checked; without one, or where there is more, steps double until the end and are halved back."""
        if not first:
            return 0
        low = max(1, from_page)
        if total is not None:
            told = max(1, -(-total // size))
            if told <= self.most and told >= low and (told == 1 or not self.is_end(told, size, first)) and self.is_end(told + 1, size, first):
                return told
        high, step = low + 1, 1
        while high <= self.most and not self.is_end(high, size, first):
            low, step = high, step * 2
            high += step
        high = min(high, self.most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.is_end(mid, size, first) else (mid, high)
        return low

    def rows(self, part: Pages) -> Iterator[tuple]:
        """(row number in the feed, cells). A page that repeats the one before, in whichever partition that is, or the first one, ends the run."""
        first = before = None
        if 1 < part.first <= part.last:
            first = before = self.records(1, part.size)[:1]
            if part.first > 2:
                before = self.records(part.first - 1, part.size)[:1]
        for n in range(part.first, part.last + 1):
            records = self.records(n, part.size)
            if not records or records[:1] in (first, before):
                return
            before = records[:1]
            first = first or before
            for i, r in enumerate(records[: part.upto] if n == part.last else records):
                if n > part.first or i >= part.skip:
                    yield (n - 1) * part.size + i, {k: flat(v) for k, v in r.items()}


#: Pages of one task: each task reads two pages more to know repeats.
RUN_PAGES = 16


def runs(first: int, last: int, size: int, skip: int = 0, upto: int | None = None) -> list[Pages]:
    starts = range(first, last + 1, RUN_PAGES)
    return [Pages(a, min(a + RUN_PAGES - 1, last), size, skip if a == first else 0, upto if a + RUN_PAGES > last else None) for a in starts]


class FeedReader(DataSourceReader):
    """The whole feed as it is now."""

    def __init__(self, options: dict, fetch: Callable[[str], str] = fetch_url):
        self.feed = Feed(options, fetch)

    def partitions(self) -> list[Pages]:
        size, first, total = self.feed.size()
        return runs(1, self.feed.last_page(size, first, total), size) or [Pages(1, 0, size)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.feed.rows(partition)


class FeedStream(DataSourceStreamReader):
    """A feed whose records are added at its end.

    An offset is the last page with records, how many it had, the digest of its
    first record and the page size. Full pages are read once. Before a page is
    continued its first record must still be the one that was read: a feed that
    has shifted is an error, not a gap.
    """

    def __init__(self, options: dict, fetch: Callable[[str], str] = fetch_url):
        self.feed, self.known = Feed(options, fetch), 1

    def initialOffset(self) -> dict:
        return {"page": 0, "rows": 0, "digest": "", "size": 0}

    def latestOffset(self) -> dict:
        size, first, total = self.feed.size()
        last = self.feed.last_page(size, first, total, self.known)
        if not last:
            return self.initialOffset()
        self.known = last
        records = first if last == 1 else self.feed.records(last, size)
        return {"page": last, "rows": len(records), "digest": digest(records[0]), "size": size}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if start["page"] and start["size"] != end["size"]:
            raise ValueError(f"the feed's pages had {start['size']} records and now have {end['size']}")
        if end["page"] < start["page"]:
            raise ValueError(f"the feed had {start['page']} pages and now has {end['page']}")
        if start == end:
            return []
        if start["page"] and digest((self.feed.records(start["page"], start["size"]) or [None])[0]) != start["digest"]:
            raise ValueError(f"page {start['page']} of the feed no longer begins with the record that was read")
        done = start["rows"] >= start["size"]
        first = start["page"] + 1 if done or not start["page"] else start["page"]
        return runs(first, end["page"], end["size"], 0 if first > start["page"] else start["rows"], end["rows"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.feed.rows(partition)


class JsonFeed(DataSource):
    """``spark.read`` or ``spark.readStream`` with ``.format("json_feed").option("url", "https://x/y?page={page}&size={size}")``."""

    @classmethod
    def name(cls) -> str:
        return "json_feed"

    def schema(self) -> str:
        return "_row bigint, cells map<string,string>"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def register_feed(spark) -> None:
    spark.dataSource.register(JsonFeed)
