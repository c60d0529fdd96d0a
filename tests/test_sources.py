import http.server
import io
import json
import pickle
import random
import threading
import urllib.parse
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from brindle.functions import udf
from brindle.operators.typing import ColumnProfile
from brindle.plans.ask import Vocabulary, describe, fast_plan, suggest
from brindle.plans.query import Filter, Query
from brindle.sources import delimited, feeds, readers, sinks


def test_delimited():
    head, rows = readers.parse_delimited('﻿Report 2024\n\nName;Price;;Price\n"A ""x""";"1;2";z;3\n;;;\nB;4\n'.lstrip("﻿"))
    assert head == ["Name", "Price", "column_3", "Price (2)"]
    assert rows == [['A "x"', "1;2", "z", "3"], ["B", "4", "", ""]]


def test_decode():
    assert readers.decode("é".encode()) == readers.decode("é".encode("cp1252")) == "é"


def test_json_forms():
    assert readers.parse_json('{"data": {"rows": [{"a": 1, "b": {"name": "x"}}, {"a": 2, "c": [1, 2]}, {"a": 3, "b": null}]}}') == (["a", "b", "c"], [["1", "x", ""], ["2", "", "1, 2"], ["3", "", ""]])
    assert readers.parse_json('{"columns": ["p", "q"], "rows": [[1, true]]}') == (["p", "q"], [["1", "yes"]])


def test_salvage():
    assert json.loads(readers.salvage_json('[{"a": 1}, {"a": 2}, {"a": ')) == [{"a": 1}, {"a": 2}]
    assert json.loads(readers.salvage_json('{"rows": [{"a": "}"}, {"b')) == {"rows": [{"a": "}"}]}
    assert readers.salvage_json("{") is None


HTML = "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2<table><tr><td>in</td></tr></table></td></tr><tr><td colspan=2>w"


def test_html_tables():
    grids = {}
    for n, _, head, cells in readers.html_tables(HTML):
        grids.setdefault(n, []).append((head, cells))
    assert [(True, ["a", "b"]), (False, ["x", "1"]), (False, ["x", "2"]), (False, ["w", ""])] in grids.values()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,v\nx,1\ny,2\n")
    (tmp_path / "b.json").write_text('[{"n": "z", "v": 3}, {"n": "q", "v": 4}]')
    df = readers.read_files(spark, str(tmp_path), ["n", "v"])
    assert sorted((r["n"], r["v"], r["_row"]) for r in df.collect()) == [("q", "4", 1), ("x", "1", 0), ("y", "2", 1), ("z", "3", 0)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "c.tsv").write_text("n\tn\nx\t007\n")
    assert [r[:] for r in readers.read_csv(spark, str(tmp_path / "t"), "\t").collect()] == [("x", "007")]


def test_workbook_round_trip(spark):
    df = spark.createDataFrame([("a & b", 1), ("<c>", 22)], "name string, n int")
    assert readers.parse_xlsx(sinks.xlsx_bytes(df)) == (["name", "n"], [["a & b", "1"], ["<c>", "22"]])
    with zipfile.ZipFile(io.BytesIO(sinks.xlsx_bytes(df))) as z:
        assert z.testzip() is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "a\tb"), ("O'Neil", None)], "x string, y string").coalesce(1)
    sinks.write_delimited(df, str(tmp_path / "c"))
    assert [r["x"] for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == ["'=1+1", "O'Neil"]
    assert "('O''Neil', NULL);" in sinks.sql_script(df, "My table").first()["line"]
    assert sinks.create_table(df, "My table", dialect="mysql") == "CREATE TABLE `my_table` (\n  `x` TEXT,\n  `y` TEXT\n);"
    assert sinks.markdown(df).splitlines()[1] == "| --- | --- |"
    sinks.write_xml(df, str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "row").load(str(tmp_path / "x")).count() == 2
    d = spark.sql("select cast(1.50 as decimal(10,2)) a, cast(7 as decimal(10,2)) b, cast(12345678901234567890 as decimal(38,0)) c")
    assert sinks.sheet_types(d, ["a", "b"]) == {"a": "NUMERIC(2, 1)", "b": "BIGINT"}
    assert json.loads(sinks.json_array(d))[0]["c"] == "12345678901234567890"


def test_feed():
    pages = {n: json.dumps({"meta": {"totalElements": 5}, "records": [{"i": k, "t": {"title": f"x{k}"}} for k in range((n - 1) * 2, min(n * 2, 5))] or []}) for n in (1, 2, 3)}
    reader = feeds.FeedReader({"url": "{page}", "pagesize": "2"}, lambda u: pages.get(int(u), "{}"))
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(1, 3)]
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[0] for r in rows[:4]] == [0, 1, 2, 3] and rows[0][1] == {"i": "0", "t": "x0"}


class Server:
    """A feed on this machine: what it holds, how it behaves past its end, and the pages it was asked for."""

    def __init__(self, rows, size=100, total=True, past="empty", cap=None, broken=()):
        self.rows, self.total, self.past, self.cap, self.broken, self.asked = rows, total, past, cap, broken, []
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
                outer.asked.append(q["page"])
                body = outer.body(q["page"], q["size"])
                self.send_response(500 if body is None else 200)
                self.end_headers()
                self.wfile.write((body or "").encode())

            def log_message(self, *args):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}/?page={{page}}&size={{size}}"

    def body(self, page, size):
        if page in self.broken:
            return None
        size = min(size, self.cap or size)
        last = max(1, -(-len(self.rows) // size))
        if page > last:
            page = {"empty": page, "last": last, "first": 1}[self.past]
        out = {"meta": {"source": [{"a": 1}]}, "data": {"items": self.rows[(page - 1) * size : page * size]}}
        return json.dumps(out | ({"total": len(self.rows)} if self.total is True else {"total": self.total} if self.total else {}))


def records_of(n, start=0):
    return [{"id": i, "name": f"n{i}", "tags": [{"label": "x"}, {"label": f"t{i}"}]} for i in range(start, start + n)]


def read_feed(server, **options):
    feed = feeds.FeedReader({"url": server.url, "pagesize": "10", **options})
    return [row for part in feed.partitions() for row in pickle.loads(pickle.dumps(feed)).read(part)]


@pytest.mark.parametrize("total", [True, None, 5000, 3])
@pytest.mark.parametrize("past", ["empty", "last", "first"])
@pytest.mark.parametrize("n", [0, 1, 10, 11, 401])
def test_feed_reads_every_record_once(total, past, n):
    server = Server(records_of(n), total=total, past=past)
    got = read_feed(server)
    assert sorted((i, c["id"]) for i, c in got) == [(i, str(i)) for i in range(n)]
    assert not got or got[0][1]["tags"] == "x, t0"
    if total is None:
        assert len(server.asked) < 20 + n / 10 * 1.6  # the last page is found by doubling, not by walking


def test_feed_falls_back_to_a_size_that_the_server_keeps():
    for total in (True, None):
        capped = Server(records_of(95), cap=20, total=total)
        assert len(read_feed(capped, pagesize="1000,20")) == 95
        own = Server(records_of(95), cap=7, total=total)
        assert sorted(int(c["id"]) for _, c in read_feed(own, pagesize="1000,100")) == list(range(95))


def test_feed_with_a_page_that_cant_be_read():
    server = Server(records_of(100), broken=(4,))
    with pytest.raises(OSError):
        read_feed(server)
    assert [int(c["id"]) for _, c in read_feed(server, lenient="true")] == list(range(30))


def test_feed_stream_agrees_with_the_batch_and_reads_no_page_twice(spark, tmp_path):
    feeds.register_feed(spark)
    server = Server(records_of(95), total=None)

    def step(name):
        stream = spark.readStream.format("json_feed").option("url", server.url).option("pagesize", "10").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r["_row"], r["cells"]["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert step("one") == [(i, str(i)) for i in range(95)]
    server.rows += records_of(57, 95)
    server.asked.clear()
    assert step("two") == [(i, str(i)) for i in range(152)]
    assert len([p for p in server.asked if 2 <= p <= 8]) <= 6  # only to find the end: the full pages are not read again
    batch = spark.read.format("json_feed").option("url", server.url).option("pagesize", "10").load()
    assert sorted((r["_row"], r["cells"]["id"]) for r in batch.collect()) == step("three")


def test_feed_stream_that_has_shifted_is_an_error():
    server = Server(records_of(25))
    stream = feeds.FeedStream({"url": server.url, "pagesize": "10"})
    start = stream.latestOffset()
    assert stream.partitions(stream.initialOffset(), start)[-1].upto == 5 and stream.partitions(start, start) == []
    server.rows = records_of(5, 900) + server.rows
    with pytest.raises(ValueError, match="no longer begins"):
        stream.partitions(start, stream.latestOffset())
    server.rows = server.rows[:3]
    with pytest.raises(ValueError, match="had 3 pages"):
        stream.partitions(start, feeds.FeedStream({"url": server.url, "pagesize": "10"}).latestOffset())


VOCABULARY = Vocabulary(
    {"brand": ColumnProfile("brand", "category", 9, 0, 3, 0, None, None, False), "price_inr": ColumnProfile("price_inr", "money", 9, 0, 9, 0, "INR", None, False), "year": ColumnProfile("year", "period", 9, 0, 3, 0, None, None, False, "year")},
    {"brand": ("Tata", "MG")},
)


@pytest.mark.parametrize(("question", "plan"), [
    ("How many rows are there?", Query("count")),
    ("average price by brand", Query("avg", "price_inr", "brand")),
    ("total price per year", Query("sum", "price_inr", "year")),
    ("What is the median price for Tata", Query("median", "price_inr", filters=(Filter("in", "brand", ("Tata",)),))),
    ("average price of unicorns by brand", None),
    ("average weight by brand", None),
])
def test_questions(question, plan):
    assert fast_plan(question, VOCABULARY) == plan


def test_describe_and_suggest():
    assert describe(Query("avg", "price", "brand", limit=3)) == "Average price, by brand, first 3"
    assert Query("avg", "price_inr", "year") in suggest(VOCABULARY.profile)


GOOD = "def answer(rows):\n    return statistics.fmean([r['v'] for r in rows])"


def test_user_function(spark):
    assert udf.call(GOOD, spark.createDataFrame([(1.0,), (3.0,)], "v double")) == 2.0


@pytest.mark.parametrize("source", [
    "import os", "def answer(rows):\n    return open('x')", "def answer(rows):\n    return rows.__class__", "def answer(rows):\n    return eval('1')", "def answer(rows):\n    return 9 ** 99",
    "def answer(rows):\n    return __import__('os')", "def other(rows):\n    return 1", "def answer(rows):\n    import os\n    return 1", "def answer(rows):\n    return math.os", "def answer(rows):\n    return getattr(rows, 'x')",
])
def test_escapes_are_refused(source):
    with pytest.raises(udf.Refused):
        udf.check(source)


# ---------------------------------------------------------------- delimited files in parallel
def messy_csv(rng, rows, sep=",", end="\n"):
    words = ["a", "", " b ", 'say ""hi""', f"x{sep}y", "line\nbreak", "\n\n", "é", '"" "', "é\r\nü", f'{sep}""{sep}\n""', "5 inch", "long " * 40]
    out = []
    for _ in range(rows):
        if rng.random() < 0.1:
            out.append(rng.choice(["", sep * 2, "alone", '"\n"']))
        out.append(sep.join(f'"{w}"' if rng.random() < 0.6 else w.replace("\n", " ").replace("\r", "").replace('"', "").replace(sep, " ") for w in (rng.choice(words) for _ in range(rng.choice([2, 3, 3, 4])))))
    return end.join(["just a title", "", *out])


@pytest.mark.parametrize("size", ["150", "1g"])
def test_delimited_in_parallel_equals_the_plain_parser(spark, tmp_path, size):
    rng = random.Random(7)
    files = {f"f{i}.csv": messy_csv(rng, 25, sep, end).encode(enc) for i, (sep, end, enc) in enumerate([(",", "\n", "utf-8"), (";", "\r\n", "cp1252"), ("\t", "\n", "utf-8-sig"), ("|", "\n", "latin-1"), (",", "\n", "utf-8")])}
    files |= {"empty.csv": b"", "title.csv": b"only a title\n\n", "open.csv": b'a,b\n1,"never closed\nreally\n', "latin.csv": b"a,b\n\x81,\xe9\n", "end.csv": b'h1,h1,\n1,"x\ny"', "inside.csv": b'a,b\n1,"' + b"q\n" * 250 + b'"\n2,z\n', "mid.csv": b'a,b\n5" pipe,x\n"q"uote "x,2\n"a""",3\n'}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in delimited.read_delimited(spark, str(tmp_path)).collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["_row"]] = r["cells"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, content in files.items():
        header, rows = readers.parse_delimited(readers.decode(content))
        assert got.get(name, {}) == {i: dict(zip(header, r, strict=True)) for i, r in enumerate(rows)}, name


def test_a_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.csv", "w") as f:
        f.write("id,text\n")
        for i in range(60_000):
            f.write(f'{i},"first line of {i}\nsecond, ""quoted"" line\n{"x" * (i % 300 + 1)}"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = delimited.read_delimited(spark, str(tmp_path / "big.csv"), ["id", "text"])
        assert df.count() == 60_000
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "big.csv"))
        assert lines.rdd.getNumPartitions() > 10
        bad = df.filter((F.col("id").cast("long") != F.col("_row")) | (F.col("text") != F.concat(F.lit("first line of "), F.col("id"), F.lit('\nsecond, "quoted" line\n'), F.repeat(F.lit("x"), (F.col("_row") % 300 + 1).cast("int")))))
        assert bad.isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_for_spreadsheets_and_nulls_in_xml(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", 2.5), (2, None, None)], "id long, `some name` string, price double").coalesce(1)
    sinks.write_delimited(df, str(tmp_path / "c"), units={"price": "INR"}, spreadsheet=True)
    (name,) = (tmp_path / "c").glob("part-*.csv")
    assert name.read_bytes() == "\ufeffid,some name,price (INR)\r\n1,'=1+1,2.5\r\n2,,\r\n".encode()
    sinks.write_xml(df, str(tmp_path / "x"))
    (name,) = (p for p in (tmp_path / "x").glob("part-*"))
    rows = list(ElementTree.fromstring(name.read_text()))
    nil = "{http://www.w3.org/2001/XMLSchema-instance}nil"
    assert [[(c.tag, c.text, c.get(nil)) for c in r] for r in rows] == [[("id", "1", None), ("some_name", "=1+1", None), ("price", "2.5", None)], [("id", "2", None), ("some_name", None, "true"), ("price", None, "true")]]
