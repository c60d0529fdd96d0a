"""WARC archives: write, normalise, index and read back.

Spark's text writer makes whole-file gzip streams of records. The normaliser
inflates each such stream once, in a task's own pass over its lines, frames
records by their Content-Length, and rewrites every record as a gzip member of
its own; the place of each member goes to a sidecar index beside the archives.
Records are then read from the index alone, each by its offset, so one archive
can be read by many tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import let, looked_up_or_null, materialize, only, text_of, without

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: The date that records carry: a parameter, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
#: Index rows that one reading task gets at most.
READ_ROWS = 20_000
END = "\r\n"


# ---------------------------------------------------------------- what each record is
def record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type and refers_to of every row.

    Payloads are equal by SHA-256. Of equal ones of at least ``least_bytes``
    bytes the row with the smallest page_id is the response (null after all
    others; of equal ids the smallest url, null last; of equal rows one), the
    others are revisits that name its page_id. A null html is empty. Texts are
    shuffled only where a payload repeats and the list of such payloads is
    longer than what is broadcast, or where whole rows repeat.
    """
    # A null id or url comes after the others: ranks stand before the values.
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("page_id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    rows = pages.select("page_id", "url", text_of("html").alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    keys = ["digest", "page_id", "url"]
    named = materialize(rows.filter(F.octet_length("payload") >= least_bytes).groupBy(*keys).agg(F.count(F.lit(1)).alias("times")))
    equal = materialize(named.groupBy("digest").agg(F.min(order).alias("top"), F.sum("times").alias("n")).filter("n > 1").select("digest", "top", F.lit(True).alias("again")))
    repeated = materialize(named.filter("times > 1").select(*keys))
    top_row = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))

    def typed(df: DataFrame, copy: Column) -> DataFrame:
        later = F.coalesce("again", F.lit(False)) & ~(top_row & (copy == 1))
        return df.select(
            "page_id", "url", "payload", F.lower(F.hex("digest")).alias("payload_digest"), F.when(later, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
            F.when(later, F.col("top.page_id")).alias("refers_to"),
        )

    once = looked_up_or_null(rows, equal, ["digest"])
    if repeated.isEmpty():
        return typed(once, F.lit(1))
    many = only(rows, repeated, keys).groupBy(*keys).agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("times"))
    many = looked_up_or_null(many, equal, ["digest"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return typed(without(once, repeated, keys), F.lit(1)).union(typed(many, F.col("copy")))


# ---------------------------------------------------------------- writing
def _urn(*of: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in of]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _clean(url: Column) -> Column:
    """A url that can stand in a header: white space and control characters are percent-encoded."""
    encoded = url
    for code in [*range(0x21), 0x7F]:
        encoded = F.replace(encoded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), encoded).otherwise(url)


def records(typed: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """(value): the text of one WARC record for each row of ``record_types``, without the blank lines that end it.

    A response's block is an HTTP head and the payload; a revisit's is the head
    alone, its headers name the record it refers to. Ids of pages stand in two
    headers of their own; null ones have none.
    """
    size = F.octet_length("payload").cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    salt = F.when(revisit | (F.octet_length("payload") < least_bytes), F.concat_ws("/", F.uuid(), F.col("url"))).otherwise(F.lit(""))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    def whole(block: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"), salt)), line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.when(F.col("url") != "", _clean(F.col("url")))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("Brindle-Page-Id", F.col("page_id").cast("string")),
            F.when(revisit, F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("payload_digest"), F.lit(""))),
                line("Brindle-Refers-To-Page", F.col("refers_to").cast("string")), line("Brindle-Payload-Length", size),
            )).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block,
        )

    return typed.select(let(block, whole).alias("value"))


def write_streams(found: DataFrame, path: str) -> None:
    """Writes records as whole-file gzip streams, one for each task, by Spark's own committed writer."""
    found.write.option("compression", "gzip").option("lineSep", END + END).text(path)


# ---------------------------------------------------------------- the normaliser
INDEX = "archive string, start long, length long, record_type string, record_id string, payload_digest string"


def _framed(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, record without the blank lines after it) of the lines of whole streams, in order. A stream that ends inside a record is an error."""
    stream, head, block, left = None, [], [], None
    for name, line in lines:
        if name != stream:
            if head:
                break
            stream = name
        if left is not None:
            data = line + b"\n"
            block.append(data[:left])
            left = max(0, left - len(data))
        elif text := line.removesuffix(b"\r"):
            head.append(text)
            continue
        elif not head:
            continue  # blank lines between records
        else:
            if not head[0].startswith(b"WARC/"):
                raise ValueError(f"{stream} has no WARC record where one should begin")
            headers = {k.strip().lower(): v.strip() for k, _, v in (h.decode("utf-8", "replace").partition(":") for h in head[1:])}
            left = int(headers["content-length"])
        if left == 0:
            yield headers, b"\r\n".join([*head, b"", b"".join(block)])
            head, block, left = [], [], None
    if head:
        raise ValueError(f"{stream} ends inside a record")


def normalise(spark: SparkSession, streams: str, archives: str) -> DataFrame:
    """Rewrites every whole-file gzip stream below ``streams`` with one member a record; returns the sidecar index.

    ``archives`` is a folder that all executors share, under any scheme that
    Arrow's file systems know. A task writes archives of a name of its own
    attempt; only those that the index names count, so a task that is lost or
    run twice leaves nothing in the result. A record must fit a task, a stream
    need not. The index is a table in ``archives``/index.parquet.
    """
    found = spark.read.option("lineSep", "\n").text(streams).select(F.col("_metadata.file_path").alias("stream"), F.col("value").cast("binary").alias("line"))
    FileSystem.from_uri(archives)[0].create_dir(FileSystem.from_uri(archives)[1], recursive=True)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = FileSystem.from_uri(archives)
        archive, out, rows = f"{uuid.uuid4().hex}.warc.gz", None, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3], strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

        for headers, record in _framed(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            out = out or fs.open_output_stream(posixpath.join(folder, archive), compression=None)
            member = gzip.compress(record + b"\r\n\r\n", 6, mtime=0)
            rows.append((archive, out.tell(), len(member), headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-payload-digest")))
            out.write(member)
            if len(rows) == 5000:
                yield told()
                rows = []
        if out:
            out.close()
        yield told()

    found.mapInArrow(rewrite, INDEX).write.parquet(index := f"{archives}/index.parquet")
    return spark.read.parquet(index)


# ---------------------------------------------------------------- reading
RECORDS = "record_type string, record_id string, refers_to_id string, page_id string, refers_to string, uri string, payload binary, payload_bytes long, payload_digest string"


def _number(text: bytes) -> int:
    m = re.search(rb"(?im)^content-length:\s*(\d+)", text)
    return int(m[1]) if m else 0


def read_records(index: DataFrame, archives: str, payloads: bool = True) -> DataFrame:
    """Every indexed record, each inflated from its own offset: RECORDS. Payloads are read and checked, and left out if not asked for.

    A response's digest and size are those of the payload as read, and must
    be those its header and its HTTP head state; a revisit has no payload, its
    digest and size are those of the record it refers to.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = FileSystem.from_uri(archives)
        name, file = None, None
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[f.split()[1]]) for f in RECORDS.split(", ")])
        for batch in batches:
            rows, held = [], 0
            for archive, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    name, file = archive, fs.open_input_file(posixpath.join(folder, archive))
                record = zlib.decompress(file.read_at(length, start), wbits=31)
                ((headers, whole),) = _framed(("", line) for line in record.split(b"\n")[:-1])
                block = whole[whole.index(b"\r\n\r\n") + 4 :]
                at = block.index(b"\r\n\r\n") + 4
                payload, size, digest = block[at:], _number(block[:at]), headers["warc-payload-digest"].removeprefix("sha256:")
                if headers["warc-type"] == "revisit":
                    payload, size = None, int(headers["brindle-payload-length"])
                elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{archive} at {start}: the payload is not the one its headers state")
                rows.append((headers["warc-type"], headers["warc-record-id"], headers.get("warc-refers-to"), headers.get("brindle-page-id"), headers.get("brindle-refers-to-page"), headers.get("warc-target-uri"), payload if payloads else None, size, digest))
                held += len(record)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spark = index.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // READ_ROWS))
    return index.select("archive", "start", "length").repartitionByRange(tasks, "archive", "start").sortWithinPartitions("archive", "start").mapInArrow(read, RECORDS)


# ---------------------------------------------------------------- the whole way
def archive(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as normalised archives in ``folder`` and returns their index. The whole-file streams are removed when it stands."""
    spark, streams = pages.sparkSession, f"{folder}/streams-{uuid.uuid4().hex}"
    write_streams(records(record_types(pages, least_bytes), least_bytes, date), streams)
    index = normalise(spark, streams, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(streams)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return index


def round_trip(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and uri of every row, as read back from its record.

    Null html is an empty payload, a null page_id comes back null, an empty
    table makes an archive without records, repeated rows are records of their
    own, other columns are not read.
    """
    kind = pages.schema["page_id"].dataType
    found = read_records(archive(pages, folder, least_bytes), folder, payloads=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "uri")
