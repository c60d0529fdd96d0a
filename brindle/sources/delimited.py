"""Large delimited files in parallel, with line breaks inside quotes.

Spark splits a file at line breaks and hands each split's lines to a task in
order. Whether a line begins inside a quoted cell depends on all before it, but
each split can say what it does to either start: a function of {outside,
inside}. Folding those functions along a file gives every split its true start
(a prefix sum over functions, on one small row a split). Then all splits parse
at once; only records that cross a split's edge are put together afterwards.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources.readers import sniff, unique_headers
from brindle.tables import written

#: Delimiters that are told apart.
DELIMITERS = ",;\t|"
#: Bytes of a file's head from which its delimiter is told.
HEAD_BYTES = 20_000
#: Splits whose starts are sent to every task; beyond, lines are joined with them by key and put in order again.
SENT_SPLITS = 500_000
#: Bytes of records parsed at once.
CHUNK = 1 << 22
BOM = b"\xef\xbb\xbf"

csv.field_size_limit(1 << 31 - 1)


def after_line(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether the line after ``line`` begins inside quotes. A quote opens a cell only as its first character."""
    at = 0
    if not inside:
        if line[:1] != b'"':
            at = line.find(delimiter + b'"')
            if at < 0:
                return False
            at += 1
        at += 1
    while True:
        close = line.find(b'"', at)
        if close < 0:
            return True
        if line[close + 1 : close + 2] == b'"':
            at = close + 2
            continue
        opens = line.find(delimiter + b'"', close + 1)
        if opens < 0:
            return False
        at = opens + 2


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """(key columns, lines) of consecutive rows of one split, batch by batch; the line is the last column."""
    for batch in batches:
        start = batch.column(1).to_numpy()
        paths = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *[i for i in range(1, len(start)) if start[i] != start[i - 1] or paths[i] != paths[i - 1]], len(start)] if len(start) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield tuple(batch.column(k)[a].as_py() for k in range(keys)), batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to either start, for each delimiter; whether its bytes are UTF-8 and Windows-1252; a file's head."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.bool_())), ("utf8", pa.bool_()), ("cp1252", pa.bool_()), ("head", pa.binary())])
    now, ends, fits, head = None, [], [], []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": now[0], "block": now[1], "ends": ends, "utf8": fits[0], "cp1252": fits[1], "head": b"\n".join(head)[:HEAD_BYTES] if now[1] == 0 else None}], schema)

    for key, lines in _runs(batches, 2):
        if key != now:
            if now:
                yield told()
            now, ends, fits, head = key, [inside for _ in DELIMITERS for inside in (False, True)], [True, True], []
        for line in lines:
            if b'"' in line:
                ends = [after_line(line, inside, DELIMITERS[i // 2].encode()) for i, inside in enumerate(ends)]
            if not line.isascii():
                for i, name in enumerate(("utf-8", "cp1252")):
                    if fits[i]:
                        try:
                            line.decode(name)
                        except UnicodeDecodeError:
                            fits[i] = False
        if key[1] == 0 and sum(map(len, head)) < HEAD_BYTES:
            head += lines[:HEAD_BYTES]
    if now:
        yield told()


STARTS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("sep", pa.string()), ("encoding", pa.string())])


def _starts(delimiter: str | None):
    """Folds the splits of each file in order: whether a split begins inside quotes, the file's delimiter and encoding."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, inside, sep = None, False, ","
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                name = "utf-8" if r["utf8_all"] else "cp1252" if r["cp1252_all"] else "latin-1"
                if r["path"] != path:
                    path, inside = r["path"], False
                    sep = delimiter or sniff((r["head"] or b"").removeprefix(BOM).decode(name, "replace"))
                rows.append({"path": path, "block": r["block"], "inside": inside, "sep": sep, "encoding": name})
                inside = r["ends"][2 * DELIMITERS.index(sep) + inside]
            yield pa.RecordBatch.from_pylist(rows, STARTS)

    return fold


PARSED = "path string, block long, n long, part string, cells array<string>, text binary, sep string, encoding string"
_PARSED = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("part", pa.string()), ("cells", pa.list_(pa.string())), ("text", pa.binary()), ("sep", pa.string()), ("encoding", pa.string())])


def _cells(text: bytes, sep: str, encoding: str) -> list[list[str]]:
    """The filled records of whole records' text, cells stripped."""
    rows = csv.reader(io.StringIO(text.decode(encoding)), delimiter=sep)
    return [r for r in ([c.strip() for c in row] for row in rows) if any(r)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, and what its edges cut: ``head`` (the end of a record that began before; ``more`` if it goes on) and ``tail`` (a record's beginning)."""
    now, state, n, held, size, first = None, False, 0, [], 0, False

    def row(part: str, text: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": now[0], "block": now[1], "n": n, "part": part, "cells": None, "text": text, "sep": now[3], "encoding": now[4]}], _PARSED)

    def records(text: bytes) -> pa.RecordBatch:
        nonlocal n
        rows = [{"path": now[0], "block": now[1], "n": n + i, "part": "row", "cells": c, "text": None, "sep": now[3], "encoding": now[4]} for i, c in enumerate(_cells(text, now[3], now[4]))]
        n += len(rows)
        return pa.RecordBatch.from_pylist(rows, _PARSED)

    def ended() -> Iterator[pa.RecordBatch]:
        if first:
            yield row("more", b"\n".join(held))
        elif held and whole < len(held):
            yield records(b"\n".join(held[:whole]))
            yield row("tail", b"\n".join(held[whole:]))
        elif held:
            yield records(b"\n".join(held))

    whole = 0  # of the held lines, those that end with a record's end
    for key, lines in _runs(batches, 5):
        if key != now:
            if now:
                yield from ended()
            now, state, n, held, size, whole = key, key[2], 0, [], 0, 0
            first = state
            if key[1] == 0 and lines:
                lines[0] = lines[0].removeprefix(BOM)
        sep = now[3].encode()
        for line in lines:
            held.append(line)
            size += len(line)
            if b'"' in line:
                state = after_line(line, state, sep)
            if state:
                continue
            whole = len(held)
            if first:
                yield row("head", b"\n".join(held))
                held, size, whole, first = [], 0, 0, False
            elif size > CHUNK:
                yield records(b"\n".join(held))
                held, size, whole = [], 0, 0
    if now:
        yield from ended()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that cross edges, from their pieces in order; each belongs to the split where it begins."""
    owner, pieces = None, []

    def record() -> pa.RecordBatch:
        cells = _cells(b"\n".join(pieces), owner["sep"], owner["encoding"])
        return pa.RecordBatch.from_pylist([{**owner, "n": owner["n"] + i, "part": "row", "cells": c, "text": None} for i, c in enumerate(cells)], _PARSED)

    for batch in batches:
        for r in batch.to_pylist():
            if owner and r["path"] != owner["path"]:
                yield record()
                owner, pieces = None, []
            if r["part"] == "tail":
                owner, pieces = r, [r["text"]]
            else:
                pieces.append(r["text"])
                if r["part"] == "head" and owner:
                    yield record()
                    owner, pieces = None, []
    if owner:
        yield record()


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str | None = None) -> DataFrame:
    """Delimited files of any size as text: path, _row, and a map of cells (or the named columns).

    Rows, cells, delimiter, encoding and header are those of ``parse_delimited``
    over each whole file, but every file is read by as many tasks as it has
    splits. A file without a row of two filled cells has no header and no rows.
    A record must fit a task; the parsed rows are kept in the shared folder
    while headers and row numbers are found. Rows that cross two splits pass
    through one task a file, without the others.
    """
    if delimiter is not None and delimiter not in DELIMITERS:
        raise ValueError(f"the delimiter must be one of {DELIMITERS!r}")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    splits = written(lines.mapInArrow(_splits, "path string, block long, ends array<boolean>, utf8 boolean, cp1252 boolean, head binary"))
    files = splits.groupBy("path").agg(F.min("utf8").alias("utf8_all"), F.min("cp1252").alias("cp1252_all"))
    starts = splits.join(files, "path").repartition("path").sortWithinPartitions("path", "block").mapInArrow(_starts(delimiter), "path string, block long, inside boolean, sep string, encoding string")
    starts = written(starts)
    if splits.count() <= SENT_SPLITS:
        placed = lines.join(F.broadcast(starts), ["path", "block"])
    else:
        placed = lines.withColumn("_at", F.monotonically_increasing_id()).join(starts.hint("merge"), ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "_at")
    parsed = written(placed.select("path", "block", "inside", "sep", "encoding", "line").mapInArrow(_parse, PARSED))
    pieces = parsed.filter("part <> 'row'").withColumn("_o", F.when(F.col("part") == "tail", 1).otherwise(0))
    crossing = written(pieces.repartition("path").sortWithinPartitions("path", "block", "_o").drop("_o").mapInArrow(_joined, PARSED))
    rows = parsed.filter("part = 'row'").union(crossing).select("path", "block", "n", "cells")
    counts = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("path", "block", (F.sum("c").over(Window.partitionBy("path").orderBy("block")) - F.col("c")).alias("before"))
    numbered = rows.join(F.broadcast(before) if splits.count() <= SENT_SPLITS else before, ["path", "block"]).select("path", (F.col("before") + F.col("n")).alias("at"), "cells")
    filled = F.size(F.filter("cells", lambda c: c != ""))
    heads = numbered.groupBy("path").agg(F.min(F.when(filled >= 2, F.struct("at", "cells"))).alias("head")).filter("head is not null").select("path", F.col("head.at").alias("h"), F.col("head.cells").alias("header"))
    heads = written(heads)
    below = numbered.join(heads, "path").filter("at > h")
    widths = below.groupBy("path").agg(F.max(F.size("cells")).alias("w"))
    names = F.udf(lambda header, w: unique_headers(header + [""] * ((w or 0) - len(header))), "array<string>")  # once a file
    named = written(heads.join(widths, "path", "left").select("path", "h", names("header", "w").alias("names")))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.size("names") - F.size("cells"), F.lit(0))))
    table = numbered.join(named, "path").filter("at > h").select("path", (F.col("at") - F.col("h") - 1).alias("_row"), F.map_from_arrays("names", padded).alias("cells"))
    return table if columns is None else table.select("path", "_row", *[F.col("cells")[c].alias(c) for c in columns])
