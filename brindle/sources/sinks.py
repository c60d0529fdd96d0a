"""Writers: one projection that makes cells safe and typed, then Spark's own sinks; small tables as text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import guarded


def slug(name: str) -> str:
    """snake_case identifier of a header."""
    out = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "column"
    return f"c_{out}" if out[0].isdigit() else out


def unique_slugs(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in map(slug, names):
        k, base = 2, name
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def sheet_types(df: DataFrame, numeric: list[str]) -> dict[str, str]:
    """Exact SQL types of decimal columns: BIGINT for whole numbers of up to 18 digits, else NUMERIC(p, s)."""
    sizes = df.agg(*[F.max(F.char_length(F.regexp_extract(F.abs(F.col(c)).cast("string"), r"^(\d+)", 1))).alias(f"i{k}") for k, c in enumerate(numeric)],
                   *[F.max(F.char_length(F.regexp_replace(F.regexp_extract(F.col(c).cast("string"), r"\.(\d+)$", 1), "0+$", ""))).alias(f"s{k}") for k, c in enumerate(numeric)]).first()
    out = {}
    for k, c in enumerate(numeric):
        whole, scale = sizes[f"i{k}"] or 1, sizes[f"s{k}"] or 0
        out[c] = "BIGINT" if not scale and whole <= 18 else f"NUMERIC({min(38, whole + scale)}, {scale})"
    return out


def write_delimited(df: DataFrame, path: str, sep: str = ",", units: dict[str, str] | None = None, spreadsheet: bool = False) -> None:
    """CSV or TSV, a file for each partition; text cells that a spreadsheet would run get a quote mark, tabs and breaks in TSV become spaces.

    ``units`` stand in the header behind their columns. For a ``spreadsheet``
    each file begins with a byte order mark and lines end with CR LF.
    """
    strings = [c for c, t in df.dtypes if t == "string"]
    clean = {c: guarded(F.col(f"`{c}`")) for c in strings}
    if sep == "\t":
        clean = {c: F.regexp_replace(v, r"[\t\r\n]+", " ") for c, v in clean.items()}
    names = [f"{c} ({units[c]})" if units and c in units else c for c in df.columns]
    if spreadsheet:
        names[0] = "\ufeff" + names[0]
    df.withColumns(clean).toDF(*names).write.csv(path, sep=sep, header=True, escape='"', lineSep="\r\n" if spreadsheet else "\n")


def json_array(df: DataFrame) -> str:
    """A small table as one JSON array; numbers of more than 15 digits stay text."""
    exact = {c for c, t in df.dtypes if t.startswith("decimal")}
    digits = lambda c: F.char_length(F.regexp_replace(F.col(c).cast("string"), r"\D", ""))
    long = {c for c in exact if df.filter(digits(c) > 15).limit(1).count()}
    rows = df.select(*[F.col(c).cast("string").alias(c) if c in long else F.col(c) for c in df.columns])
    return rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)))).first()[0] or "[]"


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    df.write.json(path, ignoreNullFields=False)


def small(df: DataFrame, most: int) -> list:
    """All rows of a table that a writer holds whole; a larger one is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: this format is for small tables")
    return rows


def markdown(df: DataFrame, most: int = 5000) -> str:
    """A small table as Markdown, numbers to the right."""
    right = [t.startswith(("decimal", "int", "bigint", "double")) for _, t in df.dtypes]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "|".join(" ---: " if r else " --- " for r in right) + "|"]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in small(df, most)])


#: Types of four SQL dialects by Spark type, and their marks round names (fixed values).
DIALECTS = {
    "postgres": ({"string": "TEXT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "date": "DATE", "boolean": "BOOLEAN", "decimal": "NUMERIC"}, '"', '"'),
    "mysql": ({"string": "TEXT", "bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "decimal": "DECIMAL"}, "`", "`"),
    "sqlite": ({"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "date": "TEXT", "boolean": "INTEGER", "decimal": "NUMERIC"}, '"', '"'),
    "sqlserver": ({"string": "NVARCHAR(MAX)", "bigint": "BIGINT", "int": "INT", "double": "FLOAT", "date": "DATE", "boolean": "BIT", "decimal": "DECIMAL"}, "[", "]"),
}


def sql_script(df: DataFrame, table: str, batch: int = 500, dialect: str = "postgres") -> DataFrame:
    """Lines of INSERT statements of ``batch`` rows, made by the tasks that hold the rows."""
    _, left, right = DIALECTS[dialect]
    names = ", ".join(f"{left}{n}{right}" for n in unique_slugs(df.columns))
    head = f"INSERT INTO {left}{slug(table)}{right} ({names}) VALUES"
    bare = dialect in ("sqlite", "sqlserver")

    def literal(v) -> str:
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(int(v)) if bare else str(v).upper()
        if isinstance(v, (str, date)):
            return ("N" if dialect == "sqlserver" and isinstance(v, str) else "") + "'" + str(v).replace("'", "''") + "'"
        return str(v)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = ["(" + ", ".join(map(literal, r)) + ")" for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"line": [f"{head}\n{',\n'.join(rows[i : i + batch])};" for i in range(0, len(rows), batch)]})

    return df.mapInPandas(run, "line string")


def create_table(df: DataFrame, table: str, types: dict[str, str] | None = None, dialect: str = "postgres") -> str:
    """The table's definition; ``types`` (see ``sheet_types``) gives exact types where they are known."""
    kinds, left, right = DIALECTS[dialect]
    types = types or {}
    named = lambda t: kinds["decimal"] + t.removeprefix("decimal") if t.startswith("decimal") else kinds.get(t, kinds["string"])
    lines = [f"  {left}{s}{right} {types.get(c) or named(t)}" for s, (c, t) in zip(unique_slugs(df.columns), df.dtypes, strict=True)]
    return f"CREATE TABLE {left}{slug(table)}{right} (\n" + ",\n".join(lines) + "\n);"


def write_xml(df: DataFrame, path: str) -> None:
    """Spark's XML sink; element names are made valid first, and a null cell is an empty element with xsi:nil."""
    cell = lambda c: F.struct(F.col(f"`{c}`").cast("string").alias("_VALUE"), F.when(F.col(f"`{c}`").isNull(), F.lit("true")).alias("_xsi:nil"))
    rows = df.select(*[cell(c).alias(s) for c, s in zip(df.columns, unique_slugs(df.columns), strict=True)])
    rows.write.format("xml").options(rootTag='rows xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"', rowTag="row", validateName="false").save(path)  # the names are valid; the check takes the prefix of xsi:nil for none


def xlsx_bytes(df: DataFrame, most: int = 50_000, about: dict[str, str] | None = None) -> bytes:
    """A small table as a workbook, numbers as numbers, with a second sheet "About" where ``about`` has lines."""
    def ref(c: int, r: int) -> str:
        letters = ""
        c += 1
        while c:
            c, k = divmod(c - 1, 26)
            letters = chr(65 + k) + letters
        return f"{letters}{r}"

    def cell(c: int, r: int, v) -> str:
        if v is None:
            return ""
        if isinstance(v, str) or isinstance(v, bool):
            return f'<c r="{ref(c, r)}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f'<c r="{ref(c, r)}"><v>{v}</v></c>' if not hasattr(v, "isoformat") else f'<c r="{ref(c, r)}" t="inlineStr"><is><t>{v.isoformat()}</t></is></c>'

    def sheet(rows: list[list]) -> str:
        body = "".join(f'<row r="{i}">' + "".join(cell(c, i, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        return f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>"

    rows = [df.columns, *[list(r) for r in small(df, most)]]
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    more = ('<sheet name="About" sheetId="2" r:id="r2"/>', f'<Relationship Id="r2" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/>') if about else ("", "")
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/>{more[0]}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>{more[1]}</Relationships>',
        "xl/worksheets/sheet1.xml": sheet(rows),
    }
    if about:
        parts["xl/worksheets/sheet2.xml"] = sheet([[k, v] for k, v in about.items()])
        parts["[Content_Types].xml"] = parts["[Content_Types].xml"].replace("</Types>", '<Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return out.getvalue()
