"""Workbooks, read and written with the standard library. A workbook is one file of at most MAX_ROWS rows a sheet, so it is a report's
format, not a table's; a sink that would pass the limit raises."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_accents
from .files import bounded

MAX_ROWS, HEADER_ROWS = 1_048_576, 15
_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of every sheet, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(n.tag) == "si"]
        links = {n.get("Id"): n.get("Target", "") for n in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"):
            target = next((links[v] for k, v in sheet.attrib.items() if _local(k) == "id" and v in links), "")
            part = target.lstrip("/") if target.startswith("/") else "xl/" + target
            if part not in names:
                continue
            with z.open(part) as f:
                for _, row in ElementTree.iterparse(f):
                    if _local(row.tag) != "row":
                        continue
                    cells: list[str | None] = []
                    for c in row:
                        at = _column(c.get("r", "")) if c.get("r") else len(cells)
                        value = next((v.text for v in c if _local(v.tag) == "v"), None)
                        if c.get("t") == "s" and value is not None:
                            value = shared[int(value)]
                        elif c.get("t") == "inlineStr":
                            value = _texts(c)
                        cells += [None] * (at - len(cells) + 1)
                        cells[at] = value
                    yield sheet.get("name", ""), int(row.get("r", "0")), cells
                    row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every workbook under a path, as of ``workbook_rows``."""
    return workbook_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path))


def workbook_rows(files: DataFrame) -> DataFrame:
    """``files(path, content)`` → ``path, sheet, row_no, cells``; a file that can't be read gives one row with row_no -1."""

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for row in sheet_rows(content):
                yield path, *row
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
            yield path, "", -1, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (r for b in batches for path, content in zip(b["path"], b["content"]) for r in rows_of(path, content))
        for out in bounded(every, lambda r: sum(len(c or "") for c in r[3] or ())):
            yield pd.DataFrame(out, columns=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row_no int, cells array<string>")


def header_key(c) -> Column:
    return F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "")


def table_of(rows: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Sheets as rows of named columns. The header is the first of HEADER_ROWS rows that has all required columns under any of their
    names, whatever their accents, case and order; sheets without one are left out, as are rows whose cells are all blank."""
    keys = F.transform("cells", lambda c: header_key(F.coalesce(c, F.lit(""))))
    at = {n: F.array_compact(F.array(*[F.nullif(F.array_position("k", header), F.lit(0).cast("bigint")) for header in [re.sub("[^a-z0-9]+", "", _fold(a)) for a in names]])) for n, names in aliases.items()}
    head = rows.where(F.col("row_no").between(1, HEADER_ROWS)).withColumn("k", keys)
    head = head.select("path", "sheet", "row_no", *[F.get(a, F.lit(0)).cast("int").alias("_" + n) for n, a in at.items()])
    for r in required:
        head = head.where(F.col("_" + r).isNotNull())
    head = head.groupBy("path", "sheet").agg(F.min_by(F.struct(*["_" + n for n in aliases]), "row_no").alias("h"), F.min("row_no").alias("_head"))
    body = rows.join(head, ["path", "sheet"]).where((F.col("row_no") > F.col("_head")) & F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return body.select("path", "sheet", "row_no", *[F.when(F.col(f"h._{n}").isNotNull(), F.get("cells", F.col(f"h._{n}") - 1)).alias(n) for n in aliases])


def _fold(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s.lower().replace("đ", "d")) if not unicodedata.combining(c))


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _part(kind: str) -> str:
    return f"application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"


def workbook_bytes(sheets: dict[str, Iterator[tuple]]) -> tuple[bytes, list[int]]:
    """A workbook of sheets by name, each given as rows with the header first; and each sheet's rows without it."""
    ns, root = "http://schemas.openxmlformats.org/", '<?xml version="1.0"?>'
    office = f"{ns}officeDocument/2006/relationships"
    numbers = range(1, len(sheets) + 1)
    rel = lambda i, kind, target: f'<Relationship Id="r{i}" Type="{office}/{kind}" Target="{target}"/>'
    rels = lambda inner: f'{root}<Relationships xmlns="{ns}package/2006/relationships">{inner}</Relationships>'
    name = lambda s: escape(re.sub(r"[\[\]:*?/\\]", " ", s)[:31], {'"': "&quot;"})
    over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_part("worksheet")}"/>' for i in numbers)
    buf, counts = io.BytesIO(), []
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{root}<Types xmlns="{ns}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_part("sheet.main")}"/>{over}</Types>')
        z.writestr("_rels/.rels", rels(rel(1, "officeDocument", "xl/workbook.xml")))
        listed = "".join(f'<sheet name="{name(s)}" sheetId="{i}" r:id="r{i}"/>' for i, s in zip(numbers, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'{root}<workbook xmlns="{ns}spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels("".join(rel(i, "worksheet", f"worksheets/sheet{i}.xml") for i in numbers)))
        for i, rows in zip(numbers, sheets.values(), strict=True):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                counts.append(_write_sheet(rows, f, ns))
    return buf.getvalue(), counts


def _write_sheet(rows: Iterator[tuple], f, ns: str) -> int:
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>'

    f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{ns}spreadsheetml/2006/main"><sheetData>'.encode())
    n = 0
    for n, row in enumerate(rows, 1):
        if n > MAX_ROWS:
            raise ValueError(f"a sheet holds {MAX_ROWS} rows; write a table instead")
        f.write((f'<row r="{n}">' + "".join(map(cell, row)) + "</row>").encode())
    f.write(b"</sheetData></worksheet>")
    return n - 1


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c.name, "; ").alias(c.name) if c.dataType.typeName() == "array" else F.col(f"`{c.name}`") for c in df.schema])


def write_workbook(df: DataFrame, path: str, sheet: str = "Sheet1", more: dict[str, DataFrame] | None = None) -> int:
    """A sheet with a header, and ``more`` sheets by name; rows come to the driver a partition at a time. Returns the first sheet's rows.
    Of many workbooks none needs to: see ``pack_workbooks``."""
    sheets = {n: _flat(d) for n, d in {sheet: df, **(more or {})}.items()}
    data, counts = workbook_bytes({n: itertools.chain([tuple(d.columns)], d.toLocalIterator()) for n, d in sheets.items()})
    _write_bytes(df.sparkSession, path, data)
    return counts[0]


def pack_workbooks(df: DataFrame, key: str, order: list[str], sheet: str = "Sheet1") -> DataFrame:
    """``key, n, content``: a workbook for each key, with its other columns in order; each is made by a task, where its rows are. A sheet's rows are bounded, so
    a key of more gets several sheets."""
    flat = _flat(df)
    names = [c for c in flat.columns if c != key]
    kind = df.schema[key].dataType.simpleString()
    held = flat.select(key, *[F.col(f"`{c}`") for c in names]).repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), *[F.col(f"`{c}`").asc_nulls_last() for c in order])

    def packed(k, rows: list[tuple]) -> tuple:
        parts = [rows[i : i + MAX_ROWS - 1] for i in range(0, len(rows), MAX_ROWS - 1)]
        data, counts = workbook_bytes({sheet if not i else f"{sheet} {i + 1}": itertools.chain([tuple(names)], p) for i, p in enumerate(parts)})
        return k, sum(counts), data

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.null(), pa.int64(), pa.binary()]

        def rows() -> Iterator[tuple]:
            for b in batches:
                types[0] = b.column(0).type
                yield from zip(b.column(0).to_pylist(), *[_plain_values(c) for c in b.columns[1:]], strict=True)

        every = (packed(k, [r[1:] for r in own]) for k, own in itertools.groupby(rows(), lambda r: r[0]))
        for out in bounded(every, lambda x: len(x[2])):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "n", "content"])

    return held.mapInArrow(pack, f"key {kind}, n long, content binary").withColumnRenamed("key", key)


def _plain_values(c: pa.Array) -> list:
    """Python values; no number as null, times as their time zone's clock shows them."""
    values = c.to_pylist()
    if pa.types.is_floating(c.type):
        return [None if v is None or v != v else v for v in values]
    return [v and v.replace(tzinfo=None) for v in values] if pa.types.is_timestamp(c.type) else values


def write_ledger_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a byte-order mark before each header; lists are joined by '; '. Nothing comes to the driver."""
    cols = [F.array_join(c.name, "; ") if c.dataType.typeName() == "array" else F.col(c.name) for c in df.schema]
    df.select(*[c.alias("\ufeff" * (i == 0) + n) for i, (c, n) in enumerate(zip(cols, df.columns))]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_bytes(rows: list[tuple], header: list[str]) -> bytes:
    """A small report as one CSV file with a byte-order mark."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerows([header, *rows])
    return b"\xef\xbb\xbf" + out.getvalue().encode()
