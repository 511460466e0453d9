"""Landed files: inventories, ZIP members, XML attachments. All reads go through Spark, so any store that it reads will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of what a Python worker hands on at a time.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
PAGE_SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def inventory(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """``path, folder, name, stem, suffix, length, mtime`` of every file below a folder; bytes are read only if asked for."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = f.select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("mtime"), *(["content"] if content else []),
    )
    return out


def page_inputs(files: DataFrame, root: str) -> DataFrame:
    """Page files with an ``alias``: a subfolder's files are ``folder_pN`` where it has more than one, else the folder's name."""
    pages = files.where(F.col("suffix").isin(*PAGE_SUFFIXES))
    w = Window.partitionBy("folder")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(F.lower("name"), "name"))
    base = F.element_at(F.split("folder", "/"), -1)
    nested = ~F.endswith("folder", F.lit("/" + root.rstrip("/").split("/")[-1]))
    return pages.withColumn("alias", F.when(nested & (n > 1), F.concat(base, F.lit("_p"), k.cast("string"))).when(nested, base).otherwise(F.col("stem")))


def is_zip(content) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 2)) == "504B", F.lit(False))


def looks_like_xml(content) -> Column:
    """Starts, after a mark and white space, as XML and not as a web page, and holds a tag of an invoice."""
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"^(?:ï»¿)?\s+|^ï»¿", ""))
    page = F.contains(F.substring(head, 1, 800), F.lit("<html")) | F.contains(F.substring(head, 1, 800), F.lit("<!doctype html"))
    known = F.decode(content, "ISO-8859-1").rlike("<HDon|<TDiep|DLHDon|<Invoice|<inv:")
    return F.coalesce(F.startswith(head, F.lit("<")) & ~page & known, F.lit(False))


def bounded(rows: Iterator, size: Callable) -> Iterator[list]:
    """Rows in lists of at most BATCH_ROWS, each closed by the row that brings it to BATCH_BYTES."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if len(held) >= BATCH_ROWS or total >= BATCH_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def expand_zips(files: DataFrame, suffixes: tuple[str, ...] = ("pdf", "xml")) -> DataFrame:
    """``files(path, content)`` → ``path, member, content``: members of ZIP files (told by their first bytes) with a wanted suffix; other files
    are passed on with a null member. A broken archive gives one row with null content. One archive is opened at a time."""
    wanted = tuple("." + s for s in suffixes)

    def members(path: str, content: bytes) -> Iterator[tuple[str, str, bytes | None]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in z.infolist():
                    if not m.is_dir() and m.filename.lower().endswith(wanted):
                        yield path, m.filename, z.read(m)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError):
            yield path, "", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (m for b in batches for path, content in zip(b["path"], b["content"]) for m in members(path, content))
        for out in bounded(every, lambda m: len(m[2] or b"")):
            yield pd.DataFrame(out, columns=["path", "member", "content"])

    schema = "path string, member string, content binary"
    plain = files.where(~is_zip("content")).select("path", F.lit(None).cast("string").alias("member"), "content")
    return files.where(is_zip("content")).select("path", "content").mapInPandas(run, schema).unionByName(plain)


def xml_attachments(messages: DataFrame) -> DataFrame:
    """Attachments that are XML or ZIP by name or type; those named or typed as PDF are not."""
    a = messages.select("id", F.explode("attachments").alias("a")).select("id", "a.*")
    name, mime = F.lower(F.coalesce("filename", F.lit(""))), F.lower(F.coalesce("mime", F.lit("")))
    return a.where((F.rlike(name, F.lit(r"\.(xml|zip)$")) | F.rlike(mime, F.lit("xml|zip"))) & ~(F.endswith(name, F.lit(".pdf")) | F.contains(mime, F.lit("pdf"))))


def latest_report(files: DataFrame, profile: str, prefix: str = "issues") -> DataFrame:
    """The newest report file of a profile."""
    hit = files.where(F.lower("name").startswith(f"{prefix}_{profile}_".lower()) & (F.col("suffix") == "xlsx"))
    return hit.agg(F.max_by("path", F.struct("mtime", "name")).alias("path"))


def page_texts(files: DataFrame, read: Callable[[bytes], list[str]]) -> DataFrame:
    """``files(path, content)`` → ``file, page_no, text``: pages as ``read`` gives them for a file's bytes, such as a PDF library's texts or the
    output of a recogniser. A file that it can't read gives one row without text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts = read(content) or [None]
                except Exception:  # noqa: BLE001 - a reader of foreign files may fail in any way, and one file must not end the job
                    texts = [None]
                yield pd.DataFrame({"file": path, "page_no": range(1, len(texts) + 1), "text": pd.Series(texts, dtype=object)})

    return files.select("path", "content").mapInPandas(run, "file string, page_no int, text string")
