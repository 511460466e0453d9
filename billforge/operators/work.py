"""Small operators around a run: search queries, profiles, file plans, counts and exports."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_key, message_link
from ..schema import DONE, DUPLICATE, PENDING, nz
from .dedupe import numbered_names
from .numbering import number_rows

#: Fixed value: the order of CSV columns.
CSV_COLUMNS = ("updated_at", "status", "supplier", "mail_date", "subject", "reason", "attempts", "saved_count", "files", "link", "message_id")


# ---- sources
def search_query(source: str, extra: str = "", since: str | None = None, until: str | None = None) -> str | None:
    """A mail search: none for a label; days are whole, both included, and in UTC."""
    if source == "label":
        return None
    at = lambda day, more: int((datetime.fromisoformat(day).replace(tzinfo=UTC) + timedelta(days=more)).timestamp())
    parts = ["in:inbox" if source == "inbox" else "-in:sent -in:drafts", extra, f"after:{at(since, 0)}" if since else "", f"before:{at(until, 1)}" if until else ""]
    return " ".join(p for p in parts if p)


def label_id(labels: DataFrame, name: str) -> DataFrame:
    """The id of the first label of that name, case aside: ``labels(id, name, ord)``."""
    return labels.where(F.lower("name") == name.lower()).agg(F.min_by("id", "ord").alias("id"))


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file's settings; no row if it is absent or broken."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def profiles(defaults: DataFrame, config: DataFrame, ui: DataFrame) -> DataFrame:
    """Profiles by id, case aside: the first spelling stays; of each attribute the last filled one of the three sources wins."""
    every = None
    for rank, (d, flag) in enumerate(((defaults, "builtin"), (config, "in_config"), (ui.where(F.col("id").rlike("^[A-Za-z0-9_-]+$")), "custom"))):
        d = d.withColumns({"_rank": F.lit(rank), flag: F.lit(True)})
        every = d if every is None else every.unionByName(d, allowMissingColumns=True)
    flags = ("builtin", "in_config", "custom")
    rest = [c for c in every.columns if c not in ("id", "_rank", *flags)]
    last = lambda c: F.max_by(nz(c), F.when(nz(c).isNotNull(), F.col("_rank")))
    return every.groupBy(F.lower("id").alias("_key")).agg(F.min_by("id", "_rank").alias("id"), *[F.coalesce(F.max(f), F.lit(False)).alias(f) for f in flags], *[F.coalesce(last(c), F.lit("")).alias(c) for c in rest]).drop("_key")


def settle(*levels: dict) -> dict:
    """Settings by precedence, the first level that has a value wins: command line, profile, defaults."""
    return {k: next((x[k] for x in levels if x.get(k) not in (None, "")), None) for x in levels for k in x}


def unread(files: DataFrame, folders: tuple[str, ...], stems: DataFrame | None = None) -> DataFrame:
    """Page files outside of ``folders`` that were read already (lower case), and without those whose stem is known."""
    out = files.where(~F.lower(F.element_at(F.split("folder", "/"), -1)).isin(*folders))
    return out if stems is None else out.join(stems.select("stem").distinct(), "stem", "left_anti")


def source_images(images: DataFrame) -> DataFrame:
    """``images(folder, name)`` with ``page_no``: the place of its name in its folder; page N of a file is the N-th image of its folder."""
    return images.withColumn("page_no", F.row_number().over(Window.partitionBy("folder").orderBy("name")))


def same_columns(wanted: list[str], rows: DataFrame) -> list[str]:
    """The wanted columns that a table has, in the wanted order."""
    return [c for c in wanted if c in rows.columns]


def distinct_ids(ids) -> Column:
    """An array's ids once each, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))


def filled_stems(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("file_stem").alias("stem")).where("stem <> ''").distinct()


# ---- files
def move_plan(files: DataFrame, present: DataFrame, order: str = "sha1") -> DataFrame:
    """``files(stem, suffix, sha1, target)`` moved to folders that hold ``present(folder, stem, suffix, sha1)``, with ``action`` and ``name``.

    The holder of a name is the file that has it in the folder, else the first one of the batch. Others with the holder's content are
    dropped; those of another content get ``stem_k``, the least free number from 2 on, against the folder and the whole batch."""
    whole = F.concat_ws(".", F.col("stem"), nz("suffix")).alias("_name")
    there = present.select(F.col("folder").alias("_t"), whole, "sha1").groupBy("_t", "_name").agg(F.min("sha1").alias("_there"))
    asked = number_rows(files.select("*", whole), list(dict.fromkeys([order, "sha1"])), by=["target", "_name"], out="_k")
    first = asked.where("_k = 1").select(F.col("target").alias("_t"), "_name", F.col("sha1").alias("_first"))
    j = asked.withColumn("_t", F.col("target")).join(there, ["_t", "_name"], "left").join(first, ["_t", "_name"])
    j = j.withColumn("action", F.when(F.col("_there").isNull() & (F.col("_k") == 1), "move").when(F.col("sha1") == F.coalesce("_there", "_first"), "drop").otherwise("rename"))
    taken = there.select(F.col("_t").alias("target"), "_name").union(first.select(F.col("_t").alias("target"), "_name"))
    kept = j.where("action <> 'rename'").select(*files.columns, "action", F.col("_name").alias("name"))
    named = numbered_names(j.where("action = 'rename'").select(*files.columns, "_name", "_k"), "target", "_name", "_k", taken, 2)
    return kept.union(named.select(*files.columns, F.lit("move").alias("action"), F.col("unique_name").alias("name")))


def xml_saves(files: DataFrame) -> DataFrame:
    """``files(folder, name, id, content)``: one row for each different content of a folder and name, with ``unique_name``; the first id stays."""
    f = files.withColumn("sha1", F.sha1("content"))
    first = f.groupBy("folder", "name", "sha1").agg(F.min("id").alias("id"))
    return numbered_names(f.join(first, ["folder", "name", "sha1", "id"], "left_semi"))


def stored_rows(rows: DataFrame) -> DataFrame:
    """Rows of an XML store: those with an invoice number."""
    return rows.where(nz("invoice_no").isNotNull())


# ---- counts
def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


def xml_presence(notes: DataFrame) -> DataFrame:
    """One row: messages with an XML file, with none, and with an error."""
    m = notes.groupBy("email_id").agg(F.count("file").alias("files"), F.count("error").alias("errors"))
    return m.agg(F.count_if(F.col("files") > 0).alias("ok"), F.count_if((F.col("files") == 0) & (F.col("errors") == 0)).alias("none"), F.count_if(F.col("errors") > 0).alias("error"))


def folder_stats(files: DataFrame, results: DataFrame) -> DataFrame:
    """``files(folder, suffix, mtime)`` and ``results(folder, mtime)``: PDFs and XML files by folder, and the PDFs newer than its last result."""
    last = results.groupBy("folder").agg(F.max("mtime").alias("_last"))
    pdf = F.lower("suffix") == "pdf"
    newer = pdf & (F.col("_last").isNull() | (F.col("mtime") > F.col("_last")))
    return files.join(last, "folder", "left").groupBy("folder").agg(F.count_if(pdf).alias("pdf"), F.count_if(F.lower("suffix") == "xml").alias("xml"), F.count_if(newer).alias("new_pdf"), F.max("_last").alias("last_result"))


def group_class(c) -> Column:
    """Class of a consolidated row by the beginning of its group's name."""
    low, plain = F.lower(F.coalesce(c, F.lit(""))), ascii_key(c)
    return F.when(low.startswith("petro"), "petro").when(plain.startswith("khong") | low.startswith("không"), "no_xml").otherwise("other")


def group_counts(rows: DataFrame, group: str = "group") -> DataFrame:
    return rows.groupBy(group_class(F.col(group)).alias("class")).agg(F.count("*").alias("n"))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row: rows, those with a series, by issuer, and those that failed."""
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(nz("series").isNotNull()).alias("with_series"), F.count_if(F.col("issuer") == "petrolimex").alias("petrolimex"), F.count_if(F.col("issuer") == "standard").alias("standard"),
        F.count_if(F.col("provenance").isin("empty", "error")).alias("errors"),
    )


def export_summary(lookups: DataFrame) -> DataFrame:
    """One row: lookups that are no duplicates, complete ones, those that lack a field, fetched ones, and the duplicates left out."""
    state = F.coalesce("pdf_status", F.lit(PENDING))
    own, full = state != DUPLICATE, nz("lookup_code").isNotNull() & nz("invoice_no").isNotNull()
    return lookups.agg(
        F.count_if(own).alias("total"), F.count_if(own & full).alias("complete"), F.count_if(own & ~full).alias("missing"), F.count_if(own & (state == DONE)).alias("fetched"), F.count_if(~own).alias("duplicates")
    )


def line_total(lines: DataFrame, key: str, amount: str, kind: str | None = None) -> DataFrame:
    """The sum of an invoice's goods lines (of no kind or kind 1), null where it is zero."""
    own = F.coalesce(F.col(kind).cast("string"), F.lit("")).isin("", "1") if kind else F.lit(True)
    total = F.coalesce(F.sum(F.when(own, F.col(amount))), F.lit(0))
    return lines.groupBy(key).agg(F.nullif(total.cast("bigint"), F.lit(0).cast("bigint")).alias("total"))


def joined_texts(rows: DataFrame, key: str, order: str, text: str, separator: str = " | ") -> DataFrame:
    """Texts of a key in order, blanks too, as one."""
    a = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("_t")))).alias("_a"))
    return a.select(key, F.array_join(F.transform("_a", lambda x: x["_t"]), separator).alias("texts"))


def nested(rows: DataFrame, detail: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """``rows`` with the one detail of its key as a struct; null for none."""
    return rows.join(detail.select(key, F.struct(*fields).alias(name)), key, "left")


def ledger_csv(messages: DataFrame) -> DataFrame:
    """The ledger's rows as they go into a CSV file, newest first: text only, files joined, a link to the message."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = messages.orderBy(F.desc("updated_at"), "message_id")
    made = {"files": F.array_join(F.coalesce("files", F.array().cast("array<string>")), "; ").alias("files"), "link": message_link(F.col("message_id")).alias("link")}
    return rows.select(*[made[c] if c in made else text(c) for c in CSV_COLUMNS])
