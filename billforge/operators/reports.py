"""Reports over the ledger, the lookups and the invoice rows. Kinds and states are codes; labels are left to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_code, norm_number
from ..schema import DONE, DUPLICATE, FAILED, PENDING, SKIPPED, blank_name, nz
from . import ledger
from .dedupe import wildcard_semi
from .filenames import duplicate_files
from .reconcile import continue_sequence, prefix_lookup, priority_union
from .work import export_summary, group_counts, issue_counts

ERROR, NO_PDF_YET, LEFT_OUT = "ERROR", "LOOKUP_WITHOUT_PDF", "SKIPPED"


def blank(c) -> Column:
    return F.coalesce(c, F.lit(""))


def ledger_report(messages: DataFrame, limit: int = ledger.RETRY_LIMIT) -> DataFrame:
    """``section, label, message_id, n, exhausted``: totals by state, open messages, reasons of skipped ones."""
    none = F.lit(None).cast("string")
    totals = messages.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("status").alias("section"), F.col("status").alias("label"), none.alias("message_id"), "n", F.lit(False).alias("exhausted"))
    opened = messages.where(F.col("status").isin(FAILED, PENDING)).select(F.lit("open"), "status", "message_id", F.col("attempts").cast("long"), F.coalesce(F.col("attempts") >= limit, F.lit(False)))
    skipped = ledger.reason_breakdown(messages.where(F.col("status") == SKIPPED)).select(F.lit("skipped"), "label", none, "n", F.lit(False))
    return totals.union(opened).union(skipped)


def status_card(messages: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row: counts by state, lookups by state, open work, last change. A lookup is open if PENDING or FAILED."""
    s = F.upper(F.coalesce("pdf_status", F.lit(PENDING)))
    m = messages.agg(*[F.count_if(F.col("status") == x).alias(x.lower()) for x in (DONE, FAILED, SKIPPED, PENDING)], F.max("updated_at").alias("last_run"))
    k = lookups.agg(F.count("*").alias("lookups"), F.count_if(s == DONE).alias("lookups_done"), F.count_if(s == DUPLICATE).alias("duplicates"), F.count_if(s.isin(PENDING, FAILED)).alias("todo"))
    return m.join(F.broadcast(k), F.lit(True))


def lookup_export(lookups: DataFrame) -> DataFrame:
    """Lookups that are no duplicates, newest first, with whether both fields are there and the state of the file."""
    code, number = nz("lookup_code"), nz("invoice_no")
    done = F.col("pdf_status") == DONE
    pdf = F.when(code.isNull(), "NONE").when(done & nz("pdf_file").isNotNull(), F.col("pdf_file")).when(done, "BY_HAND").otherwise("NOT_YET")
    rows = lookups.where(F.coalesce("pdf_status", F.lit(PENDING)) != DUPLICATE)
    return rows.select("message_id", "mail_date", "sender", "subject", "invoice_no", "lookup_code", (code.isNotNull() & number.isNotNull()).alias("complete"), pdf.alias("pdf")).orderBy(F.desc(blank("mail_date")), "message_id")


def master_additions(lookups: DataFrame, master: DataFrame) -> DataFrame:
    """Done lookups not yet in the master: a blank number fits any against ``master(code, number)``, but within the batch only equal (code,
    number) repeat; the oldest stays."""
    rows = lookups.where((F.col("pdf_status") == DONE) & (nz("lookup_code").isNotNull()) & (F.coalesce("master_synced", F.lit(0)) == 0))
    rows = rows.withColumns({"code": norm_code(F.col("lookup_code")), "number": norm_number(F.col("invoice_no"))})
    known = master.select(norm_code(F.col("code")).alias("code"), norm_number(F.col("number")).alias("number"))
    fresh = wildcard_semi(rows, known, anti=True)
    first = fresh.groupBy("code", "number").agg(F.min_by("message_id", F.struct(blank("mail_date"), "message_id")).alias("message_id"))
    return fresh.join(first.select("message_id"), "message_id", "left_semi")


def missing_xml(notes: DataFrame, messages: DataFrame) -> DataFrame:
    """``notes(event_seq, email_id, kind, file, pdf, error)`` → messages without XML or with errors. The first kind stays; files are listed once.
    Kinds: ATTACHED_PDF, LINKED_PDF, NO_PDF."""
    seq = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("event_seq", F.col(c).alias("v"))))), lambda x: x["v"])
    n = notes.groupBy("email_id").agg(F.min_by(nz("kind"), F.when(nz("kind").isNotNull(), F.col("event_seq"))).alias("kind"), F.array_distinct(seq("file")).alias("files"), F.array_distinct(seq("pdf")).alias("pdfs"), seq("error").alias("errors"))
    failed = F.size("errors") > 0
    n = n.where(failed | (F.size("files") == 0)).withColumns({"status": F.when(failed, "XML_ERROR").otherwise("NO_XML"), "kind": blank("kind")})
    hint = F.when(failed, "RUN_AGAIN").when(F.startswith("kind", F.lit("LINKED_PDF")), "NOT_SENT_NOR_LINKED").when(F.col("kind") == "NO_PDF", "NEITHER_PDF_NOR_XML").otherwise("PDF_WITHOUT_XML")
    m = messages.select(F.col("message_id").alias("email_id"), "supplier", "mail_date", "subject")
    out = n.join(m, "email_id", "left").select(
        "status", "kind", blank("supplier").alias("supplier"), blank("mail_date").alias("mail_date"), blank("subject").alias("subject"), F.array_join("pdfs", ", ").alias("pdf"),
        F.substring(F.array_join("errors", " | "), 1, 500).alias("error"), F.array_join("files", ", ").alias("saved"), hint.alias("hint"), "email_id",
    )
    kind = F.when(F.col("kind") == "ATTACHED_PDF", 0).when(F.col("kind") == "NO_PDF", 2).otherwise(1)
    return out.orderBy(F.when(F.col("status") == "XML_ERROR", 0).otherwise(1), kind, "mail_date", "email_id")


def issues(run: DataFrame, messages: DataFrame, lookups: DataFrame, hints: list[tuple[str, str]], default: str = "") -> DataFrame:
    """Issues of a run, and lookups without a file that are not among them, by severity, supplier and date."""
    known = lookups.where(F.coalesce("pdf_status", F.lit(PENDING)) != DUPLICATE)
    m = messages.select("message_id", "supplier", "mail_date", "subject")
    k = known.select("message_id", "invoice_no", "lookup_code")
    own = run.join(m, "message_id", "left").join(k, "message_id", "left").select(
        F.when(F.col("status") == FAILED, ERROR).when(F.col("status") == SKIPPED, LEFT_OUT).otherwise(F.col("status")).alias("kind"), blank("supplier").alias("supplier"), blank("mail_date").alias("mail_date"), blank("subject").alias("subject"),
        blank("invoice_no").alias("invoice_no"), blank("lookup_code").alias("lookup_code"), F.substring(blank("reason"), 1, 500).alias("reason"), ledger.reason_hint(F.col("reason"), hints, default).alias("hint"), "message_id",
    )
    state = F.coalesce(nz("pdf_status"), F.lit(PENDING))
    rest = known.where((blank("lookup_code") != "") & (state != DONE)).join(run.select("message_id"), "message_id", "left_anti")
    why = F.when(state == PENDING, "NOT_DOWNLOADED").when(F.coalesce("pdf_not_found", F.lit(0)) >= ledger.NOT_FOUND_LIMIT, "NOT_FOUND_GIVEN_UP").otherwise("DOWNLOAD_FAILED")
    rest = rest.select(
        F.lit(NO_PDF_YET), F.lit("lookup"), F.coalesce(nz("header_date"), nz("mail_date"), F.lit("")), blank("subject"), blank("invoice_no"), "lookup_code", why, F.lit("LOOK_UP_BY_CODE"), "message_id"
    )
    rank = F.when(F.col("kind") == ERROR, 0).when(F.col("kind") == NO_PDF_YET, 1).when(F.col("kind") == LEFT_OUT, 2).otherwise(9)
    return own.union(rest).orderBy(rank, "supplier", "mail_date", "message_id")


def consolidated(sources: list[tuple[str, DataFrame]], order: list[str], id_col: str, units: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """The consolidated result: rows of named groups in order of priority, each invoice once, with ``group``."""
    rows = priority_union([d.withColumn("group", F.lit(name)) for name, d in sources], order, id_col, units, present)
    return rows.orderBy("source_rank", *order)


def consolidated_counts(rows: DataFrame) -> DataFrame:
    """Rows by class of group."""
    return group_counts(rows)


def issue_sheets(rows: DataFrame) -> dict[str, DataFrame]:
    """The sheets of an issue workbook: the issues, and their counts by kind."""
    return {"issues": rows, "kinds": issue_counts(rows)}


def export_sheets(lookups: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a lookup workbook: numbered rows, and a block of counts."""
    rows = lookup_export(lookups)
    numbered = continue_sequence(rows.withColumn("_date", blank("mail_date")), 0, [("_date", "desc"), "message_id"]).drop("_date")
    return {"lookups": numbered, "summary": export_summary(lookups)}


def layout_split(files: DataFrame, rows: DataFrame, present: DataFrame, epoch=None) -> DataFrame:
    """``files(stem, mtime)`` with ``target``: XML (an XML row has this file), DUPLICATE (its name repeats one that has) or NO_XML. Files older than
    the layout's epoch are left out."""
    if epoch is not None:
        files = files.where(F.col("mtime") >= epoch)
    own = rows.select(F.col("file_stem").alias("stem"), F.lit(True).alias("_own")).distinct()
    d = duplicate_files(files.select("stem"), rows, present)
    out = files.join(own, "stem", "left").join(d, "stem", "left")
    return out.withColumn("target", F.when(F.col("_own"), "XML").when(F.col("dup_of").isNotNull(), DUPLICATE).otherwise("NO_XML")).withColumn("dup_of", F.when(~F.coalesce("_own", F.lit(False)), F.col("dup_of"))).drop("_own")


def tax_id_fixes(rows: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """``rows(file, name, tax_id)`` with ``new_tax_id`` and ``why`` where the tax id is none of ``known(tax_id)``: by the beginning of the name, or, for a
    blank name, by the one known id in the file's name. Where both are found and differ, nothing is corrected."""
    k = known.select(F.col("tax_id").alias("_t")).distinct()
    cur = F.substring(F.regexp_replace(blank("tax_id"), "[^0-9]", ""), 1, 10)
    todo = rows.withColumn("_cur", cur).join(k, F.col("_cur") == F.col("_t"), "left_anti")
    todo = prefix_lookup(todo.withColumnRenamed("tax_id", "_old"), names).withColumnRenamed("tax_id", "_by_name")
    tokens = F.array_distinct(F.regexp_extract_all("file", F.lit(r"(?<!\d)(\d{10})(?!\d)"), F.lit(1)))
    hit = todo.select("file", F.explode(tokens).alias("_t")).distinct().join(k, "_t").groupBy("file").agg(F.count("*").alias("_c"), F.min("_t").alias("_t"))
    todo = todo.join(hit.where("_c = 1").select("file", F.col("_t").alias("_by_file")), "file", "left")
    conflict = F.col("_by_name") != F.col("_by_file")
    new = F.when(F.coalesce(conflict, F.lit(False)), F.lit(None)).otherwise(F.coalesce("_by_name", F.when(blank_name(F.col("name")), F.col("_by_file"))))
    out = todo.withColumn("new_tax_id", new).where("new_tax_id is not null")
    return out.select("file", "name", F.col("_old").alias("tax_id"), "new_tax_id", F.concat_ws(",", F.when(F.col("_by_name").isNotNull(), "BY_NAME").otherwise("BY_FILE"), F.when(F.col("_cur") != "", "REPLACED").otherwise("WAS_BLANK")).alias("why"))
