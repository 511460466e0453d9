"""One object over the tables of a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import page_fields
from .functions.text import norm_code, norm_number
from .operators import dedupe, ledger, lookups, reconcile, reports, work, xmlrows
from .schema import DONE, DUPLICATE, LOOKUPS, MESSAGES, PENDING, nz
from .sources import commits, files, messages, workbook
from .streaming.ledger import EVENTS
from .tables import written

MAX_IMPORT = 2000
#: Fixed value: the form of a lookup code.
CODE = "^[A-Z0-9]{5,24}$"


class Engine:
    """``root`` holds a commit log of ``events`` and ``lookup_events`` (``sources.commits``) and, read only, tables of these names and ``lookups`` that
    were there before; absent tables are empty. All changes are appended events, several processes may make them, and every
    state can be folded again: from the last snapshot and what came after it."""

    TABLES = ("events", "lookup_events")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = commits.CommitLog(spark, self.root)

    def view(self) -> commits.View:
        return self.log.head(self.TABLES)

    def events(self, view: commits.View | None = None, after: int = 0) -> DataFrame:
        return (view or self.view()).table("events", EVENTS, after)

    def lookup_events(self, view: commits.View | None = None, after: int = 0) -> DataFrame:
        return (view or self.view()).table("lookup_events", lookups.EVENTS, after)

    def messages(self, view: commits.View | None = None) -> DataFrame:
        """Current messages; files that lookups fetched are theirs."""
        v = view or self.view()
        new = self.events(v, v.upto).unionByName(lookups.file_events(self.lookup_events(v, v.upto)))
        return ledger.fold_events(new, v.state("messages", MESSAGES), v.upto)

    def lookups(self, view: commits.View | None = None) -> DataFrame:
        """Current lookups; messages that are to be done again fetch theirs again."""
        v = view or self.view()
        new = self.lookup_events(v, v.upto).unionByName(lookups.rearm_events(self.events(v, v.upto)))
        folded = lookups.fold_lookups(new, v.state("lookups", LOOKUPS), v.upto)
        if not self.log.exists("lookups"):
            return folded
        known = self.spark.read.schema(LOOKUPS).parquet(f"{self.root}/lookups")
        return folded.unionByName(known.join(folded.select("message_id"), "message_id", "left_anti"))

    def compact(self) -> int:
        """Keeps both states as they are now; the number of the last event in them."""
        return self.log.keep_snapshot(lambda v: {"messages": self.messages(v), "lookups": lookups.fold_lookups(self.lookup_events(v, v.upto).unionByName(lookups.rearm_events(self.events(v, v.upto))), v.state("lookups", LOOKUPS), v.upto)}, self.TABLES)

    # ---- changes
    def _append(self, build, ts: str) -> int:
        """One commit of what ``build`` makes from a view, as (table, rows) without number or time; the count."""
        kinds = {"events": EVENTS, "lookup_events": lookups.EVENTS}

        def timed(view):
            out = []
            for name, rows in build(view):
                rows = rows.withColumns({"event_seq": F.lit(0).cast("bigint"), "ts": F.lit(ts)})
                out.append((name, rows.select(*[F.col(n).cast(t) for n, t in (c.split() for c in kinds[name].split(", "))])))
            return out

        return self.log.append(timed, self.TABLES)

    def mark(self, ids: list[str], status: str, ts: str) -> int:
        """Messages marked by hand as DONE or PENDING."""
        if status not in (DONE, PENDING):
            raise ValueError("a mark is DONE or PENDING")
        rows = self.spark.createDataFrame([(i,) for i in ids], "message_id string")
        return self._append(lambda _: [("events", self._message_rows(rows, "mark", F.lit(status)))], ts)

    def seed(self, ids: list[str], reason: str, ts: str) -> int:
        """Ids that the ledger lacks, added as DONE; how many."""
        rows = self.spark.createDataFrame([(i,) for i in ids], "message_id string")
        return self._append(lambda v: [("events", ledger.seed_events(rows, self.messages(v), reason, 0, ts))], ts)

    def record(self, outcomes: DataFrame, ts: str) -> int:
        """Outcomes of a run: ``message_id, status`` and any of ``subject, mail_date, supplier, reason, files``."""
        have = [c for c in ("subject", "mail_date", "supplier", "reason", "files") if c in outcomes.columns]
        blank = self._message_rows(outcomes, "record", F.col("status"), keep=tuple(have))
        return self._append(lambda _: [("events", blank)], ts)

    def _message_rows(self, rows: DataFrame, kind: str, status, keep: tuple[str, ...] = ()) -> DataFrame:
        kinds = {"subject": "string", "mail_date": "string", "supplier": "string", "reason": "string", "files": "array<string>"}
        return rows.select("message_id", F.lit(kind).alias("kind"), status.alias("status"), *[(F.col(c) if c in keep else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def _lookup_rows(self, rows: DataFrame, kind: str) -> DataFrame:
        return lookups.lookup_events(rows.withColumns({"event_seq": F.lit(0).cast("bigint"), "ts": F.lit("")}), kind)

    def mark_downloaded(self, keys: list[str] | None, ts: str) -> int:
        """Pending lookups, of these ids or codes, fetched by hand."""
        k = self.spark.createDataFrame([(x,) for x in keys], "key string") if keys else None
        return self._append(lambda v: [("lookup_events", self._lookup_rows(lookups.downloaded_by_hand(self.lookups(v), k), "downloaded"))], ts)

    def mark_synced(self, ids: DataFrame, ts: str) -> int:
        return self._append(lambda _: [("lookup_events", self._lookup_rows(ids.select("message_id"), "synced"))], ts)

    def reset_not_found(self, ids: list[str], ts: str) -> int:
        rows = self.spark.createDataFrame([(i,) for i in ids], "message_id string")
        return self._append(lambda _: [("lookup_events", self._lookup_rows(rows, "reset"))], ts)

    def save_lookups(self, rows: DataFrame, ts: str) -> int:
        """``message_id, mail_date, header_date, sender, subject, invoice_no, lookup_code`` as they were read."""
        return self._append(lambda _: [("lookup_events", self._lookup_rows(rows, "upsert"))], ts)

    def dedupe(self, ts: str, master: DataFrame | None = None) -> DataFrame:
        """Marks duplicate lookups and frees former ones, in one commit with what it means for their messages; one row: duplicates in all, and new ones."""
        held = {}

        def build(v):
            # read twice, as events of both tables: the marks are written first
            m = held["m"] = written(lookups.mark_duplicates(self.lookups(v), master), "marks")
            changed = m.where("change is not null")
            marks = self._lookup_rows(changed.where("change <> 'freed'").select("message_id", "dup_of"), "duplicate").unionByName(self._lookup_rows(changed.where("change = 'freed'").select("message_id"), "original"))
            notes = changed.where("note is not null").select("message_id", F.col("note").alias("reason"))
            return [("events", self._message_rows(notes, "note", F.lit(None), keep=("reason",))), ("lookup_events", marks)]

        self._append(build, ts)
        counts = lookups.duplicate_counts(held["m"]).first()
        return self.spark.createDataFrame([tuple(counts)], "total long, new long")

    # ---- files and reports
    def verify(self, folder: str) -> DataFrame:
        """Done messages and the files that the folder lacks."""
        return lookups.verify(self.messages(), files.inventory(self.spark, folder).select("name"))

    def merge_xml(self, results: DataFrame, path: str) -> DataFrame:
        """Result rows with the invoices of XML files below a path merged in."""
        new = self.invoices(path)
        fields = tuple(c for c in new.columns if c in results.columns)
        # rows are told apart by number through several steps: numbered once, in a written table
        old, new = (written(d.withColumn("_row", F.monotonically_increasing_id()), "rows") for d in (results, new))
        return reconcile.merge_xml(old, new, "_row", fields)

    def consolidated(self, sources: list[tuple[str, DataFrame]], order: list[str], id_col: str, units: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
        """Rows of named groups in order of priority, each invoice once."""
        return reports.consolidated(sources, order, id_col, units, present)

    def issues(self, first: int, last: int, hints: list[tuple[str, str]], default: str = "") -> DataFrame:
        """Issues of the run whose events are numbered from ``first`` to ``last``, and lookups without a file."""
        v = self.view()
        run = self.events(v).where(F.col("event_seq").between(first, last) & (F.col("kind") == "record"))
        return reports.issues(ledger.run_issues(run), self.messages(v), self.lookups(v), hints, default)

    def missing_xml(self, notes: DataFrame) -> DataFrame:
        return reports.missing_xml(notes, self.messages())

    def layout_split(self, folder: str, rows: DataFrame, epoch=None) -> DataFrame:
        """PDF files of a folder, and where they belong: with an XML row, a duplicate by name, or without."""
        f = files.inventory(self.spark, folder).where("suffix = 'pdf'").select("stem", "mtime")
        return reports.layout_split(f, rows, f.select("stem"), epoch)

    def migrate(self, other: Engine, ts: str) -> int:
        """Hand-typed lookups of another ledger that this one lacks, taken over; how many. The other's are left as they are."""
        return self._append(lambda v: [("lookup_events", self._lookup_rows(lookups.migrate(other.lookups(), self.lookups(v))[0], "upsert"))], ts)

    def master_additions(self, master: DataFrame) -> DataFrame:
        return reports.master_additions(self.lookups(), master)

    def append_master(self, master: DataFrame, ts: str) -> DataFrame:
        """Rows to append to a master of ``row_no, seq, code, number``, numbered behind its last; they count as synced from now on."""
        new = written(reconcile.append_master(master, self.master_additions(master).select("message_id", "mail_date", "code", "number"), ["mail_date", "message_id"]), "master")
        self.mark_synced(new, ts)
        return new

    def pages(self, texts: DataFrame) -> DataFrame:
        """Invoice rows of ``texts(file, page_no, text, doc_kind)``."""
        return page_fields.extract_rows(texts)

    def unsynced(self) -> DataFrame:
        return lookups.unsynced(self.lookups())

    def csv_rows(self) -> DataFrame:
        return work.ledger_csv(self.messages())

    def lookup_invoices(self, duplicates: bool = False) -> DataFrame:
        rows = self.lookups()
        rows = rows if duplicates else rows.where(F.coalesce("pdf_status", F.lit(PENDING)) != DUPLICATE)
        return rows.orderBy(F.desc(F.coalesce("mail_date", F.lit(""))), "message_id")

    def ledger(self, limit: int = 5000, status: str | None = None) -> DataFrame:
        """The newest messages, each with its lookup as a struct."""
        k = self.lookups().select("message_id", F.struct("invoice_no", "lookup_code", "pdf_status", "pdf_file").alias("lookup"))
        return ledger.latest(ledger.latest(self.messages(), limit, status).join(k, "message_id", "left"), limit)

    def status(self) -> DataFrame:
        return reports.status_card(self.messages(), self.lookups())

    def report(self) -> DataFrame:
        return reports.ledger_report(self.messages())

    def pending(self) -> DataFrame:
        return ledger.pending(self.lookups())

    def lookup_export(self) -> DataFrame:
        return reports.lookup_export(self.lookups())

    def scan(self, path: str, supported: list[str], keywords: list[str]) -> DataFrame:
        return messages.scan(messages.read_messages(self.spark, path), supported, keywords)

    def invoices(self, path: str) -> DataFrame:
        """Invoice rows of the XML files, also of those in ZIP files, below a path."""
        f = files.expand_zips(files.inventory(self.spark, path, content=True).where(F.col("suffix").isin("xml", "zip")).select("path", "content"), ("xml",))
        f = f.where(files.looks_like_xml("content")).select(F.coalesce(nz("member"), F.col("path")).alias("path"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "").alias("content"))
        return xmlrows.parse_invoices(f)

    def retry_items(self, path: str) -> DataFrame:
        """Rows of an issue workbook that have a web link and a message id."""
        names = {"message_id": ["email_id", "message_id"], "url": ["url", "link"], "supplier": ["supplier"], "subject": ["subject"]}
        rows = workbook.table_of(workbook.read_workbooks(self.spark, path), names, ["message_id", "url"])
        return rows.where(F.rlike("url", F.lit("^https?://")) & F.rlike("message_id", F.lit("^[A-Za-z0-9_-]+$")))

    def import_codes(self, codes: list[tuple[str, str]], view: commits.View | None = None) -> DataFrame:
        """(code, number) typed by hand, at most MAX_IMPORT, with ``state``: invalid; existed, where the ledger or an earlier one of the list has the
        code with a number that fits; or added."""
        if len(codes) > MAX_IMPORT:
            raise ValueError(f"at most {MAX_IMPORT} codes at once")
        typed = self.spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(codes)], "place int, code string, number string")
        blank = lambda c: F.coalesce(c, F.lit(""))
        new = typed.select("place", F.rtrim(F.upper(F.regexp_replace(blank(F.col("code")), r"\s", "")), F.lit("*")).alias("code"), F.regexp_replace(blank(F.col("number")), "[^0-9]", "").alias("typed"))
        new = new.withColumn("number", F.regexp_replace("typed", "^0+", ""))
        valid = new.where(F.rlike("code", F.lit(CODE)))
        old = self.lookups(view).select(norm_code(F.col("lookup_code")).alias("code"), norm_number(F.col("invoice_no")).alias("number"))
        known = dedupe.wildcard_semi(valid, old).select("place", F.lit("existed").alias("state"))
        fresh = dedupe.fold_dedupe(dedupe.wildcard_semi(valid, old, anti=True), ["code"], ["number"], [], "place")
        states = known.union(fresh.select("place", F.when(F.col("dup_of").isNull(), "added").otherwise("existed")))
        return new.join(states, "place", "left").select("place", "code", "number", "typed", F.coalesce("state", F.lit("invalid")).alias("state")).orderBy("place")

    def add_codes(self, codes: list[tuple[str, str]], ts: str, source: str = "list") -> int:
        """Adds the codes that ``import_codes`` would add as lookups; how many."""
        # a commit that follows from what the ledger holds: it is built again if someone else adds codes meanwhile
        return self._append(lambda v: [("lookup_events", self._code_rows(self.import_codes(codes, v), ts, source))], ts)

    def _code_rows(self, typed: DataFrame, ts: str, source: str) -> DataFrame:
        added = typed.where("state = 'added'")
        name = F.concat(F.lit(lookups.MANUAL_PREFIX), "code", F.when(F.col("number") != "", F.concat(F.lit("-"), "number")).otherwise(""))
        rows = added.select(
            F.lit(0).cast("bigint").alias("event_seq"), F.lit(ts).alias("ts"), name.alias("message_id"), F.lit(ts).alias("mail_date"), F.lit("").alias("header_date"), F.lit("BY_HAND").alias("sender"),
            F.substring(F.lit(f"FROM {source}"), 1, 200).alias("subject"), F.col("typed").alias("invoice_no"), F.concat("code", F.lit("*")).alias("lookup_code"),
        )
        return lookups.lookup_events(rows, "upsert")
