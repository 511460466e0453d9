"""The message ledger: an append-only event table folded into its current state.

Events: ``event_seq, ts, message_id, kind, status, subject, mail_date, supplier, reason, files``; kinds are record,
mark, seed, file and note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DONE, DUPLICATE, FAILED, NO_CODE, PENDING, SKIPPED, nz
from .numbering import running

RETRY_LIMIT, READ_ERROR_LIMIT, NOT_FOUND_LIMIT = 3, 10, 3
MARKED_DONE, MARKED_PENDING, STATE = "MANUAL_DONE", "MANUAL_PENDING", "state"


def state_events(messages: DataFrame, upto: int = 0) -> DataFrame:
    """Messages of a snapshot as events that come before all later ones."""
    known = messages.select(
        F.lit(upto).cast("bigint").alias("event_seq"), F.col("updated_at").alias("ts"), "message_id", F.lit(STATE).alias("kind"), "status", "subject", "mail_date", "supplier", "reason", "files",
        F.col("attempts").cast("bigint").alias("_n"), F.col("first_seen").alias("_first"),
    )
    return known


def fold_events(events: DataFrame, snapshot: DataFrame | None = None, upto: int = 0) -> DataFrame:
    """Current messages: attempts count records, first_seen stays, blank new fields keep the old, null files keep files and count,
    status and reason are always replaced; a mark sets its own reason, one to PENDING resets the attempts; a seed never changes a known
    message. A file event replaces the files, a note the reason, of a known message, and nothing else.

    With a ``snapshot``, the messages that all events up to ``upto`` make, ``events`` are the later ones only. A field is what the last
    event that sets it says: an aggregate that is merged from parts, so no message's events are gathered. Attempts are the sum of
    all records less the sum before the last reset, both running sums (``numbering.running``)."""
    cols = ["event_seq", "ts", "message_id", "kind", "status", *[nz(c).alias(c) for c in ("subject", "mail_date", "supplier")], "reason", "files"]
    e = events.select(*cols, (F.col("kind") == "record").cast("bigint").alias("_n"), F.col("ts").alias("_first"))
    if snapshot is not None:
        e = e.unionByName(state_events(snapshot, upto))
    kind, seq = F.col("kind"), F.col("event_seq")
    reset = (kind == "mark") & (F.col("status") == PENDING)
    e = running(e, ["message_id"], "event_seq", sums={"_before": F.col("_n")})
    known, seed = kind.isin("record", "mark", STATE), kind == "seed"
    why = F.when(kind == "mark", F.when(F.col("status") == DONE, MARKED_DONE).otherwise(MARKED_PENDING)).otherwise(F.col("reason"))
    end = lambda x, of: F.max_by(x, F.when(of, seq))
    filled = lambda c: F.coalesce(end(F.col(c), known & F.col(c).isNotNull()), F.min_by(c, F.when(seed, seq)))
    # what stands before the message is known changes nothing; of several seeds the first, if nothing else is earlier
    start = F.min(F.when(known | seed, seq))
    a = e.groupBy("message_id").agg(
        start.alias("start"), end(F.col("status"), known).alias("status"), F.max(F.when(known, seq)).alias("own"), F.min_by(F.struct("event_seq", "status", "reason", "files", "ts"), F.when(seed, seq)).alias("seed"), filled("supplier").alias("supplier"),
        filled("subject").alias("subject"), filled("mail_date").alias("mail_date"), end(F.struct("event_seq", why.alias("reason")), known | (kind == "note")).alias("why"),
        end(F.struct("event_seq", "files"), F.col("files").isNotNull() & ~seed).alias("files"), F.sum("_n").alias("n"), F.coalesce(end(F.col("_before"), reset), F.lit(0)).alias("before"), F.min_by("_first", F.when(known | seed, seq)).alias("first_seen"), end(F.col("ts"), known).alias("ts"),
    )
    first = F.coalesce(F.col("seed.event_seq") == F.col("start"), F.lit(False))
    seeded = lambda c: F.when(first, F.col(f"seed.{c}"))
    later = lambda c: F.col(f"{c}.event_seq") > F.col("start")
    on = lambda c: F.col(f"{c}.event_seq") >= F.col("start")
    files = F.coalesce(F.when(on("files"), F.col("files.files")), seeded("files"), F.array().cast("array<string>"))
    only_seed = F.col("own").isNull()
    return a.where("start is not null").select(
        "message_id", F.when(only_seed, seeded("status")).otherwise(F.col("status")).alias("status"), *[F.when(only_seed & ~first, None).otherwise(F.col(c)).alias(c) for c in ("supplier", "subject", "mail_date")],
        F.when(on("why") & (~first | later("why")), F.col("why.reason")).otherwise(seeded("reason")).alias("reason"), (F.col("n") - F.col("before")).cast("int").alias("attempts"), F.size(files).alias("saved_count"), files.alias("files"),
        "first_seen", F.coalesce("ts", seeded("ts")).alias("updated_at"),
    )


def seed_events(ids: DataFrame, messages: DataFrame, reason: str, first_seq: int, ts: str) -> DataFrame:
    """Seed events of the ids that no message has yet; their count is the number of rows that a seed adds."""
    new = ids.select("message_id").distinct().join(messages.select("message_id"), "message_id", "left_anti")
    none = F.lit(None).cast("string")
    return new.select(
        (F.lit(first_seq) + F.monotonically_increasing_id()).alias("event_seq"), F.lit(ts).alias("ts"), "message_id", F.lit("seed").alias("kind"), F.lit(DONE).alias("status"), none.alias("subject"), none.alias("mail_date"),
        none.alias("supplier"), F.lit(reason).alias("reason"), F.lit(None).cast("array<string>").alias("files"),
    )


def status_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("status").agg(F.count("*").alias("n"))


def reason_breakdown(messages: DataFrame) -> DataFrame:
    """Null and blank reasons stay two groups that share a label."""
    return messages.groupBy("reason").agg(F.count("*").alias("n")).select(F.coalesce("reason", F.lit("")).alias("label"), "n")


def lookup_buckets(lookups: DataFrame) -> DataFrame:
    """A blank code is NO_CODE; a null one is not."""
    bucket = F.when(F.col("lookup_code") == "", NO_CODE).otherwise(F.coalesce("pdf_status", F.lit(PENDING)))
    return lookups.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def latest(messages: DataFrame, limit: int = 5000, status: str | None = None) -> DataFrame:
    """The newest messages first; a limit of 0 means all."""
    rows = messages.where(F.col("status") == status) if status else messages
    rows = rows.orderBy(F.desc("updated_at"), "message_id")
    return rows.limit(min(limit, 100_000)) if limit > 0 else rows


def pending(lookups: DataFrame) -> DataFrame:
    """Lookups with a code whose file is still to be fetched, given-up ones left out."""
    s = F.coalesce("pdf_status", F.lit(PENDING))
    return lookups.where((F.col("lookup_code") != "") & ~s.isin(DONE, DUPLICATE) & (F.coalesce("pdf_not_found", F.lit(0)) < NOT_FOUND_LIMIT))


def decision(retry: bool = False, reprocess: bool = False, limit: int = RETRY_LIMIT) -> Column:
    """'skip' or 'include' of a known message in the next run."""
    most = F.when(F.startswith(F.coalesce("reason", F.lit("")), F.lit("SCAN_READ_ERROR")), F.greatest(F.lit(limit), F.lit(READ_ERROR_LIMIT))).otherwise(F.lit(limit))
    again = F.lit(retry) | (F.col("attempts") < most)
    return (
        F.when(F.col("status") == DONE, "skip").when(F.col("status") == SKIPPED, "include" if reprocess else "skip")
        .when((F.col("status") == FAILED) & ~again, "skip").otherwise("include")
    )


def unseen(listed: DataFrame, skip: DataFrame, include: DataFrame | None = None) -> DataFrame:
    """Listed ids that are not skipped, and forced ids that are not listed."""
    out = listed.join(skip, "id", "left_anti")
    return out if include is None else out.unionByName(include.join(listed, "id", "left_anti"))


def run_issues(events: DataFrame) -> DataFrame:
    """Issues of a run: a message's last outcome, if it is no success."""
    end = events.groupBy("message_id").agg(F.max_by(F.struct("status", "reason"), "event_seq").alias("x"))
    return end.where(F.col("x.status") != DONE).select("message_id", "x.status", "x.reason")


def reason_hint(reason, hints: list[tuple[str, str]], default: str) -> Column:
    """The hint of the first prefix that fits; blank reasons have none."""
    out = F.lit(default)
    for prefix, hint in reversed(hints):
        out = F.when(F.startswith(reason, F.lit(prefix)), hint).otherwise(out)
    return F.when(F.coalesce(reason, F.lit("")) == "", "").otherwise(out)


def circuit_breaker(tries: DataFrame, misses: int = 3) -> DataFrame:
    """``(supplier, seq, ok)`` with ``allowed``: false once ``misses`` in a row have failed; a success resets the count, and
    nothing is tried after the break."""
    from pyspark.sql import Window

    w = Window.partitionBy("supplier").orderBy("seq")
    run = tries.withColumn("wins", F.sum(F.col("ok").cast("int")).over(w))
    run = run.withColumn("lost", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("supplier", "wins").orderBy("seq")))
    broke = F.max((F.col("lost") >= misses).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return run.select("supplier", "seq", "ok", (F.coalesce(broke, F.lit(0)) == 0).alias("allowed"))


def triage(known_link, has_pdf, key, forced, hit, supplier) -> Column:
    """The first rule that fits decides what becomes of a message."""
    return (
        F.when(key.isNotNull() & known_link, "LINK").when(has_pdf, "FAILED:PDF_ATTACHMENT_NOT_DOWNLOADED").when(key.isNull() & (forced | hit), "LOOKUP")
        .when(supplier.isNotNull() & key.isNotNull(), "SKIPPED:SUPPORTED_SUPPLIER_BUT_NO_LINK").when(supplier.isNotNull(), "SKIPPED:UNSUPPORTED_SUPPLIER").otherwise("SKIPPED:NO_PDF_NO_SUPPLIER_LINK")
    )


def intake(number, code, forced) -> Column:
    n, c = nz(number), nz(code)
    missing = F.array_join(F.array_compact(F.array(F.when(n.isNull(), "invoice_no"), F.when(c.isNull(), "lookup_code"))), ", ")
    return F.when(n.isNull() & c.isNull() & ~forced, SKIPPED).when(n.isNotNull() & c.isNotNull(), DONE).otherwise(F.concat(F.lit("FAILED:"), missing))
