"""The lookup ledger: invoices that are fetched by a code, as a fold of events, and what is asked of their state.

Events: ``event_seq, ts, message_id, kind`` and, by kind, ``mail_date, header_date, sender, subject, invoice_no, lookup_code`` (upsert),
``status, pdf_file, error, not_found`` (result), ``dup_of`` (duplicate). Other kinds need nothing more: rearm (fetch again, by request),
reset (found nothing so far counts no more), downloaded (fetched by hand), synced (it is in the master), original (no duplicate any more).
All but upserts change known lookups only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_code, norm_number
from ..schema import DONE, DUPLICATE, LOOKUPS, PENDING
from ..tables import dropped, written
from .dedupe import fold_dedupe, wildcard_semi
from .ledger import STATE, pending
from .numbering import running

MASTER, BY_HAND, MANUAL_PREFIX = "MASTER", "MANUAL", "nhap-tay-"
EVENTS = (
    "event_seq bigint, ts string, message_id string, kind string, mail_date string, header_date string, sender string, subject string, invoice_no string, lookup_code string, "
    "status string, pdf_file string, error string, not_found boolean, dup_of string"
)
_FIELDS = [c.split() for c in LOOKUPS.split(", ")]
_STATE = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">"


def state_events(lookups: DataFrame, upto: int = 0) -> DataFrame:
    """Lookups of a snapshot as events that come before all later ones: all fields, each under its own name but ``_state``."""
    return lookups.select(F.lit(upto).cast("bigint").alias("event_seq"), "message_id", F.lit(STATE).alias("kind"), F.struct(*[n for n, _ in _FIELDS]).alias("_state"))


def fold_lookups(events: DataFrame, snapshot: DataFrame | None = None, upto: int = 0) -> DataFrame:
    """Current lookups. An upsert keeps the state of the file unless the code changes; a result counts an attempt, and a done one ends a request.

    With a ``snapshot``, the lookups that all events up to ``upto`` make, ``events`` are the later ones only. What an event does may hang on
    the state before it in three ways: whether the lookup is known, which code it has, and whether its file is fetched. Running
    values (``numbering.running``) answer the first two, then the third; after that every field is what the last event that sets
    it says, an aggregate that is merged from parts. No lookup's events are gathered."""
    e = events.withColumn("_state", F.lit(None).cast(_STATE))
    if snapshot is not None:
        e = e.unionByName(state_events(snapshot, upto), allowMissingColumns=True)
    kind, seq, none = F.col("kind"), F.col("event_seq"), F.lit(None).cast("string")
    blank = lambda c: F.coalesce(c, F.lit(""))
    given = kind.isin("upsert", STATE)
    held = lambda n: F.col(f"_state.{n}")
    either = lambda n, own: F.when(kind == STATE, held(n)).otherwise(own)
    code = either("lookup_code", blank(F.col("lookup_code")))
    # each running value looks at its rows several times: they are written, or a fold from a snapshot would make the first ones over and over
    own = written(e, "lookup-events")
    e = running(own, ["message_id"], "event_seq", last={"_prior": F.when(given, F.struct(code.alias("code")))}).where(given | F.col("_prior").isNotNull())
    result, rearm, marked, freed, state = kind == "result", kind == "rearm", kind == "duplicate", kind == "original", kind == STATE
    first = (kind == "upsert") & F.col("_prior").isNull()
    moved = (kind == "upsert") & F.coalesce(F.col("_prior.code") != code, F.lit(False))
    # what says the state of the file outright; a download by hand counts if it is the first after that, and there is something to fetch
    outright = result | rearm | marked | freed | first | moved | state
    says = F.when(result, F.col("status")).when(marked, DUPLICATE).when(state, held("pdf_status")).otherwise(PENDING)
    missing = F.when(state, held("pdf_not_found")).otherwise((result & F.coalesce(F.col("not_found"), F.lit(False))).cast("int"))
    e = e.withColumns({"_outright": outright, "_says": says, "_missing": F.coalesce(missing, F.lit(0)).cast("bigint")})
    e = written(e, "lookup-priors")
    dropped(own)
    e = running(
        e, ["message_id"], "event_seq", last={"_told": F.when(F.col("_outright"), F.struct("event_seq", F.col("_says").alias("status"))), "_by_hand": F.when(kind == "downloaded", F.struct("event_seq"))}, sums={"_lost": F.col("_missing")}
    )
    open_ = ~F.coalesce(F.col("_told.status"), F.lit(PENDING)).isin(DONE, DUPLICATE) & (blank(F.col("_prior.code")) != "")
    fetched = (kind == "downloaded") & open_ & F.coalesce(F.col("_by_hand.event_seq") < F.col("_told.event_seq"), F.lit(True))
    e = e.withColumn("_fetched", fetched)
    fetched, reset, upsert = F.col("_fetched"), rearm | (kind == "reset") | state, kind == "upsert"
    at = lambda x, of: F.max_by(x, F.when(of, seq))
    number = lambda *cases: reduce(lambda no, x: F.when(x[0], F.lit(x[1]) if isinstance(x[1], int) else x[1]).otherwise(no), reversed(cases), F.lit(None).cast("int"))
    date = either("mail_date", F.col("mail_date"))
    done = result & F.coalesce(F.col("status") == DONE, F.lit(False))
    new = {
        "mail_date": at(date, given & date.isNotNull()), **{n: at(either(n, F.col(n)), given) for n in ("header_date", "sender", "subject")}, **{n: at(either(n, blank(F.col(n))), given) for n in ("invoice_no", "lookup_code")},
        "updated_at": at(either("updated_at", F.col("ts")), given), "pdf_status": at(F.when(fetched, DONE).otherwise(F.col("_says")), F.col("_outright") | fetched),
        "pdf_file": at(F.when(result, F.col("pdf_file")).when(state, held("pdf_file")), result | rearm | moved | first | marked | state),
        "pdf_error": at(F.when(result, F.col("error")).when(fetched, BY_HAND).when(state, held("pdf_error")), result | fetched | rearm | marked | state),
        "pdf_attempts": F.sum(F.when(state, held("pdf_attempts")).otherwise(result.cast("int"))), "pdf_updated_at": at(either("pdf_updated_at", F.col("ts")), result | fetched | state),
        "dup_of": at(F.when(marked, F.col("dup_of")).when(state, held("dup_of")).otherwise(none), marked | rearm | freed | state), "master_synced": at(number((state, held("master_synced")), (rearm, 0), (kind == "synced", 1)), rearm | (kind == "synced") | state),
        "force_pdf": at(number((state, held("force_pdf")), (rearm, 1), (done, 0)), rearm | done | state), "pdf_not_found": F.sum("_missing") - F.coalesce(at(F.col("_lost") + F.when(state, 0).otherwise(F.col("_missing")), reset), F.lit(0)),
    }
    counts = ("pdf_attempts", "master_synced", "force_pdf", "pdf_not_found")
    out = e.groupBy("message_id").agg(*[x.alias(n) for n, x in new.items()])
    return out.select(*[(F.coalesce(F.col(n), F.lit(0)) if n in counts else F.col(n)).cast(t).alias(n) for n, t in _FIELDS])


def file_events(events: DataFrame) -> DataFrame:
    """What results mean for messages: a done one with a file replaces the message's files."""
    own = events.where((F.col("kind") == "result") & (F.col("status") == DONE) & (F.coalesce("pdf_file", F.lit("")) != ""))
    return _message_events(own, "file", F.lit(None).cast("string"), F.array("pdf_file"))


def rearm_events(message_events: DataFrame) -> DataFrame:
    """A message that is marked PENDING fetches its lookup again."""
    own = message_events.where((F.col("kind") == "mark") & (F.col("status") == PENDING))
    return lookup_events(own.select("event_seq", "ts", "message_id"), "rearm")


def lookup_events(rows: DataFrame, kind: str) -> DataFrame:
    """Events of a kind that needs no more than ``event_seq, ts, message_id`` and, where ``rows`` has them, other columns."""
    cols = [c.split() for c in EVENTS.split(", ")]
    return rows.select(*[F.lit(kind).alias(n) if n == "kind" else F.col(n).cast(t).alias(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in cols])


def _message_events(rows: DataFrame, kind: str, reason, files) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("event_seq", "ts", "message_id", F.lit(kind).alias("kind"), none.alias("status"), none.alias("subject"), none.alias("mail_date"), none.alias("supplier"), reason.alias("reason"), files.alias("files"))


def find_duplicates(lookups: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Lookups with a code and the ``found`` original: MASTER for those that ``master(code, number)`` holds, else the message that comes first
    (done ones, then by date and id) and matches, a blank number matching any; null for originals. Done ones and those that were asked for are
    never duplicates."""
    rows = lookups.where("lookup_code <> ''").withColumns({"code": norm_code(F.col("lookup_code")), "number": norm_number(F.col("invoice_no"))})
    state = F.coalesce("pdf_status", F.lit(PENDING))
    rows = rows.withColumns({"_keep": (state == DONE) | (F.coalesce("force_pdf", F.lit(0)) != 0), "_rank": F.when(state == DONE, 0).otherwise(1), "_date": F.coalesce("mail_date", F.lit(""))})
    rest = rows
    out = None
    if master is not None:
        known = master.select(norm_code(F.col("code")).alias("code"), norm_number(F.col("number")).alias("number"))
        held = wildcard_semi(rows.where("not _keep"), known)
        out = held.withColumn("found", F.lit(MASTER))
        rest = rows.join(held.select("message_id"), "message_id", "left_anti")
    d = fold_dedupe(rest, ["code"], ["number"], ["_rank", "_date"], "message_id", keep_if=F.col("_keep")).withColumnRenamed("dup_of", "found") if "dup_of" not in rest.columns else (
        fold_dedupe(rest.drop("dup_of"), ["code"], ["number"], ["_rank", "_date"], "message_id", keep_if=F.col("_keep")).withColumnRenamed("dup_of", "found").join(rest.select("message_id", "dup_of"), "message_id")
    )
    names = [c for c in rows.columns if not c.startswith("_")] + ["found"]
    return d.select(names) if out is None else d.select(names).unionByName(out.select(names))


def mark_duplicates(lookups: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """All lookups with duplicates marked and former ones freed; ``change`` is new, marked, freed or null, ``note`` the message's new reason."""
    f = find_duplicates(lookups, master).select("message_id", "found")
    was = F.coalesce("pdf_status", F.lit(PENDING)) == DUPLICATE
    dup, free = F.col("found").isNotNull(), F.col("found").isNull() & was & (F.coalesce("lookup_code", F.lit("")) != "")
    fresh = dup & ~(was & F.coalesce(F.col("dup_of") == F.col("found"), F.lit(False)))
    out = lookups.join(f, "message_id", "left").withColumns({
        "change": F.when(dup & ~was, "new").when(fresh, "marked").when(free, "freed"), "note": F.when(dup, F.concat(F.lit("LOOKUP_DUPLICATE:"), F.col("found"))).when(free, "LOOKUP_EXTRACTED"), "_fresh": fresh, "_free": free,
    })
    null = F.lit(None).cast("string")
    out = out.withColumns({
        "pdf_status": F.when(dup, DUPLICATE).when(F.col("_free"), PENDING).otherwise(F.col("pdf_status")), "pdf_file": F.when(F.col("_fresh"), null).otherwise(F.col("pdf_file")),
        "pdf_error": F.when(F.col("_fresh"), null).otherwise(F.col("pdf_error")), "dup_of": F.when(dup, F.col("found")).when(F.col("_free"), null).otherwise(F.col("dup_of")),
    })
    return out.select(*lookups.columns, "change", "note")


def duplicate_counts(marked: DataFrame) -> DataFrame:
    """One row: duplicates in all, and newly marked ones."""
    return marked.agg(F.count_if(F.col("pdf_status") == DUPLICATE).alias("total"), F.count_if(F.col("change") == "new").alias("new"))


def downloaded_by_hand(lookups: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Ids of pending lookups that ``keys(key)`` name, by id or by code but for stars at the end, case and all; without keys, all pending ones."""
    state = F.coalesce("pdf_status", F.lit(PENDING))
    open_ = lookups.where((F.col("lookup_code") != "") & ~state.isin(DONE, DUPLICATE)).select("message_id", F.rtrim("lookup_code", F.lit("*")).alias("code"))
    if keys is None:
        return open_.select("message_id")
    k = keys.select(F.trim("key").alias("key")).where("key <> ''").distinct()
    by_id = open_.join(k.select(F.col("key").alias("message_id")), "message_id", "left_semi")
    by_code = open_.join(k.select(F.rtrim("key", F.lit("*")).alias("code")), "code", "left_semi")
    return by_id.select("message_id").union(by_code.select("message_id")).distinct()


def unsynced(lookups: DataFrame) -> DataFrame:
    """Done lookups that are not in the master yet, the oldest first."""
    rows = lookups.where((F.coalesce("pdf_status", F.lit(PENDING)) == DONE) & (F.coalesce("master_synced", F.lit(0)) == 0) & (F.col("lookup_code") != ""))
    return rows.orderBy(F.coalesce("mail_date", F.lit("")), "message_id")


def next_batch(lookups: DataFrame, size: int, only: DataFrame | None = None) -> DataFrame:
    """The newest pending lookups; of ``only(message_id)``, if given."""
    rows = pending(lookups)
    rows = rows if only is None else rows.join(only.select("message_id").distinct(), "message_id", "left_semi")
    return rows.orderBy(F.desc(F.coalesce("mail_date", F.lit(""))), "message_id").limit(size)


def typed_by_hand(lookups: DataFrame, prefix: str = MANUAL_PREFIX) -> DataFrame:
    """Lookups whose id says that their code was typed in; ASCII case does not matter."""
    return lookups.where(F.lower(F.substring("message_id", 1, len(prefix))) == prefix.lower())


def migrate(source: DataFrame, target: DataFrame, key: str = "message_id", prefix: str = MANUAL_PREFIX) -> tuple[DataFrame, DataFrame]:
    """The source's hand-typed rows that the target lacks, and the source without its hand-typed rows."""
    own = typed_by_hand(source.withColumn("message_id", F.col(key)) if key != "message_id" else source, prefix)
    return own.join(target.select(key), key, "left_anti"), source.join(own.select(key), key, "left_anti")


def verify(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Done messages with listed files: ``message_id, missing``, the files that ``files(name)`` does not hold, in their order; empty where
    all are there. Messages without listed files have null."""
    done = messages.where(F.col("status") == DONE).select("message_id", F.nullif(F.coalesce("files", F.array().cast("array<string>")), F.array().cast("array<string>")).alias("files"))
    gone = done.select("message_id", F.posexplode("files").alias("i", "name")).join(files.select("name").distinct(), "name", "left_anti")
    gone = gone.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("missing"))
    out = done.join(gone, "message_id", "left")
    return out.select("message_id", F.when(F.col("files").isNotNull(), F.coalesce("missing", F.array().cast("array<string>"))).alias("missing"))


def verify_summary(checked: DataFrame) -> DataFrame:
    """One row: messages checked, messages that list no file, and those that lack one."""
    n = F.size("missing")
    return checked.agg(F.count_if(F.col("missing").isNotNull()).alias("checked"), F.count_if(F.col("missing").isNull()).alias("no_files"), F.count_if(F.col("missing").isNotNull() & (n > 0)).alias("problems"))
