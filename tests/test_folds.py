"""Both ledgers against events applied one after the other; with ranges so small that a message lies in many; snapshots and tails."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from billforge.operators import ledger, lookups, numbering
from billforge.schema import LOOKUPS
from billforge.streaming.ledger import EVENTS, step

MESSAGE = [c.split()[0] for c in EVENTS.split(", ")]
LOOKUP = [c.split()[0] for c in lookups.EVENTS.split(", ")]
FIELDS = [c.split()[0] for c in LOOKUPS.split(", ")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(numbering.running, "__defaults__", (*numbering.running.__defaults__[:-1], 9))


def message_events(n):
    rng = random.Random(n)
    text = lambda *x: rng.choice([None, "", " ", *x])
    kinds = ["record", "record", "mark", "seed", "file", "note"]
    out = []
    for seq in range(1, n + 1):
        kind, m = rng.choice(kinds), rng.choice(["hot", "hot", "hot", *"abcdefghij"])
        status = rng.choice(["DONE", "PENDING"]) if kind == "mark" else "DONE" if kind == "seed" else rng.choice(["DONE", "FAILED", "SKIPPED"]) if kind == "record" else None
        files = [f"f{seq}"] if kind == "file" else rng.choice([None, [], [f"r{seq}"]]) if kind == "record" else None
        some = kind == "record"
        out.append((seq, f"t{seq:05}", m, kind, status, text("s1", "s2") if some else None, text("d") if some else None, text("v") if some else None, None if kind in ("mark", "file") else text("why"), files))
    return out


def messages_by_hand(rows):
    now = {}
    for r in rows:
        e = SimpleNamespace(**dict(zip(MESSAGE, r, strict=True)))
        if (s := step(now.get(e.message_id), e)) is not None:
            now[e.message_id] = s
    return {m: (s[0], s[1], s[2], s[3], s[4], s[5], list(s[6]), s[7], s[8]) for m, s in now.items()}


def as_messages(d):
    return {r.message_id: (r.status, r.supplier, r.subject, r.mail_date, r.reason, r.attempts, r.files, r.first_seen, r.updated_at) for r in d.collect()}


@pytest.mark.parametrize("n", [40, 400])
def test_messages(spark, n):
    rows = message_events(n)
    assert as_messages(ledger.fold_events(spark.createDataFrame(rows, EVENTS))) == messages_by_hand(rows)


def test_messages_in_ranges_and_parts(spark, small):
    rows = message_events(300)
    d = spark.createDataFrame(rows, EVENTS).cache()
    want = messages_by_hand(rows)
    assert as_messages(ledger.fold_events(d)) == want
    for cut in (0, 37, 300):
        before = ledger.fold_events(d.where(F.col("event_seq") <= cut))
        assert as_messages(ledger.fold_events(d.where(F.col("event_seq") > cut), before, cut)) == want


def lookup_events(n):
    rng = random.Random(n)
    kinds = ["upsert", "upsert", "result", "result", "rearm", "reset", "downloaded", "downloaded", "synced", "duplicate", "original"]
    out = []
    for seq in range(1, n + 1):
        kind = rng.choice(kinds)
        e = dict.fromkeys(LOOKUP) | {"event_seq": seq, "ts": f"t{seq:05}", "message_id": rng.choice(["hot", "hot", "hot", *"abcdefgh"]), "kind": kind}
        if kind == "upsert":
            e |= {"mail_date": rng.choice([None, f"d{seq}"]), "header_date": rng.choice([None, "h"]), "sender": "s", "subject": f"x{seq}", "invoice_no": rng.choice([None, "1", "2"]), "lookup_code": rng.choice([None, "", "K1", "K1", "K2"])}
        elif kind == "result":
            e |= {"status": rng.choice(["DONE", "FAILED", "FAILED"]), "pdf_file": rng.choice([None, f"f{seq}"]), "error": rng.choice([None, "e"]), "not_found": rng.choice([None, True, False])}
        elif kind == "duplicate":
            e |= {"dup_of": rng.choice(["MASTER", "a"])}
        out.append(tuple(e[c] for c in LOOKUP))
    return out


def lookups_by_hand(rows):
    now = {}
    for r in rows:
        e = SimpleNamespace(**dict(zip(LOOKUP, r, strict=True)))
        s = now.get(e.message_id)
        if e.kind == "upsert":
            if s is None:
                s = now[e.message_id] = dict.fromkeys(FIELDS) | {"message_id": e.message_id, "pdf_status": "PENDING", "pdf_attempts": 0, "master_synced": 0, "force_pdf": 0, "pdf_not_found": 0}
            elif s["lookup_code"] != (e.lookup_code or ""):
                s |= {"pdf_status": "PENDING", "pdf_file": None}
            s |= {"mail_date": e.mail_date or s["mail_date"], "header_date": e.header_date, "sender": e.sender, "subject": e.subject, "invoice_no": e.invoice_no or "", "lookup_code": e.lookup_code or "", "updated_at": e.ts}
        elif s is None:
            continue
        elif e.kind == "result":
            s |= {"pdf_status": e.status, "pdf_file": e.pdf_file, "pdf_error": e.error, "pdf_attempts": s["pdf_attempts"] + 1, "pdf_updated_at": e.ts, "pdf_not_found": s["pdf_not_found"] + bool(e.not_found)}
            s["force_pdf"] = 0 if e.status == "DONE" else s["force_pdf"]
        elif e.kind == "rearm":
            s |= {"pdf_status": "PENDING", "pdf_file": None, "pdf_error": None, "dup_of": None, "master_synced": 0, "force_pdf": 1, "pdf_not_found": 0}
        elif e.kind == "reset":
            s["pdf_not_found"] = 0
        elif e.kind == "downloaded" and s["lookup_code"] and s["pdf_status"] not in ("DONE", "DUPLICATE"):
            s |= {"pdf_status": "DONE", "pdf_error": "MANUAL", "pdf_updated_at": e.ts}
        elif e.kind == "synced":
            s["master_synced"] = 1
        elif e.kind == "duplicate":
            s |= {"pdf_status": "DUPLICATE", "dup_of": e.dup_of, "pdf_file": None, "pdf_error": None}
        elif e.kind == "original":
            s |= {"pdf_status": "PENDING", "dup_of": None}
    return now


def as_lookups(d):
    return {r.message_id: r.asDict() for r in d.collect()}


@pytest.mark.parametrize("n", [30, 500])
def test_lookups(spark, n):
    rows = lookup_events(n)
    assert as_lookups(lookups.fold_lookups(spark.createDataFrame(rows, lookups.EVENTS))) == lookups_by_hand(rows)


def test_lookups_in_ranges_and_parts(spark, small):
    rows = lookup_events(240)
    d = spark.createDataFrame(rows, lookups.EVENTS).cache()
    want = lookups_by_hand(rows)
    assert as_lookups(lookups.fold_lookups(d)) == want
    for cut in (0, 53, 240):
        before = lookups.fold_lookups(d.where(F.col("event_seq") <= cut))
        assert as_lookups(lookups.fold_lookups(d.where(F.col("event_seq") > cut), before, cut)) == want


def test_running_values(spark, small):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, "b"]), i, rng.choice([None, i])) for i in range(200)]
    got = numbering.running(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], "o", last={"l": F.col("v")}, sums={"s": F.col("o")}).orderBy("o").collect()
    held = {}
    for r, (k, o, v) in zip(got, rows, strict=True):
        last, total = held.get(k, (None, 0))
        assert (r.k, r.o, r.l, r.s) == (k, o, last, total)
        held[k] = (last if v is None else v, total + o)


def test_empty_ledgers(spark):
    assert ledger.fold_events(spark.createDataFrame([], EVENTS)).count() == 0
    assert lookups.fold_lookups(spark.createDataFrame([], lookups.EVENTS)).count() == 0


def test_a_fold_from_a_snapshot_reads_its_rows_once(spark, small):
    """Written in between, rows are not made anew by each look that the running values take at them."""
    d = spark.createDataFrame(lookup_events(240), lookups.EVENTS)
    cut = 120
    out = lookups.fold_lookups(d.where(F.col("event_seq") > cut), lookups.fold_lookups(d.where(F.col("event_seq") <= cut)), cut)
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= 4, leaves
