"""The lookup ledger as a stream: landed events of lookups and of messages folded into current lookups, by the rules of ``operators.lookups``.

State is kept in several variables a lookup, so an event writes only what it changes: what was read of the invoice, what is known of its
file, and the marks. Needs a state store of several column families: ``STATE_STORE``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lookups import BY_HAND, EVENTS, rearm_events
from ..schema import DONE, DUPLICATE, LOOKUPS, PENDING
from .ledger import read_events

#: The setting and its value that ``current_lookups`` needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_FIELDS = [c.split() for c in LOOKUPS.split(", ")]
_TYPES = dict(_FIELDS)
INVOICE = ("mail_date", "header_date", "sender", "subject", "invoice_no", "lookup_code", "updated_at")
FILE = ("pdf_status", "pdf_file", "pdf_error", "pdf_attempts", "pdf_updated_at", "pdf_not_found")
MARKS = ("dup_of", "master_synced", "force_pdf")


def read_lookup_events(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).json(path)


def all_events(lookup_events: DataFrame, message_events: DataFrame) -> DataFrame:
    """Events of lookups, and what marks of messages mean for them, as one stream."""
    return lookup_events.unionByName(rearm_events(message_events))


def both(spark: SparkSession, lookup_path: str, message_path: str) -> DataFrame:
    return all_events(read_lookup_events(spark, lookup_path), read_events(spark, message_path))


class _Lookup(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = lambda names: ", ".join(f"{n} {_TYPES[n]}" for n in names)
        self.groups = {"invoice": INVOICE, "file": FILE, "marks": MARKS}
        self.states = {g: handle.getValueState(g, kinds(names)) for g, names in self.groups.items()}

    def _held(self) -> dict | None:
        if not self.states["invoice"].exists():
            return None
        return {n: v for g, names in self.groups.items() for n, v in zip(names, self.states[g].get(), strict=True)}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._held()
        now = dict(before) if before else None
        events = pd.concat(list(rows)).sort_values("event_seq")
        for e in events.astype(object).where(events.notna(), None).to_dict("records"):
            now = self.after(now, e)
        if now is None:
            return
        for g, names in self.groups.items():
            if before is None or any(before[n] != now[n] for n in names):
                self.states[g].update(tuple(now[n] for n in names))
        yield pd.DataFrame([{"message_id": key[0], **now}], columns=[n for n, _ in _FIELDS])

    def close(self) -> None:
        pass

    @staticmethod
    def after(now: dict | None, e: dict) -> dict | None:
        """The lookup after an event; nothing before its first upsert."""
        kind, ts = e["kind"], e["ts"]
        if kind == "upsert":
            code = e["lookup_code"] or ""
            if now is None:
                now = dict.fromkeys([*INVOICE, *FILE, *MARKS]) | {"pdf_status": PENDING, "pdf_attempts": 0, "pdf_not_found": 0, "master_synced": 0, "force_pdf": 0}
            elif now["lookup_code"] != code:
                now |= {"pdf_status": PENDING, "pdf_file": None}
            date = now["mail_date"] if e["mail_date"] is None else e["mail_date"]
            return now | {"mail_date": date, "invoice_no": e["invoice_no"] or "", "lookup_code": code, "updated_at": ts, **{n: e[n] for n in ("header_date", "sender", "subject")}}
        if now is None:
            return None
        if kind == "result":
            ended = {"force_pdf": 0} if e["status"] == DONE else {}
            return now | {"pdf_status": e["status"], "pdf_file": e["pdf_file"], "pdf_error": e["error"], "pdf_attempts": now["pdf_attempts"] + 1, "pdf_updated_at": ts, "pdf_not_found": now["pdf_not_found"] + bool(e["not_found"])} | ended
        if kind == "downloaded":
            open_ = now["lookup_code"] and (now["pdf_status"] or PENDING) not in (DONE, DUPLICATE)
            return now | {"pdf_status": DONE, "pdf_error": BY_HAND, "pdf_updated_at": ts} if open_ else now
        change = {
            "rearm": {"pdf_status": PENDING, "pdf_file": None, "pdf_error": None, "dup_of": None, "master_synced": 0, "force_pdf": 1, "pdf_not_found": 0}, "reset": {"pdf_not_found": 0}, "synced": {"master_synced": 1},
            "duplicate": {"pdf_status": DUPLICATE, "dup_of": e["dup_of"], "pdf_file": None, "pdf_error": None}, "original": {"pdf_status": PENDING, "dup_of": None},
        }
        return now | change.get(kind, {})


def current_lookups(events: DataFrame) -> DataFrame:
    """Update-mode stream of lookups that changed. A lookup's events must arrive in the order of event_seq from one batch to the next; within
    a batch they are sorted."""
    return events.groupBy("message_id").transformWithStateInPandas(_Lookup(), LOOKUPS, "Update", "None")
