"""The ledger as a stream: landed event files folded into current messages, one state a message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import MARKED_DONE, MARKED_PENDING
from ..schema import DONE, MESSAGES, PENDING

EVENTS = "event_seq bigint, ts string, message_id string, kind string, status string, subject string, mail_date string, supplier string, reason string, files array<string>"


def read_events(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).json(path)


def step(now: tuple | None, e) -> tuple:
    """The state after one event, by the rules of ``operators.ledger.fold_events``."""
    if now is not None and e.kind == "seed" or now is None and e.kind in ("file", "note"):
        return now
    if e.kind == "file":
        return (*now[:6], list(e.files), *now[7:])
    if e.kind == "note":
        return (*now[:4], e.reason, *now[5:])
    status, supplier, subject, mail_date, reason, attempts, files, first, _ = now or (None, None, None, None, None, 0, None, e.ts, None)
    text = lambda new, old: new.strip(" ") if isinstance(new, str) and new.strip(" ") else old
    if e.kind == "record":
        attempts += 1
    elif e.kind == "mark" and e.status == PENDING:
        attempts = 0
    files = files if e.files is None else list(e.files)
    null = lambda v: v if isinstance(v, str) else None
    reason = (MARKED_DONE if e.status == DONE else MARKED_PENDING) if e.kind == "mark" else null(e.reason)
    return null(e.status), text(e.supplier, supplier), text(e.subject, subject), text(e.mail_date, mail_date), reason, attempts, files if files is not None else [], first, e.ts


def current_messages(events: DataFrame) -> DataFrame:
    """Update-mode stream of messages that changed. A message's events must arrive in the order of event_seq from one batch to the
    next; within a batch they are sorted. State holds one row a message."""
    state = "status string, supplier string, subject string, mail_date string, reason string, attempts int, files array<string>, first_seen string, updated_at string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        for e in pd.concat(list(batches)).sort_values("event_seq").itertuples():
            now = step(now, e)
        if now is None:
            return
        held.update(now)
        status, supplier, subject, mail_date, reason, attempts, files, first, ts = now
        row = (key[0], status, supplier, subject, mail_date, reason, attempts, len(files) if files is not None else 0, files, first, ts)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in MESSAGES.split(", ")])

    return events.groupBy("message_id").applyInPandasWithState(run, MESSAGES, state, "update", GroupStateTimeout.NoTimeout)


def keep_table(messages: DataFrame, path: str, checkpoint: str):
    """Appends each batch's changed messages under its batch number; a batch that is repeated replaces its own rows. ``latest_state`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """Each message's row of its last batch."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in ("message_id", "batch")]
    return rows.groupBy("message_id").agg(F.max_by(F.struct(*cols), "batch").alias("x")).select("message_id", "x.*")
