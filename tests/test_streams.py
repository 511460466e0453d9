"""Streams of lookups and of logs against batches, with restarts from a checkpoint."""

import json
import random

import pytest
from pyspark.sql import functions as F

from billforge.operators import lookups
from billforge.streaming import ledger, logs
from billforge.streaming import lookups as stream

from test_folds import LOOKUP, lookup_events, lookups_by_hand


@pytest.fixture
def store(spark):
    spark.conf.set(*stream.STATE_STORE)
    yield
    spark.conf.unset(stream.STATE_STORE[0])


def run(rows, mode, path, checkpoint):
    q = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_lookups_as_a_stream(spark, tmp_path, store):
    rows = lookup_events(160)
    marks = [(1000 + i, f"t{i}", m, "mark", "PENDING", None, None, None, None, None) for i, m in enumerate(["hot", "a", "never"])]
    a, b, out, check = (str(tmp_path / x) for x in ("a", "b", "out", "check"))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for k, part in enumerate((rows[:70], rows[70:])):
        # three files a run, read in one batch; the second run goes on from the checkpoint
        for j in range(3):
            (tmp_path / "a" / f"{k}{j}.json").write_text("".join(json.dumps(dict(zip(LOOKUP, r, strict=True))) + "\n" for r in part[j::3]))
        if k:
            (tmp_path / "b" / "m.json").write_text("".join(json.dumps(dict(zip([c.split()[0] for c in ledger.EVENTS.split(", ")], r, strict=True))) + "\n" for r in marks))
        run(stream.current_lookups(stream.both(spark, a, b)), "update", out, check)
    got = {r.message_id: r.asDict() for r in ledger.latest_state(spark, out).collect()}
    rearmed = [tuple({"event_seq": s, "ts": t, "message_id": m, "kind": "rearm"}.get(c) for c in LOOKUP) for s, t, m, *_ in marks]
    want = lookups_by_hand([*rows, *rearmed])
    assert got == want
    batch = lookups.fold_lookups(spark.createDataFrame([*rows, *rearmed], lookups.EVENTS))
    assert {r.message_id: r.asDict() for r in batch.collect()} == want


def test_logs_cut_anywhere(spark, tmp_path, store):
    rng = random.Random(4)
    text = "".join(f"[12:00:{i % 60:02}] Zeile {i} é😀\r\n" if i % 3 else f"plain {i}\n" if i % 2 else f"10 %\r50 %\r100 % {i}\n" for i in range(60))
    data, out, check = text.encode(), str(tmp_path / "out"), str(tmp_path / "check")
    cuts = [0, *sorted(rng.sample(range(1, len(data)), 11)), len(data)]
    chunks = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    (tmp_path / "in").mkdir()
    # the checkpoint of the first run lies within a line; chunk 5 lands a run late
    for part in ([0, 1, 2], [3, 4, 6, 7], [5, 8, 9, 10, 11]):
        for i in part:
            (tmp_path / "in" / f"run_x.log.{i}").write_bytes(chunks[i])
        if part[0] == 0:
            (tmp_path / "in" / "other.log.0").write_bytes(b"one\ntwo")
        run(logs.log_lines(logs.read_chunks(spark, str(tmp_path / "in"))), "append", out, check)
    got = spark.read.parquet(out).orderBy("log", "line_no").collect()
    mine = [r for r in got if r.log == "run_x.log"]
    lines = text.replace("\r\n", "\n").split("\n")[:-1]
    last = [x.rsplit("\r", 1)[-1] for x in lines]
    assert [r.line_no for r in mine] == list(range(60)) and [(f"[{r.at}] " if r.at else "") + r.text for r in mine] == last and [r.replaces for r in mine] == ["\r" in x for x in lines]
    assert [(r.text, r.at) for r in got if r.log == "other.log"] == [("one", None)]
    assert logs.last_lines(spark.read.parquet(out), 5).groupBy("log").agg(F.count("*").alias("n")).orderBy("log").collect() == [("other.log", 1), ("run_x.log", 5)]
