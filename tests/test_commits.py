"""Commits of several writers, snapshots, and writers that die between data and manifest."""

import threading

import pytest
from pyspark.sql import functions as F

from billforge.__main__ import main
from billforge.api import Engine
from billforge.operators import lookups
from billforge.sources import commits
from billforge.streaming.ledger import EVENTS


def upserts(spark, *rows):
    return spark.createDataFrame([(m, d, "", "", "", n, c) for m, d, n, c in rows], "message_id string, mail_date string, header_date string, sender string, subject string, invoice_no string, lookup_code string")


def test_two_writers_lose_and_double_nothing(spark, tmp_path):
    failed = []

    def work(name):
        try:
            e = Engine(spark, str(tmp_path))
            for i in range(3):
                assert e.mark([f"{name}{i}", f"{name}{i}x"], "DONE", f"t{i}") == 2
            e.seed(["s1", "s2"], "S", "t")
        except BaseException as x:  # noqa: BLE001
            failed.append(x)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    e = Engine(spark, str(tmp_path))
    seqs = sorted(r.event_seq for r in e.events().collect())
    # of two that seed the same ids only the first adds them
    assert not failed and seqs == list(range(1, 15)) and e.view().last == 14 and e.messages().count() == 14


def test_a_number_is_given_once(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    (tmp_path / commits.LOG).mkdir()
    assert log._claim(commits.View(log, 1, 5)) and not log._claim(commits.View(log, 1, 9))
    assert log.head().last == 5 and [p.name for p in (tmp_path / commits.LOG).iterdir() if not p.name.endswith("crc")] == [f"{1:020}.json"]


def test_a_crash_leaves_no_trace(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    e.mark(["a"], "DONE", "t1")
    seen = e.view()

    def dies(view):
        raise OSError("gone")

    monkeypatch.setattr(e.log, "_claim", dies)
    with pytest.raises(OSError):
        e.mark(["b"], "DONE", "t2")
    e = Engine(spark, str(tmp_path))
    assert [r.message_id for r in e.messages().collect()] == ["a"]
    assert e.mark(["c"], "DONE", "t3") == 1 and sorted(r.event_seq for r in e.events().collect()) == [1, 2]
    # a reader stays on its manifest
    assert [r.message_id for r in e.messages(seen).collect()] == ["a"]


def test_too_many_conflicts(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    monkeypatch.setattr(e.log, "_claim", lambda view: False)
    with pytest.raises(commits.Conflict):
        e.log.append(lambda v: [("events", e._message_rows(spark.createDataFrame([("a",)], "message_id string"), "mark", F.lit("DONE")))], tries=2)
    assert not any((tmp_path / commits.DATA).iterdir())


def test_snapshot_and_tail(spark, tmp_path):
    spark.createDataFrame([(7, "t0", "old", "record", "FAILED", "s", None, None, "r", None)], EVENTS).write.parquet(str(tmp_path / "events"))
    e = Engine(spark, str(tmp_path))
    assert e.mark(["a", "old"], "PENDING", "t1") == 2 and sorted(r.event_seq for r in e.events().collect()) == [7, 8, 9]
    e.save_lookups(upserts(spark, ("a", "1", "5", "K"), ("b", "2", "", "K"), ("c", "3", "6", "K2")), "t2")
    assert e.dedupe("t3").first() == (1, 1)
    every = lambda: (sorted(map(str, e.messages().collect())), sorted(map(str, e.lookups().collect())))
    before, full = every(), lambda: (sorted(map(str, e.messages(plain()).collect())), sorted(map(str, e.lookups(plain()).collect())))

    def plain():
        v = e.view()
        return commits.View(v.log, v.version, v.last, v.parts, None)

    assert e.compact() == e.view().last == e.view().upto and every() == before
    e.mark(["a"], "PENDING", "t4")
    e.mark_downloaded(["K2"], "t5")
    e.record(spark.createDataFrame([("old", "DONE", ["f"])], "message_id string, status string, files array<string>"), "t6")
    assert every() == full() and every() != before
    assert e.events(after=e.view().upto).count() == 2 and e.lookup_events(after=e.view().upto).count() == 1


def test_masters_and_other_ledgers(spark, tmp_path, capsys):
    one, two = Engine(spark, str(tmp_path / "one")), Engine(spark, str(tmp_path / "two"))
    one.add_codes([("ABCDE", "1"), ("FGHIJ", "")], "t1")
    two.add_codes([("ABCDE", "1")], "t1")
    assert two.migrate(one, "t2") == 1 and {r.lookup_code for r in two.lookups().collect()} == {"ABCDE*", "FGHIJ*"}
    two.mark_downloaded(None, "t3")
    master = spark.createDataFrame([(1, "1", "ABCDE", "")], "row_no int, seq string, code string, number string")
    assert [(r.code, r.row_no, r.seq) for r in two.append_master(master, "t4").collect()] == [("FGHIJ", 2, 2)]
    assert [r.lookup_code for r in two.unsynced().collect()] == ["ABCDE*"]
    main([str(tmp_path / "two"), "compact"])
    main([str(tmp_path / "two"), "issues", "1", "99"])
    assert "changed" in capsys.readouterr().out
    assert lookups.typed_by_hand(two.lookups()).count() == 2
