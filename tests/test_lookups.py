import random

import pytest
from pyspark.sql import functions as F

from billforge.__main__ import main, parser
from billforge.api import Engine
from billforge.operators import ledger, lookups, reconcile, work
from billforge.schema import LOOKUPS

NAMES = [c.split()[0] for c in lookups.EVENTS.split(", ")]
FIELDS = [c.split()[0] for c in LOOKUPS.split(", ")]


def events(spark, *rows):
    return spark.createDataFrame([tuple({"event_seq": i, "ts": f"t{i}", **r}.get(n) for n in NAMES) for i, r in enumerate(rows, 1)], lookups.EVENTS)


def state(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in FIELDS) for r in rows], LOOKUPS)


def test_lookup_fold(spark):
    up = lambda m, **k: {"message_id": m, "kind": "upsert", **k}
    got = {r.message_id: r for r in lookups.fold_lookups(events(
        spark, {"message_id": "z", "kind": "result", "status": "DONE"}, up("a", lookup_code="X*", mail_date="d"), {"message_id": "a", "kind": "result", "status": "DONE", "pdf_file": "f"}, up("a", lookup_code="X*", invoice_no="5"),
        up("b", lookup_code="K"), {"message_id": "b", "kind": "result", "status": "FAILED", "error": "e", "not_found": True}, up("b", lookup_code="L"), {"message_id": "b", "kind": "result", "status": "FAILED", "not_found": True},
        up("c", lookup_code=None), {"message_id": "c", "kind": "downloaded"}, up("d", lookup_code="Q"), {"message_id": "d", "kind": "downloaded"}, {"message_id": "d", "kind": "synced"}, {"message_id": "d", "kind": "rearm"},
    )).collect()}
    assert set(got) == set("abcd")
    assert (got["a"].pdf_status, got["a"].pdf_file, got["a"].mail_date, got["a"].invoice_no, got["a"].pdf_attempts) == ("DONE", "f", "d", "5", 1)
    assert (got["b"].pdf_status, got["b"].pdf_not_found, got["b"].pdf_attempts) == ("FAILED", 2, 2)
    assert (got["c"].pdf_status, got["c"].lookup_code) == ("PENDING", "")
    assert (got["d"].pdf_status, got["d"].force_pdf, got["d"].master_synced, got["d"].pdf_error) == ("PENDING", 1, 0, None)


def test_duplicates_scenarios(spark):
    row = lambda m, code, no, **k: {"message_id": m, "lookup_code": code, "invoice_no": no, **k}
    rows = [row(f"m{i}", "K*", n) for i, n in enumerate(["5", "006", "", "5"], 1)]
    rows += [row("p1", "D", "1", mail_date="2020"), row("p2", "d ", "1", mail_date="2021", pdf_status="DONE"), row("q1", "E", "1"), row("q2", "E", "1", force_pdf=1), row("r", "M", "7"), row("s", "U", "1", pdf_status="DUPLICATE", dup_of="gone")]
    master = spark.createDataFrame([("m**", "")], "code string, number string")
    m = lookups.mark_duplicates(state(spark, *rows), master)
    got = {r.message_id: (r.pdf_status, r.dup_of, r.change) for r in m.collect()}
    assert got["m1"] == got["m2"] == (None, None, None) and got["m3"][:2] == ("DUPLICATE", "m1") and got["m4"][:2] == ("DUPLICATE", "m1")
    assert got["p1"] == ("DUPLICATE", "p2", "new") and got["p2"][0] == "DONE" and got["q2"] == (None, None, None)
    assert got["r"] == ("DUPLICATE", "MASTER", "new") and got["s"] == ("PENDING", None, "freed")
    assert lookups.duplicate_counts(m).first() == (4, 4)


def test_duplicates_against_a_model(spark):
    rng = random.Random(4)
    rows = [{"message_id": f"{i:03d}", "lookup_code": rng.choice("AB"), "invoice_no": rng.choice(["", "1", "02", "3"]), "mail_date": str(rng.randint(1, 5)), "pdf_status": rng.choice([None, "DONE", "FAILED"]), "force_pdf": int(rng.random() < 0.1)} for i in range(120)]
    reps, want = {}, {}
    for r in sorted(rows, key=lambda r: (r["pdf_status"] != "DONE", r["mail_date"], r["message_id"])):
        n, hit = r["invoice_no"].lstrip("0"), None
        if r["pdf_status"] != "DONE" and not r["force_pdf"]:
            hit = next((i for m, i in reps.get(r["lookup_code"], []) if not n or not m or n == m), None)
        if hit is None:
            reps.setdefault(r["lookup_code"], []).append((n, r["message_id"]))
        want[r["message_id"]] = hit
    assert {r.message_id: r.found for r in lookups.find_duplicates(state(spark, *rows)).collect()} == want


def test_message_marks_files_and_notes(spark):
    cols = "event_seq long, ts string, message_id string, kind string, status string, subject string, mail_date string, supplier string, reason string, files array<string>"
    e = lambda i, m, kind, status=None, reason=None, files=None: (i, f"t{i}", m, kind, status, None, None, None, reason, files)
    rows = [e(1, "a", "note", reason="x"), e(2, "a", "record", "FAILED", "r", ["f"]), e(3, "a", "mark", "PENDING"), e(4, "a", "file", files=["g"]), e(5, "a", "note", reason="n"), e(6, "b", "mark", "DONE"), e(7, "c", "file", files=["q"])]
    got = {r.message_id: r for r in ledger.fold_events(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {"a", "b"} and (got["a"].status, got["a"].reason, got["a"].files, got["a"].attempts, got["a"].updated_at) == ("PENDING", "n", ["g"], 0, "t3")
    assert (got["b"].status, got["b"].reason, got["b"].attempts, got["b"].files) == ("DONE", "MANUAL_DONE", 0, [])


def test_engine_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.seed(["a", "b"], "S", "t1") == 2 and e.seed(["b", "c"], "S", "t2") == 1
    assert e.mark(["a", "z"], "PENDING", "t3") == 2
    up = events(spark, *[{"message_id": m, "kind": "upsert", "lookup_code": "K", "invoice_no": n} for m, n in (("a", "1"), ("b", ""), ("c", "2"))])
    assert e.save_lookups(up, "t4") == 3
    assert e.dedupe("t5").first() == (1, 1) and {r.message_id: r.pdf_status for r in e.lookups().collect()}["b"] == "DUPLICATE"
    assert e.dedupe("t6").first() == (1, 0)
    assert {r.message_id: r.reason for r in e.messages().collect()}["b"] == "LOOKUP_DUPLICATE:a"
    assert e.mark_downloaded(["k"], "t7") == 0 and e.mark_downloaded(["K*"], "t8") == 2
    assert sorted(r.message_id for r in e.unsynced().collect()) == ["a", "c"]
    assert e.mark_synced(e.unsynced(), "t9") == 2 and e.unsynced().count() == 0
    e.mark(["a"], "PENDING", "t10")
    assert {r.message_id: (r.pdf_status, r.force_pdf) for r in e.lookups().collect()}["a"] == ("PENDING", 1)
    assert e.ledger(0).count() == 4 and e.csv_rows().columns == list(work.CSV_COLUMNS)


def test_command_line(spark, tmp_path, capsys):
    main([str(tmp_path), "seed", "a", "b", "--at", "t"])
    main([str(tmp_path), "ledger", "--limit", "0"])
    main([str(tmp_path), "search", "--source", "all", "--since", "2026-01-01", "--until", "2026-01-01"])
    out = capsys.readouterr().out
    assert "2 changed" in out and "after:1767225600 before:1767312000" in out and parser().parse_args(["r", "report"]).limit == 5000


def test_verify_and_migrate(spark):
    m = spark.createDataFrame([("a", "DONE", ["x", "y"]), ("b", "DONE", []), ("c", "DONE", ["x"]), ("d", "FAILED", ["q"])], "message_id string, status string, files array<string>")
    v = lookups.verify(m, spark.createDataFrame([("x",)], "name string"))
    assert {r.message_id: r.missing for r in v.collect()} == {"a": ["y"], "b": None, "c": []} and lookups.verify_summary(v).first() == (2, 1, 1)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "message_id string")
    new, left = lookups.migrate(ids("nhap-tay-A", "NHAP-TAY-B", "m"), ids("nhap-tay-A"))
    assert [r[0] for r in new.collect()] == ["NHAP-TAY-B"] and [r[0] for r in left.collect()] == ["m"]


def test_identity_and_merge(spark):
    cols = "k int, file_stem string, series string, invoice_no string, buyer_name string, buyer_tax_id string, seller_tax_id string, plate string, goods string, provenance string"
    fields = tuple(c.split()[0] for c in cols.split(", "))[1:]
    units = spark.createDataFrame([("0301234567", "U1")], "tax_id string, unit string")
    i = reconcile.with_identity(spark.createDataFrame([(1, "f", " c26taa ", "No 0012", "Công ty, Á", "", "09-9", "", "", ""), (2, "f", "x", "1", "Cần kiểm tra", "", None, "", "", ""), (3, "f", "x", "1", "n", "0301234567-001", None, "", "", "")], cols), units).orderBy("k").collect()
    assert [(r.series_key, r.number_key, r.buyer_key, r.seller_key) for r in i] == [("C26TAA", "12", "CONG TY A", "099"), ("X", "1", "", ""), ("X", "1", "U1", "")]
    old = [(1, "scan", "S", "1", "", "", "", "50A-123.45", "Cần kiểm tra", "text"), (2, "x2", "S", "2", "B", "", "", "Không biển số", "Dầu", "xml"), (3, "s3", "S", "", "", "", "", "", "", "text")]
    new = [(1, "n1", "S", "1", "B", "", "9", "Không biển số", "Xăng", "xml"), (2, "n2", "S", "2", "C", "", "", "51A-111.11", "Xăng", "xml"), (3, "n3", "S", "2", "B", "", "", "51A-111.11", "Xăng", "xml"), (4, "n4", "S", "", "", "", "", "", "", "xml"), (5, "n5", "S", "1", "B", "77", "9", "", "", "xml")]
    got = {(r.added, r.k): r for r in reconcile.merge_xml(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols), "k", fields).collect()}
    assert {k: r.outcome for k, r in got.items()} == {(0, 1): "replaced", (0, 2): "filled", (0, 3): "kept", (1, 2): "added", (1, 4): "added"}
    a = got[0, 1]
    assert (a.file_stem, a.plate, a.goods, a.buyer_name, a.buyer_tax_id, a.provenance) == ("scan", "50A-123.45", "Xăng", "B", "77", "xml")
    assert (got[0, 2].plate, got[0, 2].goods) == ("51A-111.11", "Dầu")


def test_priority_union_needs_the_file(spark):
    cols = "id string, ord int, file_stem string, series string, invoice_no string, buyer_name string, buyer_tax_id string, seller_tax_id string"
    rows = lambda *x: spark.createDataFrame([(i, k, f, "S", n, b, "", "") for k, (i, f, n, b) in enumerate(x)], cols)
    out = reconcile.priority_union([rows(("a", "a", "1", "B")), rows(("b", "b", "1", ""), ("c", "c", "2", "B")), rows(("d", "d_p2", "3", ""), ("e", "gone", "4", ""), ("f", "", "5", ""))], ["ord"], "id", present=spark.createDataFrame([("d",)], "stem string"))
    assert sorted(r.id for r in out.collect()) == ["a", "c", "d", "f"]


@pytest.mark.parametrize("n", [0, 1, 37])
def test_sequences(spark, n):
    rows = spark.range(n).withColumn("o", F.xxhash64("id"))
    got = reconcile.continue_sequence(rows, 100, ["o"]).orderBy("o").collect()
    assert [r.seq for r in got] == list(range(101, 101 + n))


def test_append_master(spark):
    master = spark.createDataFrame([(1, "7", "A", "1"), (2, "x", "B", ""), (3, None, "", None)], "row_no int, seq string, code string, number string")
    new = spark.createDataFrame([("N2",), ("N1",)], "code string")
    assert sorted((r.code, r.row_no, r.seq) for r in reconcile.append_master(master, new, ["code"]).collect()) == [("N1", 3, 3), ("N2", 4, 4)]
    assert reconcile.append_master(master.where("row_no < 2"), new, ["code"]).agg(F.max("seq")).first()[0] == 9


def test_small_operators(spark):
    f = spark.createDataFrame([("p", 3), ("p", 9), ("q", 1)], "folder string, mtime int").withColumn("suffix", F.lit("pdf"))
    got = {r.folder: (r.pdf, r.new_pdf) for r in work.folder_stats(f, spark.createDataFrame([("p", 5)], "folder string, mtime int")).collect()}
    assert got == {"p": (2, 1), "q": (1, 1)}
    notes = spark.createDataFrame([("a", "f", None), ("b", None, None), ("c", None, "e")], "email_id string, file string, error string")
    assert work.xml_presence(notes).first() == (1, 1, 1)
    assert work.settle({"a": None, "b": 1}, {"a": 2, "b": 3}, {"a": 4, "c": 5}) == {"a": 2, "b": 1, "c": 5} and work.search_query("label") is None
    s = work.read_settings(spark, "/nowhere/at/all.json", "id string")
    assert s.count() == 0 and s.columns == ["id"]
    saves = spark.createDataFrame([("d", "a.xml", 1, b"x"), ("d", "a.xml", 2, b"x"), ("d", "a.xml", 3, b"y")], "folder string, name string, id int, content binary")
    assert sorted((r.id, r.unique_name) for r in work.xml_saves(saves).collect()) == [(1, "a.xml"), (3, "a_1.xml")]


def test_typed_codes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    codes = [("abcd1*", "007"), (" ABC D1", ""), ("abcd1", "8"), ("?", ""), ("abc", ""), ("NEW22", "x12")]
    assert [r.state for r in e.import_codes(codes).collect()] == ["added", "existed", "added", "invalid", "invalid", "added"]
    assert e.add_codes(codes, "t1") == 3 and e.add_codes(codes, "t2") == 0
    assert {r.message_id: (r.lookup_code, r.invoice_no, r.pdf_status) for r in e.lookups().collect()} == {"nhap-tay-ABCD1-7": ("ABCD1*", "007", "PENDING"), "nhap-tay-ABCD1-8": ("ABCD1*", "8", "PENDING"), "nhap-tay-NEW22-12": ("NEW22*", "12", "PENDING")}
