import base64
import io
import json
import zipfile

from pyspark.sql import functions as F

from billforge.api import Engine
from billforge.operators import filenames, ledger, reports
from billforge.schema import LOOKUPS
from billforge.sources import files, messages, workbook
from billforge.streaming import ledger as stream

XML = "<HDon><TTChung><KHMSHDon>1</KHMSHDon><KHHDon>C26TAA</KHHDon><SHDon>0012</SHDon><NLap>2026-03-05</NLap></TTChung></HDon>"


def test_zip_and_inventory(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("in/x.xml", XML)
        z.writestr("note.txt", "no")
    (tmp_path / "a.zip").write_bytes(b.getvalue())
    (tmp_path / "b.xml").write_text("\ufeff" + XML.replace("0012", "13"))
    (tmp_path / "broken.zip").write_bytes(b"PKnothing")
    (tmp_path / "page.xml").write_text("<!DOCTYPE html><html></html>")
    inv = files.inventory(spark, str(tmp_path), content=True)
    got = {(r.path.rsplit("/", 1)[-1], r.member): r.content is None for r in files.expand_zips(inv).collect()}
    assert got == {("a.zip", "in/x.xml"): False, ("b.xml", None): False, ("broken.zip", ""): True, ("page.xml", None): False}
    rows = Engine(spark, str(tmp_path)).invoices(str(tmp_path)).collect()
    assert sorted((r.file_stem, r.series, r.invoice_no) for r in rows) == [("b", "1C26TAA", "13"), ("x", "1C26TAA", "12")]


def test_page_inputs(spark):
    rows = [("/r", "z", "pdf"), ("/r/one", "a", "jpg"), ("/r/two", "b", "png"), ("/r/two", "a", "png")]
    f = spark.createDataFrame([(d, f"{n}.{s}", n, s) for d, n, s in rows], "folder string, name string, stem string, suffix string")
    assert {(r.folder, r.stem): r.alias for r in files.page_inputs(f, "/r").collect()} == {("/r", "z"): "z", ("/r/one", "a"): "one", ("/r/two", "a"): "two_p1", ("/r/two", "b"): "two_p2"}


def test_messages(spark, tmp_path):
    part = lambda path, name, mime, text=None: {"path": path, "filename": name, "mime": mime, "size": 1, "attachment_id": None, "data_b64url": base64.urlsafe_b64encode(text.encode()).decode() if text else None}
    m = [
        {"id": "1", "label_ids": ["L"], "internal_date_ms": 0, "subject": "s", "sender": "x", "parts": [part("0", "", "text/plain", "Hoá đơn mail.a.vn"), part("1", "f.xml", "text/xml")]},
        {"id": "2", "label_ids": [], "internal_date_ms": 86_400_000, "subject": "INVOICE", "sender": "x", "parts": [part("0", "f.pdf", "application/pdf")]},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, m)))
    d = messages.read_messages(spark, str(tmp_path / "m.json"))
    got = {r.id: r for r in messages.scan(d, ["a.vn"], ["invoice"]).collect()}
    assert (got["1"].has_pdf, got["1"].supplier, got["1"].keyword_hit, got["1"].content) == (False, "mail.a.vn", False, "Hoá đơn mail.a.vn\n")
    assert (got["2"].has_pdf, got["2"].supplier, got["2"].keyword_hit, got["2"].content) == (True, None, True, None)
    assert [r.filename for r in files.xml_attachments(messages.scan(d, ["a.vn"], [""])).collect()] == ["f.xml"]
    assert [r.id for r in messages.listing(d, since="1970-01-02", until="1970-01-02").collect()] == ["2"]
    assert [r.body for r in messages.first_body(d).orderBy("id").collect()] == ["Hoá đơn mail.a.vn", ""]


def test_workbook_round_trip(spark, tmp_path):
    rows = [("m1", "http://a/x?y=1&z=2", ["a", "b"], 5), ("bad id!", "http://a", None, None), ("m3", "none", ["c"], 7), (None, None, None, None)]
    d = spark.createDataFrame(rows, "`Email ID` string, `Đường dẫn` string, files array<string>, n int").coalesce(1)
    assert workbook.write_workbook(d, str(tmp_path / "r.xlsx"), 'A "sheet"') == 4
    got = workbook.read_workbooks(spark, str(tmp_path))
    t = workbook.table_of(got, {"message_id": ["email_id"], "url": ["URL", "đường DẪN"], "files": ["files"], "n": ["n"], "none": ["none"]}, ["message_id"])
    assert [tuple(r)[3:] for r in t.orderBy("row_no").collect()] == [("m1", "http://a/x?y=1&z=2", "a; b", "5", None), ("bad id!", "http://a", None, None, None), ("m3", "none", "c", "7", None)]
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    assert workbook.read_workbooks(spark, str(tmp_path)).where("row_no = -1").count() == 1
    workbook.write_ledger_csv(d, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfEmail ID,")


def test_stream_equals_batch(spark, tmp_path):
    ev = [
        (1, "m", "record", "FAILED", "s", ["a"]), (2, "n", "seed", "PENDING", None, None), (3, "m", "mark", "PENDING", None, None), (4, "m", "record", "DONE", " ", None), (5, "n", "seed", "DONE", "x", None),
        (6, "n", "record", "SKIPPED", "t", []), (7, "m", "seed", "PENDING", None, None),
    ]
    rows = [dict(event_seq=i, ts=f"t{i}", message_id=m, kind=k, status=s, subject=j, files=f, reason=None if i == 4 else f"r{i}") for i, m, k, s, j, f in ev]
    (tmp_path / "in").mkdir()
    for n, part in enumerate([rows[:3], rows[3:]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        stream.keep_table(stream.current_messages(stream.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = ledger.fold_events(spark.read.schema(stream.EVENTS).json(str(tmp_path / "in")))
    got = stream.latest_state(spark, str(tmp_path / "out")).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_filenames(spark):
    rows = spark.createDataFrame([("a", "1C26TAA", "0123"), ("q-MXP5QBYA1-z", "1C26TBB", "777"), ("none", "1C26TCC", "9")], "xml_stem string, series string, invoice_no string")
    stems = spark.createDataFrame([("x_00123", 1), ("C26TAA_123_long", 2), ("HoaDon_MXP5QBYA1", 3)], "stem string, ord int")
    assert {r.xml_stem: r.pdf_stem for r in filenames.match_stems(rows, stems).collect()} == {"a": "C26TAA_123_long", "q-MXP5QBYA1-z": "HoaDon_MXP5QBYA1", "none": "none"}
    own = spark.createDataFrame([("p", 1, "1C26TAA", "0123"), ("gone", 2, "1C26TBB", "777")], "file_stem string, ord int, series string, invoice_no string")
    f = spark.createDataFrame([("p",), ("p_2",), ("c26taa-0123",), ("c26tbb-777",)], "stem string")
    assert {r.stem: (r.target, r.dup_of) for r in reports.layout_split(f, own, f).collect()} == {"p": ("XML", None), "p_2": ("DUPLICATE", "p"), "c26taa-0123": ("DUPLICATE", "p"), "c26tbb-777": ("NO_XML", None)}


def lookups(spark, rows):
    names = [c.split()[0] for c in LOOKUPS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOOKUPS)


def test_reports(spark):
    k = lookups(spark, [
        dict(message_id="1", lookup_code="a1*", invoice_no="", pdf_status="DONE", mail_date="1"), dict(message_id="2", lookup_code="B", invoice_no="05", pdf_status="DONE", mail_date="2"),
        dict(message_id="3", lookup_code="b", invoice_no="5", pdf_status="DONE", mail_date="1"), dict(message_id="4", lookup_code="C", pdf_status=None), dict(message_id="5", lookup_code="D", pdf_status="FAILED", pdf_not_found=3), dict(message_id="6", lookup_code="E", pdf_status="DUPLICATE"),
    ])
    master = spark.createDataFrame([("A1", "7")], "code string, number string")
    assert [r.message_id for r in reports.master_additions(k, master).collect()] == ["3"]
    run = spark.createDataFrame([("4", "FAILED", "X: y"), ("8", "SKIPPED", None)], "message_id string, status string, reason string")
    m = spark.createDataFrame([("4", "sup", "d", "s")], "message_id string, supplier string, mail_date string, subject string")
    got = [(r.kind, r.message_id, r.reason, r.hint) for r in reports.issues(run, m, k, [("X", "hint")]).collect()]
    assert got == [("ERROR", "4", "X: y", "hint"), ("LOOKUP_WITHOUT_PDF", "5", "NOT_FOUND_GIVEN_UP", "LOOK_UP_BY_CODE"), ("SKIPPED", "8", "", "")]
    assert {r.message_id: r.pdf for r in reports.lookup_export(k).collect()} == {"1": "BY_HAND", "2": "BY_HAND", "3": "BY_HAND", "4": "NOT_YET", "5": "NOT_YET"}
    notes = spark.createDataFrame([(1, "4", None, None, "p", None), (2, "4", "LINKED_PDF", None, "p", None), (3, "5", "NO_PDF", None, None, "e1"), (4, "5", None, None, None, "e2"), (5, "6", "NO_PDF", "f", None, None)], "event_seq int, email_id string, kind string, file string, pdf string, error string")
    assert [(r.status, r.kind, r.pdf, r.error, r.hint) for r in reports.missing_xml(notes, m).collect()] == [("XML_ERROR", "NO_PDF", "", "e1 | e2", "RUN_AGAIN"), ("NO_XML", "LINKED_PDF", "p", "", "NOT_SENT_NOR_LINKED")]


def test_tax_id_fixes(spark):
    names = spark.createDataFrame([("alpha", "0000000001", 1)], "key string, tax_id string, ordinal int")
    known = spark.createDataFrame([("0000000001",), ("0000000002",)], "tax_id string")
    rows = spark.createDataFrame([("f1", "alpha co", ""), ("f2_0000000002", None, "9"), ("f3_0000000002", "alpha", ""), ("f4", "alpha", "0000000002"), ("f5", "beta", "")], "file string, name string, tax_id string")
    got = {r.file: (r.new_tax_id, r.why) for r in reports.tax_id_fixes(rows, names, known).collect()}
    assert got == {"f1": ("0000000001", "BY_NAME,WAS_BLANK"), "f2_0000000002": ("0000000002", "BY_FILE,REPLACED")}


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.ledger().count() == 0 and e.status().first().todo == 0 and e.report().count() == 0
    spark.createDataFrame([(1, "t", "m", "record", "FAILED", "s", None, None, "r", None)], stream.EVENTS).write.parquet(str(tmp_path / "events"))
    lookups(spark, [dict(message_id="m", lookup_code="ABCD1", mail_date="1")]).write.parquet(str(tmp_path / "lookups"))
    r = e.ledger().first()
    assert (r.message_id, r.lookup.lookup_code, e.status().first().todo, e.pending().count()) == ("m", "ABCD1", 1, 1)
    assert {x.code: x.state for x in e.import_codes([("abcd1*", ""), ("new22", "7"), ("?", "")]).collect()} == {"ABCD1": "existed", "NEW22": "added", "?": "invalid"}
    assert {(x.section, x.label, x.n) for x in e.report().collect()} == {("status", "FAILED", 1), ("open", "FAILED", 1)}


def test_workbook_of_several_sheets(spark, tmp_path):
    from billforge.operators import reports
    from billforge.schema import LOOKUPS
    from billforge.sources import files, workbook

    names = [c.split()[0] for c in LOOKUPS.split(", ")]
    rows = [{"message_id": m, "mail_date": d, "lookup_code": "K", "invoice_no": n} for m, d, n in (("a", "2026-01-02", "1"), ("b", "2026-01-03", ""), ("c", None, "3"))]
    sheets = reports.export_sheets(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOOKUPS))
    path = f"{tmp_path}/x.xlsx"
    assert workbook.write_workbook(sheets["lookups"], path, "lookups", {"summary": sheets["summary"]}) == 3
    got = workbook.read_workbooks(spark, path)
    assert {r.sheet for r in got.select("sheet").distinct().collect()} == {"lookups", "summary"}
    assert [r.message_id for r in sheets["lookups"].orderBy("seq").collect()] == ["b", "a", "c"]
    pages = files.page_texts(spark.createDataFrame([("p", b"a\fb"), ("q", b"")], "path string, content binary"), lambda c: c.decode().split("\f") if c else 1 // 0)
    assert sorted((r.file, r.page_no, r.text) for r in pages.collect()) == [("p", 1, "a"), ("p", 2, "b"), ("q", 1, None)]


def test_workbooks_made_by_tasks(spark, monkeypatch):
    """A workbook a key, several sheets where one is too small; nulls, lists and signs."""
    monkeypatch.setattr(workbook, "MAX_ROWS", 4)
    rows = [("a", i, f"x<{i}>" if i % 2 else None, ["p", "q"]) for i in range(7)] + [("b", 1, "", [])]
    d = spark.createDataFrame(rows, "k string, n int, t string, l array<string>")
    packed = {r.k: r for r in workbook.pack_workbooks(d, "k", ["n"], "S").collect()}
    assert {k: r.n for k, r in packed.items()} == {"a": 7, "b": 1}
    got = [(s, n, c) for s, n, c in workbook.sheet_rows(bytes(packed["a"].content))]
    assert [(s, n) for s, n, _ in got] == [("S", 1), ("S", 2), ("S", 3), ("S", 4), ("S 2", 1), ("S 2", 2), ("S 2", 3), ("S 2", 4), ("S 3", 1), ("S 3", 2)]
    assert got[0][2] == ["n", "t", "l"] and got[2][2] == ["1", "x<1>", "p; q"] and got[9][2][0] == "6"


def test_archives_and_workbooks_of_many_files(spark):
    """Members and rows leave a worker in lists of many files, and a key's rows may come in several batches."""
    assert list(files.bounded(iter([1, 2, files.BATCH_BYTES, 3]), lambda x: x)) == [[1, 2, files.BATCH_BYTES], [3]]
    assert [len(x) for x in files.bounded(iter(range(files.BATCH_ROWS + 1)), lambda _: 0)] == [files.BATCH_ROWS, 1]
    assert list(files.bounded(iter([]), len)) == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(k, n, None if n % 3 == 0 else n * 10, f"t{n}") for k in [*range(40), None] for n in range(7)]
        d = spark.createDataFrame(rows, "k long, n int, v long, t string").repartition(3)
        packed = workbook.pack_workbooks(d, "k", ["n"]).where("k is null or k >= 0")
        assert {(r.k, r.n) for r in packed.select("k", "n").collect()} == {(k, 7) for k in [*range(40), None]}
        read = workbook.workbook_rows(packed.select(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("path"), "content").union(spark.createDataFrame([("bad", b"PK")], "path string, content binary")))
        got = {(r.path, r.row_no): r.cells for r in read.collect()}
        assert len(got) == 41 * 8 + 1 and got["bad", -1] is None
        assert all(got[p, n + 2] == [str(n), None if n % 3 == 0 else str(n * 10), f"t{n}"] for p in ("0", "39", "none") for n in range(7))

        def zipped(names):
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w") as z:
                for x in names:
                    z.writestr(x, x)
            return b.getvalue()

        z = spark.createDataFrame([(f"z{i}", zipped([f"{i}-{j}.xml" for j in range(5)])) for i in range(20)], "path string, content binary")
        assert {(r.path, r.member, bytes(r.content).decode()) for r in files.expand_zips(z, ("xml",)).collect()} == {(f"z{i}", x, x) for i in range(20) for x in [f"{i}-{j}.xml" for j in range(5)]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
