import random

import pytest
from pyspark.sql import functions as F

from billforge.functions import extract, html, text
from billforge.operators import dedupe, ledger, pages, reconcile, xmlrows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("value, want", [(" ab12* ", "AB12"), (None, "")])
def test_norm_code(spark, value, want):
    assert one(spark, text.norm_code(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("value, want", [("00012", "12"), ("000", ""), ("7.0", "7")])
def test_norm_number(spark, value, want):
    assert one(spark, text.norm_number(F.lit(value))) == want


@pytest.mark.parametrize("value, want", [("Sửa chữa xe dầu", "Sửa chữa"), ("Dầu DO", "Dầu"), ("RON 95", "Xăng"), ("", "Cần kiểm tra")])
def test_goods(spark, value, want):
    assert one(spark, extract.goods_class(F.lit(value))) == want


@pytest.mark.parametrize("value, want", [("50a 123 45", "50A-123.45"), ("abc", "Không biển số")])
def test_plate(spark, value, want):
    assert one(spark, extract.clean_plate(F.lit(value))) == want


def test_date_amount_words(spark):
    assert one(spark, extract.date(F.lit("Ngày 5 tháng 3 năm 2026"))) == "05/03/2026"
    assert one(spark, extract.amount(F.lit("1.234.567"))) == 1234567
    assert one(spark, extract.amount_status(F.lit("99"))) == "review"
    assert one(spark, extract.words_to_number(F.lit("mot trieu hai tram nghin dong"))) == 1200000
    assert one(spark, extract.pick_pre_tax(F.array(*map(F.lit, [1000000, 100000, 1100000])))) == 1000000
    assert one(spark, extract.word_override(F.lit(1234567), F.lit(7234567))) is True
    assert one(spark, extract.word_override(F.lit(1234567), F.lit(1234568))) is False


def test_supplier_domain(spark):
    t = F.lit("mail.shop.vn see abc.bill-host.com.vn")
    assert one(spark, text.supplier_domain(t, ["bill-host"])) == "bill-host.com.vn"


def test_fold_keeps_order_of_wildcards(spark):
    rows = spark.createDataFrame([("m1", "5"), ("m2", "6"), ("m3", ""), ("m4", "5")], "id string, n string").withColumn("code", F.lit("K"))
    got = {r.id: r.dup_of for r in dedupe.fold_dedupe(rows, ["code"], ["n"], [], "id").collect()}
    assert got == {"m1": None, "m2": None, "m3": "m1", "m4": "m1"}


def test_fold_against_model(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("AB"), rng.choice(["", "1", "2"]), rng.choice(["", "x", "y"])) for i in range(200)]
    got = {r.id: r.dup_of for r in dedupe.fold_dedupe(spark.createDataFrame(rows, "id long, k string, a string, b string"), ["k"], ["a", "b"], [], "id").collect()}
    reps, want = [], {}
    for i, k, a, b in rows:
        hit = next((r[0] for r in reps if r[1] == k and (not a or not r[2] or a == r[2]) and (not b or not r[3] or b == r[3])), None)
        want[i] = hit
        if hit is None:
            reps.append((i, k, a, b))
    assert got == want


def test_pages(spark):
    rows = [("f", 1, None, "A", True), ("f", 2, None, "A", True), ("f", 3, None, None, False), ("f", 4, None, "B", True)]
    got = pages.group_pages(spark.createDataFrame(rows, "file string, page_no int, series string, number string, heading boolean"))
    assert {r.page_no: r.group_no for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 2}


def test_ledger_fold(spark):
    rows = [
        (1, "t1", "m", "record", "FAILED", "s", None, None, "r", ["a"]), (2, "t2", "m", "record", "DONE", "", None, None, None, None), (3, "t3", "m", "seed", "PENDING", None, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, "event_seq long, ts string, message_id string, kind string, status string, subject string, mail_date string, supplier string, reason string, files array<string>")
    r = ledger.fold_events(e).first()
    assert (r.status, r.subject, r.attempts, r.saved_count, r.first_seen, r.reason) == ("DONE", "s", 2, 1, "t1", None)


def test_xml(spark):
    x = "<HDon><TTChung><KHMSHDon>1</KHMSHDon><KHHDon>C26TAA</KHHDon><SHDon>00001234</SHDon><NLap>2026-03-05</NLap></TTChung><NMua><HVTNMHang>50A-123.45</HVTNMHang></NMua><HHDVu><THHDVu>Diezen</THHDVu><ThTien>1000000</ThTien></HHDVu></HDon>"
    r = xmlrows.parse_invoices(spark.createDataFrame([("/a/b.xml", x)], "path string, content string")).first()
    assert (r.file_stem, r.series, r.invoice_no, r.invoice_date, r.pre_tax_amount, r.plate, r.goods) == ("b", "1C26TAA", "1234", "05/03/2026", 1000000, "50A-123.45", "Dầu")


def test_links(spark):
    d = spark.createDataFrame([('<p>Hello <a href="http://h.vn/x">Link PDF</a></p><script>no</script>',)], "h string").select(html.anchors("h").alias("a"), html.visible_text("h").alias("t"))
    r = d.select(html.pick_link(F.col("a"), "pdf", "h.vn").alias("x"), "t").first()
    assert (r.x, r.t) == ("http://h.vn/x", "Hello Link PDF")


def test_prefix_lookup(spark):
    names = spark.createDataFrame([("alpha", "1", 1), ("alpha beta", "2", 2)], "key string, tax_id string, ordinal int")
    rows = spark.createDataFrame([("alpha beta co",), ("alphabet",)], "name string")
    assert {r.name: r.tax_id for r in reconcile.prefix_lookup(rows, names).collect()} == {"alpha beta co": "1", "alphabet": None}


def whole(sql, cut, *tables):
    """Rows of a catalogue SQL without a cut that it still holds."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return sorted(con.execute(sql.replace(cut, "")).fetchall())


def test_wildcard_semi_looks_up_all_done_rows(spark):
    from billforge.plans import catalog

    want = whole(catalog.SQL["wildcard_semi"], " and event_id % 17 = 0", "events")
    assert sorted(map(tuple, catalog.wildcard_semi(spark, "/root/testdata/sf0.001").collect())) == want


def test_accent_fold_takes_every_language(spark):
    from billforge.plans import catalog

    want = whole(catalog.SQL["accent_fold"], " where lang <> 'de'", "documents")
    assert sorted(map(tuple, catalog.accent_fold(spark, "/root/testdata/sf0.001").collect())) == want
