import random

import pytest
from pyspark.sql import functions as F

from billforge.functions import extract, html, money, page_fields, registry, rules, text
from billforge.operators import pages, xmlrows

S = "Cần kiểm tra"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("f, value, want", [
    (page_fields.series, "Ký hiệu: C26TAA", "1C26TAA"), (page_fields.series, "x 1K26TX y", "1K26TXQ"), (page_fields.series, "KY HIEU 1K2BTAN", "1K26TAN"), (page_fields.series, "nichts", None), (page_fields.series, None, None),
    (page_fields.normal_series, "IX26TXN", "1K26TXN"), (page_fields.normal_series, "1K26AN", "1K26TAN"), (page_fields.normal_series, "hello", None),
    (page_fields.invoice_number, "HÓA ĐƠN Số: 00012345", "12345"), (page_fields.invoice_number, "Số:\n0045678", "45678"), (page_fields.invoice_number, "MST 12345678", None), (page_fields.invoice_number, "Số: 1234\nNo. 123456", "123456"),
    (page_fields.date, "1-2-2026", None), (page_fields.date, "Ngày 5 tháng 3 năm 2026 rồi 01/02/2025", "01/02/2025"), (page_fields.date, "ngay O5 thang l2 nam 2026", "05/12/2026"), (page_fields.date, None, None),
    (page_fields.clean_plate, "50a 123 45", "50A-123.45"), (page_fields.clean_plate, "abc", "Không biển số"), (page_fields.clean_plate, "Biển số xe: 50A-123.45", "50A-123.45"),
    (page_fields.plate, "51B-000.00\nNgười mua hàng: 50A 123.45", "50A-123.45"), (page_fields.buyer_tax_id, "Mã số thuế: 0100000000\nNgười mua hàng\nMã số thuế: 0301234567-001", "0301234567-001"),
    (page_fields.buyer_tax_id, "Mã số thuế: 0100000000 Mã số thuế: 0200000000", "0100000000"), (page_fields.buyer_tax_id, "Buyer xx thue 0301234567 yy", "0301234567"), (page_fields.buyer_tax_id, "Buyer 0301234567", None),
    (page_fields.buyer_name, "Tên đơn vị: Công ty A MST: 1", "Công ty A"), (page_fields.buyer_name, "Tên đơn vị: 50A-123.45\nTen don vi: Cong ty B", "Cong ty B"), (page_fields.image_buyer, "Đơn vị mua hàng:\nCONG TY XANG\nx", "CONG TY XANG"),
    (page_fields.goods_name, "RON95-III", "Xang"), (page_fields.goods_name, "Dầu Diezen", "Dau"), (page_fields.goods_name, "1 | Diesel 0,05S\n", "Diesel"), (page_fields.goods_name, "", None),
    (page_fields.number_digits, "OO12I45", "12145"), (page_fields.page_number, "a_p12", 12), (page_fields.page_number, "a", 1), (page_fields.name_plate, "50a_123_45_p2", "50A-123.45"),
    (rules.goods_class, "Daunhot", "Dầu"), (rules.goods_class, "A9512", "Xăng"), (rules.goods_class, "loai do1", S), (rules.goods_class, "Dầu DO", "Dầu"), (rules.goods_class, None, S),
    (rules.amount, "0", 0), (rules.amount, "123.456.789.012", 123456789012), (rules.amount, "-500000", None), (rules.amount_status, "-500000", "blank"), (rules.amount_status, "99", "review"),
    (text.reply_class, "Mã xác nhận không đúng", "bad_captcha"), (text.reply_class, "Không tồn tại hóa đơn", "not_found"), (text.reply_class, " ", None), (text.reply_class, "x", "message"),
    (text.name_key, "Tên đơn vị: CTY  Á-B", "CTY A B"), (text.mime_header, "=?UTF-8?B?w4E=?= x", "Á x"), (text.quoted, "a b", '"a b"'), (text.file_in_name, "/a/b.c.pdf", "b.c"),
])
def test_values(spark, f, value, want):
    assert one(spark, f(F.lit(value).cast("string"))) == want


def test_file_numbers(spark):
    f = lambda name, ser="": one(spark, page_fields.file_number(F.lit(name), F.lit(ser)))
    assert f("HDGTGT_K26TAA_0012345_p2.pdf") == "12345" and f("x_QQ_0099887.pdf", "qq") == "99887" and f("x.pdf") is None
    assert one(spark, page_fields.official_file(F.lit("HDGTGT_K26TAA_12345.pdf"))) and not one(spark, page_fields.official_file(F.lit("a.pdf")))
    assert one(spark, page_fields.plates_differ_ef(F.lit("50E-123.45"), F.lit("50F-123.45"))) and not one(spark, page_fields.plates_differ_ef(F.lit("50E-123.45"), F.lit("51F-123.45")))
    assert one(spark, page_fields.plate_with_alias(F.lit("50E-123.45"), F.lit("50F-123-45_p1"))) == "50F-123.45" and one(spark, page_fields.plate_with_alias(F.lit("51A-999.99"), F.lit("50F-123-45"))) == "51A-999.99"


AMOUNTS = [
    ("Cộng tiền hàng: 2.000.000", 2000000), ("Cộng tiền hàng: 1.000.000 100.000 1.100.000", 1000000), ("Tổng cộng tiền thanh toán: 1.100.000\nthuế suất 10%", 1000000),
    ("Tiền thuế GTGT: 100.000\nTổng tiền thanh toán: 1.100.000", 1000000), ("Xăng RON 95 10 25.000 250.000", 250000), ("Số tiền bằng chữ: Một triệu hai trăm nghìn đồng chẵn", 1200000),
    ("Cộng tiền hàng: 1.234.567\nBằng chữ: Bảy triệu hai trăm ba mươi bốn nghìn năm trăm sáu mươi bảy đồng", 7234567), ("Cộng tiền hàng: 1.200.000\nBằng chữ: bảy triệu hai trăm nghìn đồng", 7200000),
    ("Tổng cộng số tiền\n55.000.000\n350000\nngười mua", 350000), ("12 345", None), (None, None), ("Cộng tiền hàng: 88.000.000.000", 88000000000),
    ("Xăng RON\nDầu Diezen 300.000\n", 300000), ("RON 95 100.000 1.100.000\nthuế suất 10%", 1000000), ("Bằng chữ: một triệu một trăm nghìn đồng\nTiền thuế GTGT: 100.000", 1000000),
]
WORDS = [
    ("Một triệu hai trăm nghìn đồng", 1200000), ("ba trăm linh năm nghìn không trăm lẻ bảy đồng", 305007), ("mười nghìn đồng", 10000), ("hai mươi mốt tỷ mười lăm triệu đồng chẵn", 21_015_000_000),
    ("nghin trieu dong", 1001000), ("chin tram chin muoi chin trieu tu nghin dong", 999004000), ("tram nghin dong", 1000), ("bay hghin dram dong", 7000), ("xyz", 0), ("", 0), (None, 0),
]


def test_amounts(spark):
    for f, cases in ((money.pre_tax_amount, AMOUNTS), (lambda c: money.words_amount(F.concat(F.lit("Bằng chữ: "), c)), WORDS)):
        d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
        assert [(cases[r.i][0], r.x) for r in d.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()] == cases


def test_money_rules(spark):
    for a, want in (([100000, 1100000], 1000000), ([1000000, 100000, 1100002], 1000002), ([1000000, 100000, 1100000], 1000000), ([5], 5)):
        assert want == one(spark, rules.pick_pre_tax(F.array(*map(F.lit, a))))
    over = lambda a, b: one(spark, rules.word_override(F.lit(a), F.lit(b)))
    assert over(123, 723) is False and over(1234567, 7234567) and not over(1234567, 1234568)
    check = lambda a: one(spark, money.words_check(F.lit(a), F.lit("Một triệu một trăm nghìn đồng")))
    assert one(spark, money.region_amount(F.lit("Ký hiệu 123456\n250.000"))) == 250000 and check(1000000) is None and check(5) == 1100000 and check(None) == 1100000
    near = lambda z: one(spark, money.nearest_tax(F.lit(z)))
    assert near("0100000000 thue 0301234567 x") == "0301234567" and near("thue" + " " * 60 + "0301234567") is None and near("0301234567") is None and near("thu 01234567890") is None


def test_needs_better(spark):
    year = lambda c, v: one(spark, rules.needs_better(c, F.lit(v), 2026))
    got = [year("buyer_name", "S7"), year("buyer_name", "abcde"), year("buyer_name", "50A-123.45"), year("buyer_name", "Cong ty"), year("plate", "Không biển số"), year("invoice_date", "01/01/2028"), year("invoice_date", "01/01/2027"), year("pre_tax_amount", "x"), year("goods", S)]
    assert got == [False, True, True, False, False, True, False, True, True]


def test_second_reading_and_overrides(spark):
    cols = "file string, page_no int, buyer_name string, buyer_tax_id string, series string, invoice_no string, invoice_date string, pre_tax_amount long, plate string, goods string, provenance string"
    a = spark.createDataFrame([("f", 1, "", "1", "S", "12", "01/01/2026", 500, "P", S, "text"), ("f", 2, "Cong ty", "1", "S", "12345", "01/01/2026", 500000, "P", "Dầu", "text")], cols)
    b = spark.createDataFrame([("f", 1, "Cong ty", "2", "T", "12345", "02/02/2020", 700000, "Q", "Xăng", ""), ("f", 2, "Other x", "2", "T", "99999", "", 1, "Q", "Xăng", "")], cols)
    got = page_fields.merge_reading(a, b, ("file", "page_no"), 2026, "image").orderBy("page_no").collect()
    assert tuple(got[0])[2:] == ("Cong ty", "1", "S", "12345", "01/01/2026", 700000, "P", "Xăng", "text+image") and tuple(got[1]) == tuple(a.collect()[1])
    out = page_fields.apply_overrides(a, [{"target": "goods", "value": "Xăng", "when": {"goods": S, "file": "f*"}}, {"target": "pre_tax_amount", "value": 7, "when": {"goods": ["Xăng"]}}])
    assert [(r.goods, r.pre_tax_amount) for r in out.orderBy("page_no").collect()] == [("Xăng", 7), ("Dầu", 500000)]


def test_pages_and_tables(spark):
    rows = [("a", "Danh sách log cột bơm"), ("a", "Hóa đơn"), ("b", "vòi bơm 1"), ("c", None)]
    assert sorted((r.file, r.text) for r in page_fields.invoice_pages(spark.createDataFrame(rows, "file string, text string")).collect() if r.text) == [("a", "Hóa đơn"), ("b", "vòi bơm 1")]
    table = [["STT", "Tên hàng hóa"], ["1", "2", "3"], ["A", "B"], [None, ""], ["1", "Xăng RON 95-III", "Lít"], ["2", "Khác nữa"]]
    t = spark.createDataFrame([(table,), ([["Tên hàng hóa"], ["CONG TY X", "STT"], ["Xăng RON"]],), ([],)], "t array<array<string>>")
    assert [r.x for r in t.select(page_fields.table_goods("t").alias("x")).collect()] == ["Xăng RON 95-III", None, None]
    order = spark.createDataFrame([("a_p10",), ("a_p2",), ("a",), ("b_p1",)], "file string")
    assert [r.file for r in order.orderBy(*page_fields.result_order(F.col("file"))).collect()] == ["a", "a_p2", "a_p10", "b_p1"]
    info = page_fields.quick_info(F.lit("Ký hiệu: 1C26TAA\nSố: 123 MST 0301234567"))
    assert one(spark, page_fields.download_name(info, F.lit(""), F.lit("x"))) == "0301234567_1C26TAA_123.pdf" and one(spark, page_fields.xml_name(F.lit("<KHHDon> C26TAA </KHHDon><SHDon>7</SHDon>"), F.lit("z"))) == "C26TAA_7.xml"


def test_broken_xml_is_rejected(spark):
    files = spark.createDataFrame([("/a.xml", "<a"), ("/b.xml", None), ("/c.xml", "<HDon><TTChung><SHDon>1</SHDon></TTChung></HDon>")], "path string, content string")
    assert [r.reject.split(":")[0] for r in xmlrows.parse_all(files).orderBy("file_stem").collect()] == ["NOT_XML", "NOT_XML", "NO_NUMBER_OR_SERIES"] and xmlrows.parse_invoices(files).count() == 0


def test_xml_parties_and_plates(spark):
    x = "<HDon><NMua/><NMua><Ten>Decoy</Ten></NMua><DLHDon><TTChung><KHHDon>c26taa</KHHDon><SHDon>0</SHDon></TTChung>{}</DLHDon></HDon>"
    extra = "<TTin><TTruong>Số xe</TTruong><DLieu>50A-111.11</DLieu></TTin><TTin><TTruong>plate</TTruong><DLieu>50A-222.22</DLieu></TTin><TTin><TTruong>k</TTruong><DLieu>50A-333.33</DLieu></TTin>"
    rows = [(f"/{i}.xml", x.format(b)) for i, b in enumerate(("<NDHDon><NMua><HVTNMHang>50A-999.99</HVTNMHang></NMua></NDHDon>" + extra, "<NMua><Ten>B</Ten><SDThoai>50A-444.44</SDThoai></NMua>" + extra, "<TTin><TTruong>k</TTruong><DLieu>50A-333.33</DLieu></TTin>"))]
    units = spark.createDataFrame([("1", "U")], "tax_id string, unit string")
    got = xmlrows.parse_invoices(spark.createDataFrame(rows, "path string, content string"), units=units).orderBy("file_stem").collect()
    assert [(r.plate, r.buyer_name, r.invoice_no, r.series, r.pre_tax_amount, r.goods) for r in got] == [("50A-999.99", None, "0", "C26TAA", None, S), ("50A-222.22", "Decoy", "0", "C26TAA", None, S), ("50A-333.33", "Decoy", "0", "C26TAA", None, S)]


def test_links(spark):
    body = '<div>Before <a href=" http://h/1 ">Link</a> rest</div><p>x<br><a href="http://h/2?type=2">nhấn <b>vào</b> đây</a> (PDF file)</p>'
    a = spark.createDataFrame([(body,)], "b string").select(html.anchors("b").alias("a")).first().a
    assert [(x.href, x.text, x.before, x.after) for x in a] == [("http://h/1", "Link", "Before", "rest"), ("http://h/2?type=2", "nhấn vào đây", "x", "(PDF file)")] and a[1].parent == "xnhấn vào đây (PDF file)"
    link = lambda key: one(spark, html.invoice_link(html.anchors(F.lit(body)), F.lit(key)))
    assert (link("fast"), link("easyinvoice"), link("pvoil"), link("none")) == ("http://h/2?type=2", "http://h/1", None, None)
    plan = lambda key, url: [tuple(x) for x in one(spark, html.xml_plan(F.lit(key), F.lit(url), html.anchors(F.lit(body))))]
    assert plan("fast", None) == [("get", "http://h/2?type=2")] and plan("pvoil", "https://h/Invoice/DownloadInvPdf?x=1") == [("page", "https://h/Invoice/ViewFromEmail?x=1")] and plan("ehoadon", "https://h/a/B9/") == [("page", "https://tchd.ehoadon.vn/TCHD?MTC=B9")] and plan("smartsign", "x") == []
    assert one(spark, html.clicked_url(F.lit("https://t/?code=a%2Fb"))) == "https://tracuuhdc.smartsign.com.vn/hddt/?code=a%2Fb&xdb=1" and one(spark, html.clicked_url(F.lit("https://t/"))) == "https://t/"
    s = registry.default_suppliers()
    assert one(spark, s.key(F.lit("a.vnpt-invoice.com.vn"))) == "vnpt" and one(spark, s.key(F.lit("x.y"))) is None


def test_sql_functions(spark):
    names = registry.register(spark)
    r = spark.sql("select norm_code(' ab12* ') a, norm_number('00a') b, digits_key('No 0012') c, fold_accents('Đá') d, words_to_number('hai muoi mot nghin') e").first()
    assert tuple(r) == ("AB12", "A", "12", "Da", 21000) and "page_numbers" in names
    assert [tuple(x) for x in spark.sql("select * from page_numbers('Số: 0012345\nx 250.000')").collect()] == [(0, "number", "12345"), (1, "amount", "250000")]
    assert one(spark, extract.words_to_number(F.lit(""))) is None and one(spark, extract.words_to_number(F.lit("ba tram le hai dong mot"))) == 302 == spark.sql("select words_to_number('ba tram le hai dong mot') x").first().x
    assert spark.sql("select words_to_number('x y') x").first().x is None


def test_page_groups_as_a_table_function(spark):
    """Without PARTITION BY and ORDER BY in the call; equal to the operator."""
    rng = random.Random(9)
    rows = [(f"f{k % 7}", p, rng.choice([None, "", "S", "T"]), rng.choice([None, "1", "2"]), rng.random() < 0.3) for k in range(7) for p in range(1, 12)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "file string, page_no int, series string, number string, heading boolean")
    registry.register(spark)
    d.createOrReplaceTempView("some_pages")
    got = spark.sql("select * from page_groups(table(some_pages))").collect()
    assert sorted(map(tuple, got)) == sorted((r.file, r.page_no, r.group_no) for r in pages.group_pages(d).collect())


def test_pages_of_one_small_file_go_to_many_tasks(spark, tmp_path):
    from billforge.plans import catalog

    spark.range(100).selectExpr("id o_orderkey", "id o_custkey", "id * 1.5 o_totalprice", "date'2025-01-02' o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    read = catalog.table(spark, str(tmp_path), "orders")
    assert read.rdd.getNumPartitions() == 1
    out = catalog.spread(read)
    assert out.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and out.count() == 100
    plan = catalog.page_rows(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_page_text_is_folded_once(spark):
    """All fields of a page read one column of its text without accents, in the plan that runs."""
    import re

    d = spark.range(3).select(F.concat("id", F.lit(".pdf")).alias("file"), F.lit(1).alias("page_no"), F.concat(F.lit("Số: 0000"), "id", F.lit("1234")).alias("text"), F.lit("text").alias("doc_kind"))
    plan = page_fields.extract_rows(d)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"translate\((?:coalesce\()*text#", plan)) == 1


def test_zeros_and_labels_at_the_end(spark):
    rows = [("0000", "0000"), ("0012", "12"), ("", ""), ("500", "500"), (None, None)]
    assert [r.v for r in spark.createDataFrame(rows, "x string, want string").select(page_fields.unzeroed(F.col("x")).alias("v")).collect()] == [w for _, w in rows]
    taxes = [("Mã số thuế: 0123456789 Người mua hàng", None), ("Mã số thuế: 0123456789", "0123456789"), ("Mã số thuế: 0123456789 Người mua hàng x thuế 0123456788", "0123456788"), ("", None)]
    assert [r.v for r in spark.createDataFrame(taxes, "x string, want string").select(page_fields.buyer_tax_id(F.col("x")).alias("v")).collect()] == [w for _, w in taxes]
