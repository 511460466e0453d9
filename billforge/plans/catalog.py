"""Queries over the driver's tables, each with the SQL that gives the same rows.

Events stand for ledger events, orders and line items for invoices, pages for message bodies, documents for page text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, html, page_fields, text
from ..operators import dedupe, ledger, pages, reconcile, work, xmlrows
from ..operators import lookups as lookup_ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a table in some parts a core, at least: a table of one small file is read by one task, however long each of its rows takes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(4 * cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(parts)


# ---- invoice rows of three sources, with blanks made from the keys
_INVOICES_SQL = """
inv as (
  select o_orderkey id, cast(o_orderkey % 3 as int) source_rank, 'C' || cast(year(o_orderdate) % 100 as varchar) || 'TAA' series_key,
    cast(o_custkey % 997 + 1 as varchar) number_key,
    case when o_orderkey % 5 = 0 then '' else 'B' || cast(o_custkey % 7 as varchar) end buyer_key, case when o_orderkey % 4 = 0 then '' else 'S' || cast(o_orderkey % 2 as varchar) end seller_key, o_totalprice
  from orders)
"""


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), (k % 3).cast("int").alias("source_rank"), F.concat(F.lit("C"), (F.year("o_orderdate") % 100).cast("string"), F.lit("TAA")).alias("series_key"),
        (F.col("o_custkey") % 997 + 1).cast("string").alias("number_key"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("B"), (F.col("o_custkey") % 7).cast("string"))).alias("buyer_key"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("S"), (k % 2).cast("string"))).alias("seller_key"), "o_totalprice",
    )


_FOLD_SQL = f"""
with recursive {_INVOICES_SQL},
r as (select *, row_number() over (partition by series_key, number_key order by source_rank, id) rn from inv),
f as (
  select series_key, number_key, rn, id, source_rank, cast(null as bigint) dup_of, [{{'id': id, 'b': buyer_key, 's': seller_key}}] reps from r where rn = 1
  union all
  select series_key, number_key, rn, id, source_rank, hit, case when hit is null then list_append(reps, {{'id': id, 'b': b, 's': s}}) else reps end from (
    select r.series_key, r.number_key, r.rn, r.id, r.source_rank, r.buyer_key b, r.seller_key s, f.reps,
      list_filter(f.reps, lambda x: (x.b = '' or r.buyer_key = '' or x.b = r.buyer_key) and (x.s = '' or r.seller_key = '' or x.s = r.seller_key))[1].id hit
    from f join r on r.series_key = f.series_key and r.number_key = f.number_key and r.rn = f.rn + 1))
"""


@query(f"{_FOLD_SQL} select source_rank, count(*) \"rows\", count(*) filter (where dup_of is null) kept from f group by 1")
def consolidated_counts(spark, sf):
    """Flagship: three sources in order of priority, wildcard duplicates dropped, rows by source."""
    d = dedupe.fold_dedupe(invoices(spark, sf), ["series_key", "number_key"], ["buyer_key", "seller_key"], ["source_rank"], "id")
    return d.groupBy("source_rank").agg(F.count("*").alias("rows"), F.count_if(F.col("dup_of").isNull()).alias("kept"))


@query(f"{_FOLD_SQL} select id, dup_of from f")
def greedy_dedupe_wildcard(spark, sf):
    d = dedupe.fold_dedupe(invoices(spark, sf), ["series_key", "number_key"], ["buyer_key", "seller_key"], ["source_rank"], "id")
    return d.select("id", "dup_of")


@query(f"with {_INVOICES_SQL} select id, case when id <> first_id then first_id end dup_of from (select id, first_value(id) over (partition by series_key, number_key order by source_rank, id) first_id from inv)")
def greedy_dedupe_exact(spark, sf):
    """Without blanks the fold is the first row of a key."""
    d = dedupe.fold_dedupe(invoices(spark, sf).withColumn("one", F.lit("x")), ["series_key", "number_key"], ["one"], ["source_rank"], "id")
    return d.select("id", "dup_of")


@query(f"with {_INVOICES_SQL}, r as (select *, row_number() over (partition by series_key, number_key order by source_rank, id) rn from inv) select source_rank, count(*) n, cast(round(sum(o_totalprice)) as bigint) total from r where rn = 1 group by 1")
def priority_union(spark, sf):
    d = dedupe.fold_dedupe(invoices(spark, sf).withColumn("one", F.lit("x")), ["series_key", "number_key"], ["one"], ["source_rank"], "id").where("dup_of is null")
    return d.groupBy("source_rank").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).cast("bigint").alias("total"))


_STATUS_SQL = "case event_type when 'purchase' then 'DONE' when 'error' then 'FAILED' when 'view' then 'SKIPPED' else 'PENDING' end"


def messages(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "SKIPPED").otherwise("PENDING")
    k = F.col("event_id")
    return e.select(
        k.cast("string").alias("message_id"), status.alias("status"), F.when(k % 7 == 0, None).when(k % 5 == 0, "").otherwise(F.concat(F.lit("R"), (k % 4).cast("string"))).alias("reason"),
        (k % 6).cast("int").alias("attempts"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "user_id", "event_id",
    )


_MESSAGES_SQL = f"m as (select cast(event_id as varchar) message_id, {_STATUS_SQL} status, case when event_id % 7 = 0 then null when event_id % 5 = 0 then '' else 'R' || cast(event_id % 4 as varchar) end reason, cast(event_id % 6 as int) attempts, strftime(ts, '%Y-%m-%d %H:%M:%S') updated_at, user_id, event_id from events)"


@query(f"with {_MESSAGES_SQL} select status, count(*) n from m group by 1")
def ledger_counts(spark, sf):
    return ledger.status_counts(messages(spark, sf))


@query(f"with {_MESSAGES_SQL} select coalesce(reason, '') label, n from (select reason, count(*) n from m group by reason)")
def reason_breakdown(spark, sf):
    return ledger.reason_breakdown(messages(spark, sf))


@query(f"with {_MESSAGES_SQL} select message_id, status, updated_at from m order by updated_at desc, message_id limit 500")
def latest_rows_topk(spark, sf):
    return ledger.latest(messages(spark, sf), 500).select("message_id", "status", "updated_at")


@query(f"with {_MESSAGES_SQL} select message_id, case when status = 'DONE' then 'skip' when status = 'SKIPPED' then 'skip' when status = 'FAILED' and not attempts < 3 then 'skip' else 'include' end decision from m")
def partition_skip_include(spark, sf):
    return messages(spark, sf).select("message_id", ledger.decision().alias("decision"))


_LOOKUPS_SQL = f"{_MESSAGES_SQL}, l as (select *, case when event_id % 11 = 0 then '' when event_id % 13 = 0 then null else 'K' || cast(user_id % 50 as varchar) end lookup_code, case when event_id % 3 = 0 then '' else cast(event_id % 9 as varchar) end invoice_no, case status when 'DONE' then 'DONE' when 'FAILED' then 'FAILED' when 'SKIPPED' then 'DUPLICATE' end pdf_status, cast(event_id % 5 as int) pdf_not_found from m)"


def lookups(spark, sf):
    k = F.col("event_id")
    return messages(spark, sf).withColumns({
        "lookup_code": F.when(k % 11 == 0, "").when(k % 13 == 0, None).otherwise(F.concat(F.lit("K"), (F.col("user_id") % 50).cast("string"))),
        "invoice_no": F.when(k % 3 == 0, "").otherwise((k % 9).cast("string")),
        "pdf_status": F.when(F.col("status") == "SKIPPED", "DUPLICATE").when(F.col("status") == "PENDING", None).otherwise(F.col("status")),
        "pdf_not_found": (k % 5).cast("int"),
    })


@query(f"with {_LOOKUPS_SQL} select case when lookup_code = '' then 'NO_CODE' else coalesce(pdf_status, 'PENDING') end bucket, count(*) n from l group by 1")
def lookup_buckets(spark, sf):
    return ledger.lookup_buckets(lookups(spark, sf))


@query(f"with {_LOOKUPS_SQL} select message_id, lookup_code from l where lookup_code <> '' and coalesce(pdf_status, 'PENDING') not in ('DONE', 'DUPLICATE') and coalesce(pdf_not_found, 0) < 3")
def pending_lookup(spark, sf):
    return ledger.pending(lookups(spark, sf)).select("message_id", "lookup_code")


@query("select c_custkey id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def unseen_anti(spark, sf):
    seen = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return ledger.unseen(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), seen)


@query("select c_custkey id from customer where not exists (select 1 from orders where o_custkey = c_custkey) union all select s_suppkey + 1000000 from supplier")
def include_union(spark, sf):
    forced = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"))
    return ledger.unseen(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), forced)


@query(f"with {_LOOKUPS_SQL}, k as (select distinct lookup_code c, invoice_no n from l where status = 'DONE') select message_id from l where status <> 'DONE' and exists (select 1 from k where c = lookup_code and (n = '' or invoice_no = '' or n = invoice_no))")
def wildcard_semi(spark, sf):
    rows = lookups(spark, sf).withColumnsRenamed({"lookup_code": "code", "invoice_no": "number"})
    return dedupe.wildcard_semi(rows.where("status <> 'DONE'"), rows.where("status = 'DONE'")).select("message_id")


@query("select doc_id id, cast(strlen(text) as int) size, sha1(text) sha1, min(doc_id) over (partition by text) kept, count(*) over (partition by text) copies from documents")
def identical_documents(spark, sf):
    return dedupe.identical(table(spark, sf, "documents"), "text", "doc_id")


@query("select c_custkey, c_name, s_name from customer left join (select s_nationkey, arg_min(s_name, s_suppkey) s_name from supplier group by 1) on s_nationkey = c_nationkey")
def dim_lookup(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min_by("s_name", "s_suppkey").alias("s_name"))
    return reconcile.lookup_ranked(table(spark, sf, "customer"), [s], "c_nationkey", "s_name").select("c_custkey", "c_name", "s_name")


@query("select p_partkey, (select arg_min(tax_id, ordinal) from (select distinct split_part(p_type, ' ', 1) k, 'T' || split_part(p_type, ' ', 1) tax_id, 1 ordinal from part) where p_type = k or starts_with(p_type, k || ' ')) tax_id from part")
def prefix_lookup(spark, sf):
    p = table(spark, sf, "part")
    k = F.element_at(F.split("p_type", " "), 1)
    names = p.select(k.alias("key"), F.concat(F.lit("T"), k).alias("tax_id"), F.lit(1).alias("ordinal")).distinct()
    return reconcile.prefix_lookup(p.withColumnRenamed("p_type", "name"), names).select("p_partkey", "tax_id")


@query("select doc_id, strip_accents(text) = text plain, length(strip_accents(text)) n from documents")
def accent_fold(spark, sf):
    d = table(spark, sf, "documents")
    t = F.translate(text.fold_accents(F.col("text")), "çñïüöäëÇÑÏÜÖÄËÿ", "cniuoaeCNIUOAEy")
    return d.select("doc_id", (t == F.col("text")).alias("plain"), F.length(t).alias("n").cast("bigint"))


@query("select c_custkey, upper(trim(regexp_replace(trim(' ' || lower(c_name) || '**'), '[*]+$', ''))) code, regexp_replace(regexp_extract(c_name, '[0-9]+'), '^0+', '') number from customer")
def code_and_number_norm(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", text.norm_code(F.concat(F.lit(" "), F.lower("c_name"), F.lit("**"))).alias("code"), text.norm_number(F.regexp_extract("c_name", "[0-9]+", 0)).alias("number"))


_PLATE_SQL = "lpad(cast(o_orderkey % 90 + 10 as varchar), 2, '0') || chr(cast(97 + o_orderkey % 26 as int)) || ' ' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || '.' || lpad(cast(o_custkey % 100 as varchar), 2, '0')"


@query(f"select o_orderkey, upper(substr(p, 1, 3)) || '-' || substr(p, 5, 3) || '.' || substr(p, 9, 2) plate, strftime(o_orderdate, '%d/%m/%Y') invoice_day from (select *, {_PLATE_SQL} p from orders)")
def plate_and_date_extract(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    p = F.concat((k % 90 + 10).cast("string"), F.char(97 + k % 26), F.lit(" "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("xe "), p, F.lit(" Ngày "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" tháng "), F.month("o_orderdate").cast("string"), F.lit(" năm "), F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", extract.plate(line).alias("plate"), extract.date(line).alias("invoice_day"))


_AMOUNT_SQL = "case o_orderkey % 6 when 0 then '0' when 1 then '-500000' when 2 then '' when 3 then '123.456.789.012' when 4 then '99.999' else regexp_replace(cast(cast(floor(o_totalprice) as bigint) as varchar), '(...)$', '.\\1') end"


@query(f"select o_orderkey, case when v = 0 or v >= 100000 then v end amount, case when v is null then 'blank' when v > 0 and v < 100000 then 'review' else 'ok' end status from (select o_orderkey, case when regexp_full_match(d, '[0-9]+') then cast(d as bigint) end v from (select o_orderkey, replace({_AMOUNT_SQL}, '.', '') d from orders))")
def amount_clean(spark, sf):
    k = F.col("o_orderkey") % 6
    own = F.regexp_replace(F.floor("o_totalprice").cast("string"), "(...)$", ".$1")
    v = F.when(k == 0, "0").when(k == 1, "-500000").when(k == 2, "").when(k == 3, "123.456.789.012").when(k == 4, "99.999").otherwise(own)
    return table(spark, sf, "orders").select("o_orderkey", extract.amount(v).alias("amount"), extract.amount_status(v).alias("status"))


_GOODS = ("Sửa chữa xe dầu", "Dầu DO 0,05S", "Xăng RON 95", "Khác", "Daunhot", "A9512", "loai do1", "Bảo dưỡng xăng", "DIESEL e5", "a do b")
_GOODS_SQL = "case p_size % 10 when 0 then 'Sửa chữa' when 1 then 'Dầu' when 2 then 'Xăng' when 4 then 'Dầu' when 5 then 'Xăng' when 7 then 'Sửa chữa' when 8 then 'Dầu' when 9 then 'Dầu' else 'Cần kiểm tra' end"


@query(f"select p_partkey, {_GOODS_SQL} goods from part")
def goods_class(spark, sf):
    names = F.array(*map(F.lit, _GOODS))
    return table(spark, sf, "part").select("p_partkey", extract.goods_class(F.get(names, (F.col("p_size") % 10).cast("int"))).alias("goods"))


@query("select l_orderkey, nullif(coalesce(sum(cast(round(l_extendedprice) as bigint)) filter (where l_linenumber % 5 <> 3), 0), 0)::bigint total from lineitem group by 1")
def line_sum_fallback(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("amount", F.round("l_extendedprice").cast("bigint"))
    return work.line_total(lines.withColumn("kind", F.when(F.col("l_linenumber") % 5 == 3, "4").when(F.col("l_linenumber") % 2 == 0, "1")), "l_orderkey", "amount", "kind")


@query("select o_orderkey, case o_orderkey % 4 when 2 then greatest(a, 7) else a end picked from (select o_orderkey, 1000 + cast(floor(o_totalprice) as bigint) a from orders)")
def vat_solver(spark, sf):
    """Amount, tax and sum; tax and sum alone; the amount alone with a small other one; all three in another order, twice."""
    a, k = (1000 + F.floor("o_totalprice")).cast("bigint"), F.col("o_orderkey") % 4
    tax = F.round(a / 10).cast("bigint")
    cands = F.when(k == 0, F.array(a, tax, a + tax)).when(k == 1, F.array(tax, a + tax)).when(k == 2, F.array(a, F.lit(7).cast("bigint"))).otherwise(F.array(a + tax, a, tax, a, tax))
    return table(spark, sf, "orders").select("o_orderkey", extract.pick_pre_tax(cands).alias("picked"))


_XML_SQL = """
select o_orderkey, case when o_orderkey % 3 = 0 then '1C26TAA' else 'C26TAA' end series, case when o_orderkey % 7 = 1 then '000' else cast(o_orderkey + 1 as varchar) end invoice_no,
  case when o_orderkey % 5 = 0 then '5 thang 3' else strftime(o_orderdate, '%d/%m/%Y') end invoice_date,
  case when o_orderkey % 4 = 0 then cast(floor(o_totalprice) as bigint) + 1000 else cast(floor(o_totalprice) as bigint) end pre_tax_amount,
  case when o_orderkey % 2 = 0 then 'Dầu' else 'Xăng' end goods, case when o_orderkey % 3 = 1 then '50A-123.45' when o_orderkey % 3 = 2 then '60C-777.77' else 'Không biển số' end plate, '0301' buyer_tax_id, '0999' seller_tax_id
from orders where o_orderkey % 11 <> 0
"""


@query(_XML_SQL)
def xml_rows(spark, sf):
    """Signature blocks before the parties, a note line before the goods, missing totals, vehicle fields, dates that are none, and broken files."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    tag = lambda t, *v: F.concat(F.lit(f"<{t}>"), *[F.lit(x) if isinstance(x, str) else x for x in v], F.lit(f"</{t}>"))
    total = F.floor("o_totalprice").cast("string")
    field = lambda name, v: tag("TTin", tag("TTruong", name), tag("DLieu", v))
    xml = F.concat(
        F.lit('<HDon xmlns="urn:x"><DSCKS><NBan/><NMua><MST>1</MST></NMua></DSCKS><DLHDon>'),
        tag("TTChung", F.when(k % 3 == 0, tag("KHMSHDon", "1")).otherwise(""), tag("KHHDon", "c26TAA"), tag("SHDon", F.when(k % 7 == 1, "000").otherwise(F.lpad((k + 1).cast("string"), 8, "0"))), tag("NLap", F.when(k % 5 == 0, "5 thang 3").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))),
        F.lit("<NDHDon>"), tag("NBan", tag("MST", "09 99")), tag("NMua", tag("MST", "0301"), F.when(k % 3 == 2, tag("HVTNMHang", "xe 60C 777 77")).otherwise(tag("HVTNMHang", "Ông A"))),
        tag("HHDVu", tag("TChat", "4"), tag("THHDVu", "Sửa chữa"), tag("ThTien", "5")), tag("HHDVu", tag("TChat", "1"), tag("THHDVu", F.when(k % 2 == 0, "Diezen").otherwise("Xăng")), tag("ThTien", total)),
        tag("HHDVu", tag("THHDVu", "Khác"), tag("ThTien", "1,000")), F.when(k % 4 != 0, tag("TToan", tag("TgTCThue", total))).otherwise(""),
        F.when(k % 3 == 1, F.concat(field("Biển số", "51B-000.00"), field("Số Phương Tiện", "50A-123.45"))).otherwise(""), F.lit("</NDHDon></DLHDon>"), F.when(k % 11 == 0, "").otherwise("</HDon>"),
    )
    rows = xmlrows.parse_invoices(o.select(F.concat(F.lit("/in/"), k.cast("string"), F.lit(".xml")).alias("path"), xml.alias("content")))
    return rows.select(F.col("file_stem").cast("bigint").alias("o_orderkey"), "series", "invoice_no", "invoice_date", "pre_tax_amount", "goods", "plate", "buyer_tax_id", "seller_tax_id")


@query(f"select cast(user_id as varchar) message_id, arg_max({_STATUS_SQL}, event_id) status, cast(count(*) as int) attempts, arg_max(case when event_id % 3 <> 0 then 'S' || cast(event_id as varchar) end, event_id) subject from events group by 1")
def event_fold(spark, sf):
    m = messages(spark, sf)
    e = m.select(
        F.col("event_id").alias("event_seq"), F.col("updated_at").alias("ts"), F.col("user_id").cast("string").alias("message_id"), F.lit("record").alias("kind"), "status",
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("S"), F.col("message_id"))).otherwise("").alias("subject"), F.lit(None).cast("string").alias("mail_date"), F.lit(None).cast("string").alias("supplier"), "reason",
        F.lit(None).cast("array<string>").alias("files"),
    )
    return ledger.fold_events(e).select("message_id", "status", "attempts", "subject")


@query(f"with {_MESSAGES_SQL}, x as (select user_id message_id, arg_max(status, event_id) status, arg_max(coalesce(reason, '~'), event_id) reason from m group by 1) select cast(message_id as varchar) message_id, status, nullif(reason, '~') reason from x where status <> 'DONE'")
def run_issues(spark, sf):
    m = messages(spark, sf)
    return ledger.run_issues(m.select(F.col("user_id").cast("string").alias("message_id"), "status", "reason", F.col("event_id").alias("event_seq")))


@query("""
with t as (select user_id supplier, event_id seq, event_type <> 'error' ok from events), w as (select *, sum(ok::int) over (partition by supplier order by seq) wins from t),
l as (select *, sum((not ok)::int) over (partition by supplier, wins order by seq) lost from w)
select supplier, seq, ok, coalesce(max((lost >= 3)::int) over (partition by supplier order by seq rows between unbounded preceding and 1 preceding), 0) = 0 allowed from l""")
def circuit_breaker(spark, sf):
    e = table(spark, sf, "events")
    return ledger.circuit_breaker(e.select(F.col("user_id").alias("supplier"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")))


@query(f"with {_MESSAGES_SQL} select message_id, case when coalesce(reason, '') = '' then '' when starts_with(reason, 'R1') then 'one' when starts_with(reason, 'R') then 'any' else 'look' end hint from m")
def hint_by_prefix(spark, sf):
    return messages(spark, sf).select("message_id", ledger.reason_hint(F.col("reason"), [("R1", "one"), ("R", "any")], "look").alias("hint"))


@query("""
with recursive p as (select conv_id as file, turn + 1 page_no, turn % 3 = 0 named, case when turn % 3 = 0 then 'C26TAA|' || cast(turn // 6 as varchar) end ident, row_number() over (partition by conv_id order by turn) rn from conversations),
f as (select file, page_no, rn, 1 group_no, ident held from p where rn = 1
  union all
  select p.file, p.page_no, p.rn, case when p.ident = f.held or not p.named then f.group_no else f.group_no + 1 end, case when p.ident = f.held or not p.named then f.held else p.ident end
  from f join p on p.file = f.file and p.rn = f.rn + 1)
select file, cast(page_no as int) page_no, cast(group_no as int) group_no from f""")
def page_groups(spark, sf):
    c = table(spark, sf, "conversations")
    p = c.select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("page_no"), F.when(F.col("turn") % 3 == 0, "C26TAA").alias("series"), F.when(F.col("turn") % 3 == 0, (F.col("turn") / 6).cast("int").cast("string")).alias("number"), F.lit(False).alias("heading"))
    return pages.group_pages(p)


@query("select conv_id as file, cast(p as int) page_no from (select conv_id, max(turn + 1) top from conversations where turn % 2 = 0 group by 1), lateral (select unnest(range(1, top + 1)) p) where p % 2 = 0")
def gap_fill(spark, sf):
    return pages.gaps(table(spark, sf, "conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("page_no")).distinct())


@query(f"with {_MESSAGES_SQL} select event_id, case when user_id % 4 = 0 and event_id % 2 = 0 then 'LINK' when event_id % 9 = 0 then 'FAILED:PDF_ATTACHMENT_NOT_DOWNLOADED' when user_id % 4 <> 0 and event_id % 5 = 0 then 'LOOKUP' when event_id % 3 = 0 and user_id % 4 = 0 then 'SKIPPED:SUPPORTED_SUPPLIER_BUT_NO_LINK' when event_id % 3 = 0 then 'SKIPPED:UNSUPPORTED_SUPPLIER' else 'SKIPPED:NO_PDF_NO_SUPPLIER_LINK' end outcome from m")
def triage_decision(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    out = ledger.triage(k % 2 == 0, k % 9 == 0, F.when(u % 4 == 0, "k"), F.lit(False), k % 5 == 0, F.when(k % 3 == 0, "s"))
    return messages(spark, sf).select("event_id", out.alias("outcome"))


@query(f"with {_MESSAGES_SQL} select user_id, string_agg(coalesce(reason, ''), ' | ' order by event_id) reasons from m group by 1")
def ordered_concat(spark, sf):
    return work.joined_texts(messages(spark, sf), "user_id", "event_id", "reason").withColumnRenamed("texts", "reasons")


@query("select o_orderkey, o_orderpriority, cast(n as bigint) n, top_part from orders left join (select l_orderkey, count(*) n, max(l_partkey) top_part from lineitem group by 1) on l_orderkey = o_orderkey")
def nested_left(spark, sf):
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_partkey").alias("top"))
    j = work.nested(table(spark, sf, "orders"), line, "o_orderkey", "lines", ["n", "top"])
    return j.select("o_orderkey", "o_orderpriority", "lines.n", F.col("lines.top").alias("top_part"))


_LOOSE = "(a.b = '' or b.b = '' or a.b = b.b) and (a.s = '' or b.s = '' or a.s = b.s)"


@query(f"with {_INVOICES_SQL}, k as (select id, source_rank, series_key, number_key, buyer_key b, seller_key s from inv) select a.id, min(b.id) ex from k a join k b on a.source_rank = 0 and b.source_rank = 1 and a.series_key = b.series_key and a.number_key = b.number_key and {_LOOSE} group by 1")
def reconcile_first_match(spark, sf):
    i = invoice_rows(spark, sf)
    return reconcile.first_match(i.where("source_rank = 0"), i.where("source_rank = 1").withColumnRenamed("id", "ex"), "id", "ex", "ex")


@query("select count(*) \"rows\", count(*) filter (where o_orderkey % 3 > 0) with_series, count(*) filter (where o_custkey % 2 = 0) petrolimex, count(*) filter (where o_custkey % 2 = 1) standard, count(*) filter (where o_orderstatus = 'F') errors from orders")
def run_summary(spark, sf):
    o = table(spark, sf, "orders")
    return work.run_summary(o.select(
        F.when(F.col("o_orderkey") % 3 > 0, "C26TAA").otherwise(" ").alias("series"), F.when(F.col("o_custkey") % 2 == 0, "petrolimex").otherwise("standard").alias("issuer"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("text").alias("provenance"),
    ))


@query("select row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) + 100 seq, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate from lineitem")
def continue_sequence(spark, sf):
    """All line items with what they hold, numbered by day, order and line; days are shared by many."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return reconcile.continue_sequence(rows, 100, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


# ---- the lookup ledger
def lookup_events(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.when(k % 5 == 0, "result").when(k % 7 == 0, "rearm").when(k % 11 == 0, "reset").when(k % 13 == 0, "downloaded").when(k % 17 == 0, "synced").otherwise("upsert")
    e = messages(spark, sf).select(
        k.alias("event_seq"), F.col("updated_at").alias("ts"), u.cast("string").alias("message_id"), kind.alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("d"), (k % 10).cast("string"))).alias("mail_date"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("K"), F.floor(k / 40).cast("string"))).alias("lookup_code"), (k % 9).cast("string").alias("invoice_no"), F.when(k % 2 == 0, "DONE").otherwise("FAILED").alias("status"),
        F.when(k % 2 == 0, F.concat(F.lit("f"), k.cast("string"))).alias("pdf_file"), (k % 3 == 0).alias("not_found"), F.when(k % 2 == 1, "E").alias("error"),
    )
    names = [c.split() for c in lookup_ledger.EVENTS.split(", ")]
    return e.select(*[F.col(n) if n in e.columns else F.lit(None).cast(t).alias(n) for n, t in names])


_LOOKUP_EVENTS_SQL = f"""
{_MESSAGES_SQL}, e as (select event_id k, user_id u, case when event_id % 5 = 0 then 'result' when event_id % 7 = 0 then 'rearm' when event_id % 11 = 0 then 'reset' when event_id % 13 = 0 then 'downloaded' when event_id % 17 = 0 then 'synced' else 'upsert' end kind,
  case when event_id % 3 = 0 then 'd' || cast(event_id % 10 as varchar) end mail_date, case when event_id % 4 = 0 then '' else 'K' || cast(event_id // 40 as varchar) end code, cast(event_id % 9 as varchar) number,
  case when event_id % 2 = 0 then 'DONE' else 'FAILED' end status, case when event_id % 2 = 0 then 'f' || cast(event_id as varchar) end file, event_id % 3 = 0 missing, case when event_id % 2 = 1 then 'E' end error from m),
s as (select *, row_number() over (partition by u order by k) rn from e where k >= (select min(k) from e x where x.u = e.u and x.kind = 'upsert')),
f as (
  select u, rn, mail_date, number, code, 'PENDING' status, cast(null as varchar) file, cast(null as varchar) error, 0 attempts, 0 synced, 0 forced, 0 missing from s where rn = 1
  union all
  select f.u, s.rn, case when s.kind = 'upsert' then coalesce(s.mail_date, f.mail_date) else f.mail_date end, case when s.kind = 'upsert' then s.number else f.number end, case when s.kind = 'upsert' then s.code else f.code end,
    case when s.kind = 'result' then s.status when s.kind = 'downloaded' and f.code <> '' and f.status <> 'DONE' then 'DONE' when s.kind = 'rearm' or s.kind = 'upsert' and s.code <> f.code then 'PENDING' else f.status end,
    case when s.kind = 'result' then s.file when s.kind = 'rearm' or s.kind = 'upsert' and s.code <> f.code then null else f.file end,
    case when s.kind = 'result' then s.error when s.kind = 'downloaded' and f.code <> '' and f.status <> 'DONE' then 'MANUAL' when s.kind = 'rearm' then null else f.error end,
    f.attempts + (s.kind = 'result')::int, case when s.kind = 'rearm' then 0 when s.kind = 'synced' then 1 else f.synced end,
    case when s.kind = 'rearm' then 1 when s.kind = 'result' and s.status = 'DONE' then 0 else f.forced end, case when s.kind in ('rearm', 'reset') then 0 else f.missing + (s.kind = 'result' and s.missing)::int end
  from f join s on s.u = f.u and s.rn = f.rn + 1)
"""


@query(f"with recursive {_LOOKUP_EVENTS_SQL} select cast(u as varchar) message_id, mail_date, number invoice_no, code lookup_code, status pdf_status, file pdf_file, error pdf_error, attempts pdf_attempts, synced master_synced, forced force_pdf, missing pdf_not_found from f where rn = (select max(rn) from s where s.u = f.u)")
def lookup_fold(spark, sf):
    """Upserts, results, requests, resets, downloads by hand and syncs of every lookup, in order."""
    s = lookup_ledger.fold_lookups(lookup_events(spark, sf))
    return s.select("message_id", "mail_date", "invoice_no", "lookup_code", "pdf_status", "pdf_file", "pdf_error", "pdf_attempts", "master_synced", "force_pdf", "pdf_not_found")


def lookup_rows(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.lpad(k.cast("string"), 9, "0").alias("message_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("mail_date"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit(" k"), (F.col("o_custkey") % 997).cast("string"), F.lit("*"))).alias("lookup_code"),
        F.when(k % 3 == 0, "").otherwise((k % 4 + 1).cast("string")).alias("invoice_no"), F.when(k % 5 == 0, "DONE").when(k % 7 == 0, "DUPLICATE").when(k % 11 == 0, "FAILED").alias("pdf_status"),
        F.when(k % 7 == 0, "000000000").alias("dup_of"), F.when(k % 5 == 0, "f").alias("pdf_file"), F.lit(None).cast("string").alias("pdf_error"), (k % 13 == 0).cast("int").alias("force_pdf"), (k % 2).cast("int").alias("master_synced"),
        F.lit(0).alias("pdf_not_found"), F.lit("").alias("header_date"), F.lit("").alias("sender"), F.lit("").alias("subject"),
    )


_LOOKUP_ROWS_SQL = """
l as (select lpad(cast(o_orderkey as varchar), 9, '0') message_id, strftime(o_orderdate, '%Y-%m-%d') mail_date, o_orderkey % 9 = 0 no_code, 'K' || cast(o_custkey % 997 as varchar) code, case when o_orderkey % 3 = 0 then '' else cast(o_orderkey % 4 + 1 as varchar) end number,
  case when o_orderkey % 5 = 0 then 'DONE' when o_orderkey % 7 = 0 then 'DUPLICATE' when o_orderkey % 11 = 0 then 'FAILED' end pdf_status, case when o_orderkey % 7 = 0 then '000000000' end dup_of, o_orderkey % 13 = 0 forced, o_orderkey % 2 synced, o_orderkey k from orders)
"""
_LOOKUP_DUPS_SQL = f"""
with recursive {_LOOKUP_ROWS_SQL}, master as (select 'K' || cast(s_suppkey as varchar) code, case when s_suppkey % 2 = 0 then '' else '2' end number from supplier),
c as (select *, coalesce(pdf_status, '') = 'DONE' or forced keep, exists (select 1 from master m where m.code = l.code and (m.number = '' or l.number = '' or m.number = l.number)) held from l where not no_code),
r as (select *, row_number() over (partition by code order by coalesce(pdf_status, '') <> 'DONE', mail_date, message_id) rn from c where keep or not held),
f as (
  select code, rn, message_id, cast(null as varchar) dup, [{{'id': message_id, 'n': number}}] reps from r where rn = 1
  union all
  select code, rn, message_id, hit, case when hit is null then list_append(reps, {{'id': message_id, 'n': number}}) else reps end from (
    select r.code, r.rn, r.message_id, r.number, f.reps, case when not r.keep then list_filter(f.reps, lambda x: x.n = '' or r.number = '' or x.n = r.number)[1].id end hit from f join r on r.code = f.code and r.rn = f.rn + 1)),
d as (select message_id, dup from f union all select message_id, 'MASTER' from c where held and not keep)
"""


@query(f"{_LOOKUP_DUPS_SQL} select l.message_id, case when dup is not null then 'DUPLICATE' when l.pdf_status = 'DUPLICATE' and not no_code then 'PENDING' else l.pdf_status end pdf_status, case when dup is not null then dup when l.pdf_status = 'DUPLICATE' and not no_code then null else l.dup_of end dup_of, case when dup is not null and coalesce(l.pdf_status, '') <> 'DUPLICATE' then 'new' when dup is not null and l.dup_of <> dup then 'marked' when dup is null and l.pdf_status = 'DUPLICATE' and not no_code then 'freed' end change from l left join d using (message_id)")
def mark_duplicates(spark, sf):
    """Lookups by code and partly known number, against the master and each other."""
    k = F.col("s_suppkey")
    master = table(spark, sf, "supplier").select(F.concat(F.lit("k"), k.cast("string"), F.lit("**")).alias("code"), F.when(k % 2 == 0, "").otherwise("002").alias("number"))
    return lookup_ledger.mark_duplicates(lookup_rows(spark, sf), master).select("message_id", "pdf_status", "dup_of", "change")


@query(f"with {_LOOKUP_ROWS_SQL} select message_id from l where not no_code and coalesce(pdf_status, 'PENDING') not in ('DONE', 'DUPLICATE') and (k % 6 = 1 and k % 4 = 1 or cast(substr(code, 2) as int) % 50 = 3)")
def downloaded_by_hand(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    ids = o.where((k % 6 == 1) & (k % 4 == 1)).select(F.concat(F.lit(" "), F.lpad(k.cast("string"), 9, "0")).alias("key"))
    codes = o.where(F.col("o_custkey") % 997 % 50 == 3).select(F.concat(F.lit(" k"), (F.col("o_custkey") % 997).cast("string"), F.lit("**")).alias("key"))
    rows = lookup_rows(spark, sf).withColumn("lookup_code", F.trim("lookup_code"))
    return lookup_ledger.downloaded_by_hand(rows, ids.union(codes))


@query(f"with {_LOOKUP_ROWS_SQL} select message_id, mail_date from l where pdf_status = 'DONE' and synced = 0 and not no_code")
def unsynced_rows(spark, sf):
    return lookup_ledger.unsynced(lookup_rows(spark, sf)).select("message_id", "mail_date")


@query(f"with {_LOOKUP_ROWS_SQL} select count(*) filter (where own) total, count(*) filter (where own and complete) complete, count(*) filter (where own and not complete) missing, count(*) filter (where own and pdf_status = 'DONE') fetched, count(*) filter (where not own) duplicates from (select *, coalesce(pdf_status, '') <> 'DUPLICATE' own, not no_code and number <> '' complete from l)")
def export_summary(spark, sf):
    return work.export_summary(lookup_rows(spark, sf))


@query("select l_orderkey as message_id, coalesce(list(name order by l_linenumber, l_partkey) filter (where l_partkey % 3 > 0), []) missing from (select l_orderkey, l_linenumber, l_partkey, 'p' || cast(l_partkey as varchar) name from lineitem) group by 1")
def verify_files(spark, sf):
    """Listed files that are not there, in the order of the list."""
    line = table(spark, sf, "lineitem")
    m = line.groupBy(F.col("l_orderkey").alias("message_id")).agg(F.lit("DONE").alias("status"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string"))).alias("files"))
    there = line.where("l_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"))
    return lookup_ledger.verify(m, there)


# ---- rows of two sources merged
def invoice_rows(spark, sf):
    """Invoices with the identity's columns as they are read."""
    i = invoices(spark, sf)
    return i.select("id", "source_rank", F.concat(F.lit(" "), F.lower("series_key")).alias("series"), F.concat(F.lit("No 00"), F.col("number_key")).alias("invoice_no"), F.col("buyer_key").alias("buyer_name"), F.lit("").alias("buyer_tax_id"), F.regexp_replace("seller_key", "S", "9 9").alias("seller_tax_id"), "o_totalprice")


_MERGE_SQL = f"""
with recursive {_INVOICES_SQL}, i as (select id, case when source_rank = 0 then 0 else 1 end fresh, series_key, number_key, buyer_key b, seller_key s, case when id % 6 = 0 then '' else 'P' || cast(id as varchar) end plate, case when source_rank = 0 and id % 2 = 0 then 'text' else 'xml' end kind from inv where source_rank < 2),
r as (select *, row_number() over (partition by series_key, number_key order by fresh, id) rn from i),
f as (
  select series_key, number_key, rn, id, id of, [{{'id': id, 'b': b, 's': s}}] reps from r where rn = 1
  union all
  select series_key, number_key, rn, id, coalesce(hit, id), case when hit is null then list_append(reps, {{'id': id, 'b': b, 's': s}}) else reps end from (
    select r.series_key, r.number_key, r.rn, r.id, r.b, r.s, f.reps, case when r.fresh = 1 then list_filter(f.reps, lambda x: (x.b = '' or r.b = '' or x.b = r.b) and (x.s = '' or r.s = '' or x.s = r.s))[1].id end hit
    from f join r on r.series_key = f.series_key and r.number_key = f.number_key and r.rn = f.rn + 1)),
g as (select f.of, list(i.plate order by i.fresh, i.id) plates, list(i.b order by i.fresh, i.id) bs, list(i.s order by i.fresh, i.id) ss, list(i.kind order by i.fresh, i.id) kinds, min(i.fresh) fresh from f join i using (id) group by 1)
select of id, fresh added, case when kinds[1] = 'text' and len(kinds) > 1 and plates[2] <> '' then plates[2] else coalesce(list_filter(plates, lambda x: x <> '')[1], plates[1]) end plate, case when len(kinds) > 1 then 'xml' else kinds[1] end provenance,
  case when kinds[1] = 'text' and len(kinds) > 1 then 'replaced' when fresh = 1 then 'added' when plates[1] = '' and len(list_filter(plates, lambda x: x <> '')) > 0 or bs[1] = '' and len(list_filter(bs, lambda x: x <> '')) > 0 or ss[1] = '' and len(list_filter(ss, lambda x: x <> '')) > 0 then 'filled' else 'kept' end outcome from g
"""


@query(_MERGE_SQL)
def merge_xml_rows(spark, sf):
    """Rows of XML files merged into result rows: replaced, filled, kept or added."""
    k = F.col("id")
    i = invoice_rows(spark, sf).where("source_rank < 2").withColumns({
        "file_stem": F.concat(F.lit("f"), k.cast("string")), "plate": F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("P"), k.cast("string"))), "provenance": F.when((F.col("source_rank") == 0) & (k % 2 == 0), "text").otherwise("xml"),
    })
    fields = ("file_stem", "series", "invoice_no", "buyer_name", "buyer_tax_id", "seller_tax_id", "plate", "provenance")
    out = reconcile.merge_xml(i.where("source_rank = 0"), i.where("source_rank = 1"), "id", fields)
    return out.select("id", "added", "plate", "provenance", "outcome")


# ---- pages
@query("""
select o_orderkey, '1K26TAN' series, cast(o_orderkey + 10000 as varchar) invoice_no, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d/%m/%Y') else '01/12/2025' end invoice_date, 1000 * a pre_tax_amount,
  case when o_orderkey % 5 = 0 then 'Không biển số' else '50A-123.' || lpad(cast(o_custkey % 100 as varchar), 2, '0') end plate, case when o_orderkey % 3 = 0 then 'Dầu' else 'Xăng' end goods, 'Công ty ' || cast(o_custkey as varchar) buyer_name, '03' || lpad(cast(o_custkey as varchar), 8, '0') buyer_tax_id
from (select *, cast(100 + floor(o_totalprice) % 900 as bigint) a from orders)""")
def page_rows(spark, sf):
    """Whole pages of text to invoice rows: labels, misread letters, VAT, and the buyer's tax id after the seller's."""
    o, k = spread(table(spark, sf, "orders")), F.col("o_orderkey")
    a, c = (100 + F.floor("o_totalprice") % 900).cast("bigint"), F.col("o_custkey").cast("string")
    lit = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    date = F.when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("Ngày O1 tháng l2 năm 2025")
    money = F.when(k % 2 == 0, lit("Cộng tiền hàng: ", a.cast("string"), ".000")).otherwise(lit("Thuế suất GTGT 10% Tiền thuế: ", F.format_number(a * 100, 0), "\nTổng cộng tiền thanh toán: ", F.format_number(a * 1100, 0)))
    page = lit(
        "HÓA ĐƠN GIÁ TRỊ GIA TĂNG\nMã số thuế: 0100000000\nKý hiệu: ", F.when(k % 2 == 0, "K26TAN").otherwise("IK26TAN"), "\nSố: ", F.lpad((k + 10_000).cast("string"), 8, "0"), "\n", date, "\nTên đơn vị mua hàng: Công ty ", c, " MST: 1\nMã số thuế: 03", F.lpad(c, 8, "0"),
        F.when(k % 5 == 0, "").otherwise(lit("\nBiển số xe: 50a 123 ", F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))), "\n1 ", F.when(k % 3 == 0, "Dầu Diezen").otherwise("Xăng RON 95-III"), " Lít\n", money,
    )
    rows = page_fields.extract_rows(o.select(k.alias("o_orderkey"), F.concat(k.cast("string"), F.lit(".pdf")).alias("file"), F.lit(1).alias("page_no"), page.alias("text"), F.lit("text").alias("doc_kind")))
    return rows.select(F.regexp_extract("file", "[0-9]+", 0).cast("bigint").alias("o_orderkey"), "series", "invoice_no", "invoice_date", "pre_tax_amount", "plate", "goods", "buyer_name", "buyer_tax_id")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then null else cast(o_orderkey as varchar) end number, 'K' || cast(o_custkey as varchar) || '*' code from orders")
def lookup_field_extract(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    body = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Số hóa đơn: *"), k.cast("string"), F.lit("*\n"))), F.when(k % 2 == 0, "MÃ TRA CỨU: * ").otherwise("Lookup code - "), F.concat(F.lit("K"), F.col("o_custkey").cast("string")), F.lit("* *"))
    return o.select("o_orderkey", page_fields.lookup_fields(body).alias("x")).select("o_orderkey", "x.number", "x.code")


@query("select c_custkey, case c_custkey % 4 when 0 then 'https://a/2' when 1 then 'https://x.meinvoice.vn/' || cast(c_custkey as varchar) when 2 then 'https://tracuuhd.smartsign.com.vn/?export=pdf' else 'https://vnpt-invoice.com.vn/PDF' end link, case c_custkey % 4 when 1 then 'https://x.meinvoice.vn/tra-cuu/?sc=A%20B' when 3 then 'https://vnpt-invoice.com.vn/getInvoice' end xml from customer")
def supplier_links(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey") % 4
    a = lambda href, text: f'<a href="{href}">{text}</a>'
    body = (
        F.when(k == 0, "<p>" + a("https://a/1", "Link") + " xem <b>x</b></p><p>" + a("https://a/2", "LINK") + " <i>Tải nhanh</i> dạng</p>")
        .when(k == 1, F.concat(F.lit('<p>x</p><a href="https://x.meinvoice.vn/'), F.col("c_custkey").cast("string"), F.lit('"><b>Tra  cứu</b> hóa đơn</a>')))
        .when(k == 2, a("https://tracuuhd.smartsign.com.vn/?x=1", "Link") + a("https://tracuuhd.smartsign.com.vn/?export=pdf", "link")).otherwise(a("https://vnpt-invoice.com.vn/getInvoice", "x") + a("https://vnpt-invoice.com.vn/PDF", "y"))
    )
    domain = F.when(k == 0, "easyinvoice.com.vn").when(k == 1, "meinvoice.vn").when(k == 2, "smartsign.com.vn").otherwise("vnpt-invoice.com.vn")
    d = c.select("c_custkey", html.anchors(body).alias("links"), html.supplier_key(domain, list(html.DOMAIN_RULES)).alias("key"))
    url = F.when(k == 1, "https://x.meinvoice.vn/v?sc=A%20B")
    return d.select("c_custkey", html.invoice_link(F.col("links"), F.col("key")).alias("link"), F.get(html.xml_plan(F.col("key"), url, F.col("links")), F.lit(0))["url"].alias("xml"))


# ---- counts and plans
@query("select p_brand folder, count(*) filter (where p_size % 3 > 0) pdf, count(*) filter (where p_size % 3 = 0) xml, count(*) filter (where p_size % 3 > 0 and p_size > 20) new_pdf from part group by 1")
def folder_counts(spark, sf):
    p = table(spark, sf, "part")
    files = p.select(F.col("p_brand").alias("folder"), F.when(F.col("p_size") % 3 > 0, "PDF").otherwise("xml").alias("suffix"), F.col("p_size").alias("mtime"))
    return work.folder_stats(files, p.select(F.col("p_brand").alias("folder"), F.lit(20).alias("mtime")).distinct()).drop("last_result")


@query("select case when o_orderkey % 4 = 0 then 'petro' when o_orderkey % 4 = 1 then 'no_xml' else 'other' end class, count(*) n from orders group by 1")
def group_counts(spark, sf):
    k = F.col("o_orderkey") % 4
    return work.group_counts(table(spark, sf, "orders").select(F.when(k == 0, "Petrolimex").when(k == 1, "Không có XML (v25)").when(k == 2, "Các hãng khác").alias("group")))


_MOVES_SQL = """
with f as (select p_partkey, 't' || cast(p_partkey % 7 as varchar) target, case when p_partkey % 11 = 0 then 'p' || cast(p_partkey % 300 as varchar) || '_2' else 'p' || cast(p_partkey % 300 as varchar) end stem, 'h' || cast(p_partkey % 4 as varchar) sha1 from part),
t as (select distinct 't' || cast(p_partkey % 7 as varchar) target, case when p_partkey % 2 = 0 then 'p' || cast(p_partkey % 300 as varchar) else 'p' || cast(p_partkey % 300 as varchar) || '_3' end stem, 'h1' sha1 from part where p_size % 10 = 0),
k as (select f.*, t.sha1 there, row_number() over (partition by target, stem order by p_partkey) k, first_value(f.sha1) over (partition by target, stem order by p_partkey) first from f left join t using (target, stem)),
a as (select *, case when there is null and k = 1 then 'move' when sha1 = coalesce(there, first) then 'drop' else 'rename' end act from k),
every as (select target, stem from f union select target, stem from t),
r as (select *, row_number() over (partition by target, stem order by k) r from a where act = 'rename'),
taken as (select s.target, s.stem, list(cast(substr(e.stem, length(s.stem) + 2) as bigint)) taken from (select distinct target, stem from r) s join every e on e.target = s.target and regexp_full_match(e.stem, s.stem || '_[1-9][0-9]*') group by 1, 2)
select p_partkey, act as action, stem || '.pdf' as name from a where act <> 'rename'
union all select p_partkey, 'move', stem || '_' || cast(list_filter(range(2, len(coalesce(taken, [])) + r + 2), lambda x: not list_contains(coalesce(taken, []), x))[r] as varchar) || '.pdf' from r left join taken using (target, stem)
"""


@query(_MOVES_SQL)
def file_moves(spark, sf):
    """Moves of one batch into folders that hold files: names meet in the batch and in the folder, with and without a number, of equal and other content."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    folder, stem = F.concat(F.lit("t"), (k % 7).cast("string")), F.concat(F.lit("p"), (k % 300).cast("string"))
    files = p.select(k.alias("p_partkey"), F.when(k % 11 == 0, F.concat(stem, F.lit("_2"))).otherwise(stem).alias("stem"), F.lit("pdf").alias("suffix"), F.concat(F.lit("h"), (k % 4).cast("string")).alias("sha1"), folder.alias("target"))
    there = p.where("p_size % 10 = 0").select(folder.alias("folder"), F.when(k % 2 == 0, stem).otherwise(F.concat(stem, F.lit("_3"))).alias("stem"), F.lit("pdf").alias("suffix"), F.lit("h1").alias("sha1")).distinct()
    return work.move_plan(files, there, "p_partkey").select("p_partkey", "action", "name")


@query("select lower(id) key, min(id) id, bool_or(s = 0) builtin, bool_or(s = 1) in_config, bool_or(s = 2) custom, coalesce(arg_max(nullif(email, ''), s) filter (where email <> ''), '') email from (select 'N' || cast(n_nationkey as varchar) id, 0 s, '' email from nation union all select 'n' || cast(n_nationkey as varchar), 1, case when n_nationkey % 2 = 0 then 'c' else '' end from nation where n_nationkey % 3 > 0 union all select 'n' || cast(n_nationkey as varchar), 2, case when n_nationkey % 5 = 0 then 'u' else '' end from nation where n_nationkey % 4 > 0) group by 1")
def profile_sources(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    ids = lambda p, keep, email: n.where(keep).select(F.concat(F.lit(p), k.cast("string")).alias("id"), email.alias("email"))
    out = work.profiles(ids("N", F.lit(True), F.lit("")), ids("n", k % 3 > 0, F.when(k % 2 == 0, "c").otherwise("")), ids("n", k % 4 > 0, F.when(k % 5 == 0, "u").otherwise("")))
    return out.select(F.lower("id").alias("key"), "id", "builtin", "in_config", "custom", "email")


@query(f"with {_MESSAGES_SQL} select updated_at, status, '' supplier, coalesce(reason, '') reason, cast(attempts as varchar) attempts, case when event_id % 2 = 0 then 'a; b' else '' end files, 'https://mail.google.com/mail/u/0/#all/' || message_id link, message_id from m")
def ledger_csv_rows(spark, sf):
    m = messages(spark, sf).withColumns({"supplier": F.lit(None).cast("string"), "mail_date": F.lit(""), "subject": F.lit(""), "saved_count": F.lit(0), "files": F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))})
    return work.ledger_csv(m).drop("mail_date", "subject", "saved_count")
