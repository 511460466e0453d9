"""More queries over the driver's tables: reports, file matching, message scans and single fields, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, money, page_fields, text
from ..operators import dedupe, filenames, ledger, reconcile, reports, work
from ..operators import lookups as lookup_ledger
from ..sources import files, messages
from . import catalog
from .catalog import _LOOKUP_ROWS_SQL, _MESSAGES_SQL, lookup_rows, query, table


# ---- ledger reports
@query(f"""with {_MESSAGES_SQL}
select 'status' section, status label, null message_id, count(*) n, false exhausted from m group by 2
union all select 'open', status, message_id, attempts, attempts >= 3 from m where status in ('FAILED', 'PENDING')
union all select 'skipped', coalesce(reason, ''), null, n, false from (select reason, count(*) n from m where status = 'SKIPPED' group by 1)""")
def ledger_report(spark, sf):
    return reports.ledger_report(catalog.messages(spark, sf))


@query(f"""with {_MESSAGES_SQL}, {_LOOKUP_ROWS_SQL.strip()}
select a.*, b.* from (select count(*) filter (where status = 'DONE') done, count(*) filter (where status = 'FAILED') failed, count(*) filter (where status = 'SKIPPED') skipped, count(*) filter (where status = 'PENDING') pending, max(updated_at) last_run from m) a,
  (select count(*) lookups, count(*) filter (where pdf_status = 'DONE') lookups_done, count(*) filter (where pdf_status = 'DUPLICATE') duplicates, count(*) filter (where coalesce(pdf_status, 'PENDING') in ('PENDING', 'FAILED')) todo from l) b""")
def status_card(spark, sf):
    return reports.status_card(catalog.messages(spark, sf), lookup_rows(spark, sf))


@query(f"with {_MESSAGES_SQL}, r as (select *, case when event_id % 3 = 0 then 'SCAN_READ_ERROR: x' else reason end why, cast(event_id % 14 as int) tries from m) select message_id, case when status = 'DONE' then 'skip' when status = 'SKIPPED' then 'include' when status = 'FAILED' and tries >= case when event_id % 3 = 0 then 10 else 3 end then 'skip' else 'include' end decision from r")
def partition_read_errors(spark, sf):
    """Reading errors are tried longer; skipped ones once more, as asked."""
    k = F.col("event_id")
    m = catalog.messages(spark, sf).withColumns({"reason": F.when(k % 3 == 0, "SCAN_READ_ERROR: x").otherwise(F.col("reason")), "attempts": (k % 14).cast("int")})
    return m.select("message_id", ledger.decision(reprocess=True).alias("decision"))


@query(f"with {_MESSAGES_SQL} select 'm' || cast(user_id as varchar) message_id, 'DONE' status, 'S' reason from (select distinct user_id from m where event_id % 3 = 0 and user_id not in (select user_id from m where event_id % 97 = 1))")
def seed_rows(spark, sf):
    """Ids that the ledger lacks, seeded once each."""
    m = catalog.messages(spark, sf).withColumn("message_id", F.concat(F.lit("m"), F.col("user_id").cast("string")))
    return ledger.seed_events(m.where("event_id % 3 = 0"), m.where("event_id % 97 = 1"), "S", 1, "t").select("message_id", "status", "reason")


@query("select event_id, case when event_id % 4 = 3 and event_id % 5 <> 0 then 'SKIPPED' when event_id % 4 = 0 then 'DONE' when event_id % 4 = 1 then 'FAILED:invoice_no' when event_id % 4 = 2 then 'FAILED:lookup_code' else 'FAILED:invoice_no, lookup_code' end outcome from events")
def intake_outcome(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events")
    return e.select("event_id", ledger.intake(F.when(k % 4 % 2 == 0, "7").otherwise(" "), F.when(k % 4 < 2, "K").otherwise(""), k % 5 == 0).alias("outcome"))


@query(f"with {_LOOKUP_ROWS_SQL} select message_id, not no_code and number <> '' complete, case when no_code then 'NONE' when pdf_status = 'DONE' then 'f' else 'NOT_YET' end pdf from l where coalesce(pdf_status, '') <> 'DUPLICATE'")
def lookup_export(spark, sf):
    return reports.lookup_export(lookup_rows(spark, sf)).select("message_id", "complete", "pdf")


@query(f"""with {_LOOKUP_ROWS_SQL}, master as (select distinct 'K' || cast(s_suppkey as varchar) code, case when s_suppkey % 2 = 0 then '' else '2' end number from supplier),
f as (select * from l where pdf_status = 'DONE' and not no_code and synced = 0 and not exists (select 1 from master m where m.code = l.code and (m.number = '' or l.number = '' or m.number = l.number)))
select arg_min(message_id, mail_date || message_id) message_id, code, number from f group by code, number""")
def master_additions(spark, sf):
    k = F.col("s_suppkey")
    master = table(spark, sf, "supplier").select(F.concat(F.lit("k"), k.cast("string"), F.lit("**")).alias("code"), F.when(k % 2 == 0, "").otherwise("002").alias("number"))
    return reports.master_additions(lookup_rows(spark, sf), master).select("message_id", "code", "number")


@query("""with n as (select event_id seq, user_id email_id, case when event_id % 4 = 0 then '' when event_id % 4 = 1 then 'LINKED_PDF x' when event_id % 4 = 2 then 'NO_PDF' else 'ATTACHED_PDF' end kind,
  case when user_id % 3 = 0 and event_id % 2 = 0 then 'f' || cast(event_id % 6 as varchar) end file, case when user_id % 5 = 0 and event_id % 7 = 0 then 'e' || cast(event_id as varchar) end error from events),
g as (select email_id, coalesce(arg_min(kind, seq) filter (where kind <> ''), '') kind, count(file) files, count(error) errors, string_agg(error, ' | ' order by seq) error from n group by 1)
select cast(email_id as varchar) email_id, case when errors > 0 then 'XML_ERROR' else 'NO_XML' end status, kind, substr(coalesce(error, ''), 1, 500) error,
  case when errors > 0 then 'RUN_AGAIN' when starts_with(kind, 'LINKED_PDF') then 'NOT_SENT_NOR_LINKED' when kind = 'NO_PDF' then 'NEITHER_PDF_NOR_XML' else 'PDF_WITHOUT_XML' end hint from g where errors > 0 or files = 0""")
def missing_xml(spark, sf):
    e = table(spark, sf, "events")
    k, u = F.col("event_id"), F.col("user_id")
    notes = e.select(
        k.alias("event_seq"), u.cast("string").alias("email_id"), F.when(k % 4 == 0, "").when(k % 4 == 1, "LINKED_PDF x").when(k % 4 == 2, "NO_PDF").otherwise("ATTACHED_PDF").alias("kind"),
        F.when((u % 3 == 0) & (k % 2 == 0), F.concat(F.lit("f"), (k % 6).cast("string"))).alias("file"), F.lit(None).cast("string").alias("pdf"), F.when((u % 5 == 0) & (k % 7 == 0), F.concat(F.lit("e"), k.cast("string"))).alias("error"),
    )
    m = catalog.messages(spark, sf).withColumns({"supplier": F.lit(""), "mail_date": F.lit(""), "subject": F.lit("")})
    return reports.missing_xml(notes, m).select("email_id", "status", "kind", "error", "hint")


@query("select count(*) filter (where f > 0) ok, count(*) filter (where f = 0 and e = 0) \"none\", count(*) filter (where e > 0) error from (select user_id, count(*) filter (where event_id % 40 = 0) f, count(*) filter (where event_id % 50 = 7) e from events group by 1)")
def xml_presence(spark, sf):
    k = F.col("event_id")
    return work.xml_presence(table(spark, sf, "events").select(F.col("user_id").alias("email_id"), F.when(k % 40 == 0, "f").alias("file"), F.when(k % 50 == 7, "e").alias("error")))


_ISSUES_SQL = f"""
with {_MESSAGES_SQL}, r as (select cast(user_id as varchar) id, arg_max(status, event_id) status, arg_max(coalesce(reason, '~'), event_id) reason from m group by 1),
k as (select cast(c_custkey as varchar) id, case when c_custkey % 4 = 0 then '' else 'K' || cast(c_custkey as varchar) end code, case c_custkey % 6 when 0 then 'DONE' when 1 then 'DUPLICATE' when 2 then 'FAILED' end state, c_custkey % 5 missing from customer),
i as (select case status when 'FAILED' then 'ERROR' else status end kind, r.id message_id, coalesce(case when k.state is null or k.state <> 'DUPLICATE' then code end, '') lookup_code, case reason when '~' then '' else reason end reason from r left join k using (id) where status <> 'DONE'
  union all select 'LOOKUP_WITHOUT_PDF', id, code, case when state is null then 'NOT_DOWNLOADED' when missing >= 3 then 'NOT_FOUND_GIVEN_UP' else 'DOWNLOAD_FAILED' end from k where code <> '' and coalesce(state, '') not in ('DONE', 'DUPLICATE') and not exists (select 1 from r where r.id = k.id and r.status <> 'DONE'))
"""


def _issues(spark, sf):
    m = catalog.messages(spark, sf).select(F.col("user_id").cast("string").alias("message_id"), "status", "reason", F.col("event_id").alias("event_seq"))
    about = m.select("message_id", F.lit("").alias("supplier"), F.lit("").alias("mail_date"), F.lit("").alias("subject")).distinct()
    k, text_ = F.col("c_custkey"), lambda c: c.cast("string")
    known = table(spark, sf, "customer").select(
        text_(k).alias("message_id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("K"), text_(k))).alias("lookup_code"), F.when(k % 6 == 0, "DONE").when(k % 6 == 1, "DUPLICATE").when(k % 6 == 2, "FAILED").alias("pdf_status"), (k % 5).cast("int").alias("pdf_not_found"),
        F.lit("").alias("invoice_no"), F.lit("").alias("header_date"), F.lit("").alias("mail_date"), F.lit("").alias("subject"),
    )
    return reports.issues(ledger.run_issues(m), about, known, [("R1", "one")], "look")


@query(f"{_ISSUES_SQL} select kind, message_id, lookup_code, reason from i")
def issue_rows(spark, sf):
    """Issues of a run, and lookups without a file that are not among them."""
    return _issues(spark, sf).select("kind", "message_id", "lookup_code", "reason")


@query(f"{_ISSUES_SQL} select kind, count(*) n from i group by 1")
def issue_kinds(spark, sf):
    return work.issue_counts(_issues(spark, sf))


_TREE_SQL = """
with recursive raw as (select c_custkey id, '{"payload":' || (case c_custkey % 5 when 0 then leaf when 1 then one when 2 then two when 3 then '{"mimeType":"multipart/mixed","parts":[' || two || ',' || leaf || ',' || one || ']}' else '{"broken' end) || '}' j from (
  select *, '{"mimeType":"multipart/related","parts":[' || one || ',' || leaf || '],"body":{"data":"Yg"}}' two from (
    select *, '{"mimeType":"multipart/alternative","parts":[' || leaf || ',{"filename":"' || c_name || '.pdf","mimeType":"application/pdf","body":{"size":' || cast(c_custkey as varchar) || '}}],"body":{"data":"YQ"}}' one from (
      select *, '{"mimeType":"text/plain","body":{"data":"' || translate(base64(encode(c_name)), '+/=', '-_') || '"}}' leaf from customer)))),
w as (select id, []::integer[] path, json_extract(j, '$.payload') node from raw where json_valid(j)
  union all select id, list_append(path, i::integer), json_extract(node, '$.parts[' || i || ']') from (select id, path, node, unnest(range(json_array_length(node, '$.parts')::bigint)) i from w where json_array_length(node, '$.parts') > 0)),
k as (select *, coalesce(json_array_length(node, '$.parts'), 0) below from w)
select raw.id message_id, coalesce(p.parts, '') parts, coalesce(p.named, 0) named from raw left join (
  select id, string_agg(array_to_string(path, '.') || ':' || coalesce(json_extract_string(node, '$.mimeType'), '') || ':' || coalesce(json_extract_string(node, '$.body.data'), ''), ' ' order by list_append(path, 2147483647)) parts,
    count(*) filter (where json_extract_string(node, '$.filename') <> '') named from k where len(path) > 0 or below = 0 group by id) p using (id)
"""


@query(_TREE_SQL)
def message_trees(spark, sf):
    """Messages as trees of one to four levels, and broken ones: their parts in order, what is in a part before the part."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    leaf = cat('{"mimeType":"text/plain","body":{"data":"', F.translate(F.base64(F.col("c_name").cast("binary")), "+/=", "-_"), '"}}')
    one = cat('{"mimeType":"multipart/alternative","parts":[', leaf, ',{"filename":"', F.col("c_name"), '.pdf","mimeType":"application/pdf","body":{"size":', k.cast("string"), '}}],"body":{"data":"YQ"}}')
    two = cat('{"mimeType":"multipart/related","parts":[', one, ",", leaf, '],"body":{"data":"Yg"}}')
    tree = F.when(k % 5 == 0, leaf).when(k % 5 == 1, one).when(k % 5 == 2, two).when(k % 5 == 3, cat('{"mimeType":"multipart/mixed","parts":[', two, ",", leaf, ",", one, "]}")).otherwise('{"broken')
    m = messages.flatten_trees(c.select(k.alias("id"), cat('{"payload":', tree, "}").alias("raw")))
    shown = F.array_join(F.transform("parts", lambda p: F.concat(p["path"], F.lit(":"), p["mime"], F.lit(":"), F.coalesce(p["data_b64url"], F.lit("")))), " ")
    return m.select(F.col("id").alias("message_id"), shown.alias("parts"), F.size(F.filter("parts", lambda p: p["filename"] != "")).cast("long").alias("named"))


# ---- files and names
@query("""select p_partkey, case when p_partkey % 4 = 0 then 'p' || cast(p_partkey as varchar) when p_partkey % 4 = 1 then 'x_C26TAA_00' || cast(p_partkey + 1000 as varchar) when p_partkey % 4 = 2 then 'y ' || cast(p_partkey + 1000 as varchar) else 'p' || cast(p_partkey as varchar) end pdf_stem from part""")
def xml_to_pdf_names(spark, sf):
    """Files by the same name, by series and number, by number, or none."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    own = F.concat(F.lit("p"), k.cast("string"))
    rows = p.select("p_partkey", own.alias("xml_stem"), F.lit("1C26TAA").alias("series"), F.concat(F.lit("00"), (k + 1000).cast("string")).alias("invoice_no"))
    by_both, by_number = F.concat(F.lit("x_C26TAA_00"), (k + 1000).cast("string")), F.concat(F.lit("y "), (k + 1000).cast("string"))
    stems = p.where(k % 4 == 0).select(own.alias("stem"), k.alias("ord")).union(p.where(k % 4 == 1).select(by_both, k)).union(p.where(k % 4 == 1).select(by_number, k)).union(p.where(k % 4 == 2).select(by_number, k))
    return filenames.match_stems(rows, stems).select("p_partkey", "pdf_stem")


@query("select p_partkey, case when p_partkey % 3 = 0 then 'DUPLICATE' when p_partkey % 3 = 1 then 'XML' else 'NO_XML' end target from (select p_partkey + 1000 p_partkey, p_size from part) where p_size > 10")
def layout_split(spark, sf):
    """Files of an XML row, files whose name repeats one, and others; old files are left out."""
    p, k = table(spark, sf, "part").withColumn("p_partkey", F.col("p_partkey") + 1000), F.col("p_partkey")
    stem = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    name = F.when(k % 3 == 0, F.concat(F.lit("copy C26TAA-"), (k + 100_000).cast("string"))).when(k % 3 == 1, stem("own", k)).otherwise(stem("other", k))
    rows = p.where(k % 3 == 1).select(stem("own", k).alias("file_stem"), k.alias("ord"), F.lit("1C26TAA").alias("series"), k.cast("string").alias("invoice_no"))
    rows = rows.union(p.where(k % 3 == 0).select(stem("there", k), k, F.lit("1C26TAA"), (k + 100_000).cast("string")))
    out = reports.layout_split(p.select(k.alias("p_partkey"), name.alias("stem"), F.col("p_size").alias("mtime")), rows, rows.select(F.col("file_stem").alias("stem")), epoch=11)
    return out.select("p_partkey", "target")


_NAMES_SQL = """
with f as (select p_partkey id, p_brand folder, case p_size % 5 when 0 then 'n' when 1 then 'n_' || cast(p_size % 7 as varchar) when 2 then 'n_1_1' else 'n' end stem, case when p_size % 3 = 0 then '' else '.pdf' end ext from part),
t as (select distinct p_brand folder, case when p_size = 50 then 'n' else 'n_3' end stem, '.pdf' ext from part where p_size in (49, 50)),
a as (select f.*, t.folder is not null held, row_number() over (partition by folder, stem, ext order by id) k from f left join t using (folder, stem, ext)),
every as (select folder, stem, ext from f union select folder, stem, ext from t),
r as (select *, k - case when held then 0 else 1 end r from a where held or k > 1),
taken as (select s.folder, s.stem, s.ext, list(cast(substr(e.stem, length(s.stem) + 2) as bigint)) taken from (select distinct folder, stem, ext from r) s join every e on e.folder = s.folder and e.ext = s.ext and regexp_full_match(e.stem, s.stem || '_[1-9][0-9]*') group by 1, 2, 3)
select id p_partkey, stem || ext unique_name from a where not held and k = 1
union all select id, stem || '_' || cast(list_filter(range(1, len(coalesce(taken, [])) + r + 1), lambda x: not list_contains(coalesce(taken, []), x))[r] as varchar) || ext from r left join taken using (folder, stem, ext)
"""


@query(_NAMES_SQL)
def unique_names(spark, sf):
    """Names that end in numbers, with and without a suffix, in folders that hold some of them."""
    p, size = table(spark, sf, "part"), F.col("p_size")
    stem = F.when(size % 5 == 1, F.concat(F.lit("n_"), (size % 7).cast("string"))).when(size % 5 == 2, "n_1_1").otherwise("n")
    names = p.select("p_partkey", F.col("p_brand").alias("folder"), F.concat(stem, F.when(size % 3 == 0, "").otherwise(".pdf")).alias("name"))
    there = p.where("p_size in (49, 50)").select(F.col("p_brand").alias("folder"), F.when(size == 50, "n.pdf").otherwise("n_3.pdf").alias("name"))
    return dedupe.numbered_names(names, order="p_partkey", present=there).select("p_partkey", "unique_name")


@query("select p_partkey, case when n = 1 then 'b' || p_brand else 'b' || p_brand || '_p' || cast(rn as varchar) end \"alias\" from (select *, count(*) over (partition by p_brand) n, row_number() over (partition by p_brand order by lpad(cast(p_partkey as varchar), 9, '0')) rn from part)")
def page_aliases(spark, sf):
    p = table(spark, sf, "part")
    f = p.select("p_partkey", F.concat(F.lit("/in/b"), F.col("p_brand")).alias("folder"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("stem"), F.lit("pdf").alias("suffix")).withColumn("name", F.concat("stem", F.lit(".pdf")))
    return files.page_inputs(f, "/in").select("p_partkey", "alias")


@query("select o_orderkey, cast(o_orderkey + 1000 as varchar) number, o_orderkey % 2 = 0 official, cast(o_orderkey % 9 + 1 as int) page from orders")
def file_name_fields(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "HDGTGT_K26TAA_").otherwise("x-C26TAB 00"), (k + 1000).cast("string"), F.lit("_p"), (k % 9 + 1).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", page_fields.file_number(F.concat(F.lit("/a/"), name, F.lit(".pdf")), F.lit("")).alias("number"), page_fields.official_file(F.concat(name, F.lit(".pdf"))).alias("official"), page_fields.page_number(name).alias("page"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'T0' when 1 then '0300000001' end new_tax_id, case c_custkey % 4 when 0 then 'BY_NAME,WAS_BLANK' when 1 then 'BY_FILE,REPLACED' end why from customer where c_custkey % 4 < 2")
def tax_id_fixes(spark, sf):
    """Tax ids by the beginning of a name, by the one known id in a file's name, and conflicts, which stay."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(
        F.concat(k.cast("string"), F.lit("x"), F.when(k % 4 == 1, "0300000001 0399999999").when(k % 4 == 2, "0300000001").otherwise("")).alias("file"), F.when(k % 4 == 0, "CONG TY A X").when(k % 4 == 1, "").when(k % 4 == 2, "CONG TY A").otherwise("OTHER").alias("name"),
        F.when(k % 4 == 1, "0311111111").otherwise("").alias("tax_id"),
    )
    names = spark.createDataFrame([("CONG TY A", "T0", 1), ("CONG TY", "T1", 2)], "key string, tax_id string, ordinal int")
    known = spark.createDataFrame([("0300000001",), ("0300000002",)], "tax_id string")
    return reports.tax_id_fixes(rows, names, known).select(F.regexp_extract("file", "^[0-9]+", 0).cast("bigint").alias("c_custkey"), "new_tax_id", "why")


# ---- messages
@query("select cast(c_custkey as varchar) id, c_custkey % 3 = 0 has_pdf, case when c_custkey % 3 = 1 then 'bill-host.com.vn' when c_custkey % 3 = 2 then 'mail.shop.vn' end supplier, c_custkey % 2 = 0 keyword_hit, case when c_custkey % 3 > 0 then 'see mail.shop.vn ' || case when c_custkey % 3 = 1 then 'at abc.bill-host.com.vn' else '' end || chr(10) end content from customer")
def message_scan(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    body = F.concat(F.lit("see mail.shop.vn "), F.when(k % 3 == 1, "at abc.bill-host.com.vn").otherwise(""))
    part = lambda path, name, mime, data: F.struct(F.lit(path).alias("path"), name.alias("filename"), F.lit(mime).alias("mime"), F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("string").alias("attachment_id"), data.alias("data_b64url"))
    none = F.lit(None).cast("string")
    m = c.select(
        k.cast("string").alias("id"), F.array().cast("array<string>").alias("label_ids"), F.lit(0).cast("bigint").alias("internal_date_ms"), F.when(k % 2 == 0, "Hóa Đơn mới").otherwise("x").alias("subject"), F.lit("a@b").alias("sender"), F.lit("").alias("date_header"),
        F.array(part("0", F.lit(""), "text/plain", F.translate(F.base64(body.cast("binary")), "+/", "-_")), part("1", F.when(k % 3 == 0, "A.PDF").otherwise("b.xml"), "application/x", none)).alias("parts"),
    )
    return messages.scan(m, ["bill-host"], ["hóa đơn"]).select("id", "has_pdf", "supplier", "keyword_hit", "content")


@query("select c_custkey, case c_custkey % 4 when 0 then 'bad_captcha' when 1 then 'not_found' when 2 then 'message' end reply, 'CTY SO ' || cast(c_custkey as varchar) name, case when c_custkey % 5 = 0 then 9 when c_custkey % 5 = 1 then 2 else c_custkey % 5 end::int bounded from customer")
def text_fields(spark, sf):
    """Reply classes, names without labels, bounded numbers."""
    k = F.col("c_custkey")
    reply = F.when(k % 4 == 0, "Mã xác nhận KHÔNG đúng").when(k % 4 == 1, "Không tồn tại hóa đơn").when(k % 4 == 2, "Lỗi").otherwise("  ")
    n = F.when(k % 5 == 0, "x").otherwise((k % 5).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", text.reply_class(reply).alias("reply"), text.name_key(F.concat(F.lit("Tên đơn vị mua hàng: CTY  số-"), k.cast("string"))).alias("name"), text.clamp(n, 2, 4, 9).alias("bounded"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then '1C26TAA' else '1K26TXN' end series, cast(o_orderkey + 10000 as varchar) number from orders")
def header_identity(spark, sf):
    """Series and number of a header whose letters were misread."""
    k = F.col("o_orderkey")
    number = F.translate((k + 10_000).cast("string"), "015", "OIS")
    head = F.concat(F.when(k % 3 == 0, "Ký hiệu: 1C26TAA").when(k % 3 == 1, "IX26TXN mau").otherwise("KY HIEU: 1K28TXN"), F.lit("\nMST: 0301234567\nSố: "), number)
    return table(spark, sf, "orders").select("o_orderkey", page_fields.header_identity(head).alias("x")).select("o_orderkey", "x.series", "x.number")


@query("select o_orderkey, (o_orderkey % 9 + 1) * 1000000 + (o_orderkey % 8 + 2) * 10000 + (o_orderkey % 7 + 1) * 100 words from orders")
def number_words(spark, sf):
    k = F.col("o_orderkey")
    digits = ["một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]
    word = lambda n: F.get(F.array(*map(F.lit, digits)), n.cast("int"))
    line = F.concat(F.lit("Số tiền bằng chữ: "), word(k % 9), F.lit(" triệu "), word(k % 8 + 1), F.lit(" mươi nghìn "), word(k % 7), F.lit(" trăm đồng chẵn./."))
    return table(spark, sf, "orders").select("o_orderkey", money.words_amount(line).alias("words"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'Xăng RON 95' when o_orderkey % 3 = 1 then 'Dầu Diezen' end item, case when o_orderkey % 2 = 0 then 'Xang' else 'Dau' end named from orders")
def goods_items(spark, sf):
    """Goods of a page's table, below its header, and of its text."""
    k = F.col("o_orderkey")
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    item = F.when(k % 3 == 0, "Xăng RON 95").when(k % 3 == 1, "Dầu Diezen").otherwise("STT")
    t = F.array(row("Dầu trước", "1"), row("STT", "Tên hàng hóa, dịch vụ"), row("A", "B"), row("1", "2"), row("1", item, "Lít"), row("2", "Khác nữa", ""))
    return table(spark, sf, "orders").select("o_orderkey", page_fields.table_goods(t).alias("item"), page_fields.goods_name(F.when(k % 2 == 0, "1 Xãng R0N95").otherwise("| Dầu Dlezen |")).alias("named"))


@query("""select o_orderkey, case when o_orderkey % 4 in (0, 1) then 'Xăng' else 'Dầu' end goods, case when o_orderkey % 3 = 0 then 700000 else 500000 end pre_tax_amount, case when o_orderkey % 5 = 0 then '12345' else '54321' end invoice_no,
  case when o_orderkey % 4 = 0 or o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 'text+image' else 'text' end provenance from orders""")
def second_reading(spark, sf):
    """Fields that need a better value take a second reading's; override rules come last."""
    k = F.col("o_orderkey")
    review = F.lit("Cần kiểm tra")
    base = dict(buyer_name=F.lit("Cong ty"), buyer_tax_id=F.lit("1"), series=F.lit("S"), invoice_date=F.lit("01/01/2026"), plate=F.lit("P"))
    rows = table(spark, sf, "orders").select(k.alias("o_orderkey"), *[v.alias(n) for n, v in base.items()], F.when(k % 4 == 0, review).when(k % 4 == 1, "Khác").otherwise("Dầu").alias("goods"), F.when(k % 3 == 0, 5).otherwise(500000).alias("pre_tax_amount"), F.when(k % 5 == 0, "0").otherwise("54321").alias("invoice_no"), F.lit("text").alias("provenance"))
    second = rows.select("o_orderkey", *base, F.lit("Xăng").alias("goods"), F.lit(700000).alias("pre_tax_amount"), F.lit("12345").alias("invoice_no"))
    out = page_fields.merge_reading(rows, second, ("o_orderkey",), 2026, "image")
    out = page_fields.apply_overrides(out, [{"target": "goods", "value": "Xăng", "when": {"goods": "Khác", "series": "S*"}}, {"target": "goods", "value": "no", "when": {"goods": "never"}}])
    return out.select("o_orderkey", "goods", "pre_tax_amount", "invoice_no", "provenance")


@query("select o_orderkey, o_orderkey % 3 = 0 override, case when o_orderkey % 2 = 0 then '50F-123.45' else '50E-123.45' end plate, o_orderkey % 2 = 0 differ from orders")
def word_and_plate_checks(spark, sf):
    k = F.col("o_orderkey")
    words = F.when(k % 3 == 0, 7234567).when(k % 3 == 1, 1234568).otherwise(1234567)
    alias = F.when(k % 2 == 0, "50F-123-45_p2").otherwise("51F-999-99")
    return table(spark, sf, "orders").select("o_orderkey", extract.word_override(F.lit(1234567), words).alias("override"), page_fields.plate_with_alias(F.lit("50E-123.45"), alias).alias("plate"), page_fields.plates_differ_ef(F.lit("50E-123.45"), F.when(k % 2 == 0, "50F-123.45").otherwise("50E-123.46")).alias("differ"))


# ---- ids, sets, groups
@query("select id, source_rank from (select *, row_number() over (partition by s, n order by source_rank, id) rn from (select o_orderkey id, cast(o_orderkey % 3 as int) source_rank, year(o_orderdate) s, o_custkey % 997 + 1 n from orders where o_orderkey % 3 < 2 or o_orderkey % 4 = 0)) where rn = 1")
def consolidated(spark, sf):
    """Groups in order of priority; rows of the last count only while their file is there."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("id"), (k % 3).alias("r"), F.concat(F.lit("f"), k.cast("string"), F.lit("_p2")).alias("file_stem"), F.year("o_orderdate").cast("string").alias("series"), (F.col("o_custkey") % 997 + 1).cast("string").alias("invoice_no"), F.lit("B").alias("buyer_name"), F.lit("").alias("buyer_tax_id"), F.lit("").alias("seller_tax_id"))
    present = o.where(k % 4 == 0).select(F.concat(F.lit("f"), k.cast("string")).alias("stem"))
    out = reports.consolidated([(n, rows.where(F.col("r") == i).drop("r")) for i, n in enumerate(("Petro", "other", "Không"))], ["id"], "id", present=present)
    return out.select("id", "source_rank")


@query("select lpad(cast(o_orderkey as varchar), 9, '0') id from orders where o_orderkey % 6 = 0 and o_orderkey % 4 <> 0")
def migrated_codes(spark, sf):
    """Hand-typed rows of one ledger that another lacks."""
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, F.when(k % 4 == 0, "nhap-tay-").otherwise("NHAP-tay-")).otherwise("m"), F.lpad(k.cast("string"), 9, "0"))
    o = table(spark, sf, "orders")
    new, _ = lookup_ledger.migrate(o.where(k % 3 == 0).select(name.alias("message_id")), o.where(k % 4 == 0).select(name.alias("message_id")))
    return new.select(F.substring("message_id", 10, 9).alias("id"))


@query(f"with {_LOOKUP_ROWS_SQL} select message_id from l where not no_code and coalesce(pdf_status, 'PENDING') not in ('DONE', 'DUPLICATE') and k % 2 = 0 order by mail_date desc, message_id limit 100")
def next_downloads(spark, sf):
    """The newest pending lookups of chosen messages."""
    only = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("message_id"))
    return lookup_ledger.next_batch(lookup_rows(spark, sf), 100, only).select("message_id")


@query("select code, list_sort(list(distinct number)) numbers from (select 'K' || cast(o_custkey % 97 as varchar) code, case when o_orderkey % 5 = 0 then '' else cast(o_orderkey % 7 + 1 as varchar) end number from orders) group by 1")
def known_codes(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.concat(F.lit(" k"), (F.col("o_custkey") % 97).cast("string"), F.lit("* ")).alias("code"), F.when(k % 5 == 0, "000").otherwise(F.concat(F.lit("00"), (k % 7 + 1).cast("string"))).alias("number"))
    return reconcile.known_codes(o)


@query("select max(p_partkey) filter (where p_size % 3 = 0) \"last\", count(*) \"rows\" from part")
def last_filled_row(spark, sf):
    p = table(spark, sf, "part").withColumns({"code": F.when(F.col("p_size") % 6 == 0, "x"), "number": F.when(F.col("p_size") % 6 == 3, 1)})
    return reconcile.last_filled(p, "p_partkey", "code", "number")


# ---- single values and small tables
@query("select c_custkey, case when c_custkey % 3 = 0 then 'a b' else 'ab' end cleaned, case when c_custkey % 2 = 0 then 'see  end' else 'see https://x.vn/a end' end urls, 'k' || cast(c_custkey as varchar) decoded, 'a_b_' || cast(c_custkey as varchar) safe, case when c_custkey % 4 = 0 then 'b.c.vn' else 'c.vn' end root from customer")
def text_cleaning(spark, sf):
    """White space and quotes, marked URLs, base64 with URL letters, file names, root domains."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    urls = F.concat(F.lit("see "), F.when(k % 2 == 0, "https://x.gov.vn/a?b").otherwise("https://x.vn/a"), F.lit(" end"))
    return table(spark, sf, "customer").select(
        "c_custkey", text.clean(F.when(k % 3 == 0, ' "a \n b" ').otherwise("ab\t")).alias("cleaned"), text.drop_marker_urls(urls, "gov.vn").alias("urls"), text.base64url(F.translate(F.base64(F.concat(F.lit("k"), s).cast("binary")), "+/", "-_")).cast("string").alias("decoded"),
        text.safe_name(F.concat(F.lit("a:b?"), s)).alias("safe"), text.root_domain(F.when(k % 4 == 0, "A.b.c.vn").otherwise("c.vn")).alias("root"),
    )


@query("select c_custkey, case c_custkey % 4 when 0 then true when 1 then true when 2 then true else false end suspicious, case c_custkey % 3 when 0 then '1K26TAN' when 1 then '1C26TAA' end series, c_custkey % 5 in (0, 1) valid from customer")
def value_checks(spark, sf):
    k = F.col("c_custkey")
    number = F.when(k % 4 == 0, "123").when(k % 4 == 1, "0301234").when(k % 4 == 2, None).otherwise("12345")
    ser = F.when(k % 3 == 0, "lk26fan").when(k % 3 == 1, "IC26TAA").otherwise("zz")
    goods = F.when(k % 5 == 0, "Xăng RON 95").when(k % 5 == 1, "Dầu").when(k % 5 == 2, "12.345").when(k % 5 == 3, "STT").otherwise("abc")
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(extract.suspicious_number(number), F.lit(True)).alias("suspicious"), page_fields.normal_series(ser).alias("series"), (page_fields.valid_goods(goods) | (goods == "Dầu")).alias("valid"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then '0301234567_1C26TAA_' || cast(o_orderkey as varchar) || '.pdf' when o_orderkey % 3 = 0 then 'own.pdf' else 'x_invoice.pdf' end pdf, case when o_orderkey % 2 = 0 then 'C26TAA_' || cast(o_orderkey as varchar) || '.xml' else 'f.xml' end xml, case when o_orderkey % 2 = 0 then 'https://tracuuhdc.smartsign.com.vn/hddt/?code=' || cast(o_orderkey as varchar) || '%2F&xdb=1' else 'https://t.vn/x' end clicked from orders")
def download_names(spark, sf):
    from ..functions import html

    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    page = F.when(k % 2 == 0, F.concat(F.lit("Ký hiệu: 1C26TAA\nSố: "), s, F.lit("\nMST 0301234567"))).otherwise("nothing")
    content = F.when(k % 2 == 0, F.concat(F.lit("<HDon><KHHDon>C26TAA</KHHDon><SHDon> "), s, F.lit("</SHDon>"))).otherwise("<a/>")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://t.vn/x?y=1&code="), s, F.lit("%2F"))).otherwise("https://t.vn/x")
    name = page_fields.download_name(page_fields.quick_info(page), F.when(k % 3 == 0, "own.pdf").otherwise(" "), F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("pdf"), page_fields.xml_name(content, F.lit("f.xml")).alias("xml"), html.clicked_url(url).alias("clicked"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'ui' || cast(c_nationkey as varchar) when c_nationkey < 20 then 'base' || cast(c_nationkey as varchar) else c_name end buyer_name from customer")
def overlay_units(spark, sf):
    """Units by tax id: a table laid over another, then the name that was read."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    tax = lambda p, k: F.concat(F.lit(p), F.lpad(k.cast("string"), 9, "0"))
    over = n.select(tax("1", F.col("n_nationkey")).alias("tax_id"), F.concat(F.lit("ui"), F.col("n_nationkey").cast("string")).alias("unit"))
    base = n.where("n_nationkey < 20").select(tax("2", F.col("n_nationkey")).alias("tax_id"), F.concat(F.lit("base"), F.col("n_nationkey").cast("string")).alias("unit"))
    units = reconcile.lookup_ranked(over.select("tax_id").union(base.select("tax_id")), [over, base.union(over.withColumn("unit", F.lit("never")))], "tax_id", "unit")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, tax("1", F.col("c_nationkey"))).otherwise(tax("2-", F.col("c_nationkey"))).alias("buyer_tax_id"), F.col("c_name").alias("buyer_name"))
    return reconcile.buyer_unit(rows, units).select("c_custkey", "buyer_name")


@query("select 'f' || cast(conv_id as varchar) as file, turn from conversations c where turn % 3 > 0 or not exists (select 1 from conversations d where d.conv_id = c.conv_id and d.turn % 3 > 0)")
def invoice_pages(spark, sf):
    """Pages without pump logs, unless a file has nothing else."""
    c = table(spark, sf, "conversations").select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), "turn")
    p = c.withColumn("text", F.when(F.col("turn") % 3 == 0, "  Danh sách log cột bơm").when(F.col("turn") % 3 == 1, "HÓA ĐƠN vòi bơm").otherwise(None))
    return page_fields.invoice_pages(p).select("file", "turn")


@query("select p_partkey, row_number() over (order by case when p_partkey % 2 = 0 then 'b' else 'a' end, p_size, p_partkey) n from part")
def result_order(spark, sf):
    """Rows by name before the page, page as a number, file."""
    p = table(spark, sf, "part")
    alias = F.concat(F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("a"), F.lit("_p"), F.col("p_size").cast("string"))
    rows = p.select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("file"), alias.alias("alias"))
    return reconcile.continue_sequence(rows, 0, page_fields.result_order(F.col("file"), "alias")).select("p_partkey", F.col("seq").alias("n"))


@query("select c_custkey, list_filter(['a', case when c_custkey % 2 = 0 then 'a' else 'b' end, 'c'], lambda x: true)[1:1] || case when c_custkey % 2 = 0 then ['c'] else ['b', 'c'] end ids from customer")
def distinct_ids(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", work.distinct_ids(F.array(F.lit("a"), F.when(k % 2 == 0, " a").otherwise("b"), F.lit(" "), F.lit("c"), F.lit("a"))).alias("ids"))


@query("select p_brand folder, min(p_partkey) id, 'x' || cast(p_size % 4 as varchar) body, row_number() over (partition by p_brand order by min(p_partkey)) copy from part group by p_brand, p_size % 4")
def xml_saves(spark, sf):
    """One file of each content under a name; later ones are numbered."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("folder"), F.lit("n.xml").alias("name"), F.col("p_partkey").alias("id"), F.concat(F.lit("x"), (F.col("p_size") % 4).cast("string")).cast("binary").alias("content"))
    copy = F.coalesce(F.regexp_extract("unique_name", r"_(\d+)\.", 1).try_cast("bigint"), F.lit(0).cast("bigint")) + 1
    return work.xml_saves(p).select("folder", "id", F.col("content").cast("string").alias("body"), copy.alias("copy"))


@query("select cast(c_custkey as varchar) id, case when c_custkey % 3 = 0 then 'plain' when c_custkey % 3 = 1 then '<b>x</b>' else '' end body from customer where c_custkey % 7 = 0 and c_custkey % 30 between 2 and 4")
def message_bodies(spark, sf):
    """Messages of a label within days, both included, and their first body that is not blank."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    coded = lambda v: F.translate(F.base64(v.cast("binary")), "+/", "-_")
    part = lambda mime, v: F.struct(F.lit("0").alias("path"), F.lit("").alias("filename"), F.lit(mime).alias("mime"), F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("string").alias("attachment_id"), coded(v).alias("data_b64url"))
    day = F.unix_millis(F.to_timestamp(F.lit("2026-01-01"))) + (k % 30) * 86_400_000 + (k % 24) * 3_600_000
    m = c.select(k.cast("string").alias("id"), F.when(k % 7 == 0, F.array(F.lit("L"))).otherwise(F.array(F.lit("M"))).alias("label_ids"), day.alias("internal_date_ms"), F.array(part("text/html", F.when(k % 3 == 1, "<b>x</b>").otherwise(" ")), part("image/png", F.lit("i")), part("text/plain", F.when(k % 3 == 0, "plain").otherwise(" "))).alias("parts"))
    return messages.first_body(messages.listing(m, "L", "2026-01-03", "2026-01-05"))


@query("select case when c_nationkey % 2 = 0 then 's' || cast(c_nationkey as varchar) else '' end supplier, count(*) n, count(*) filter (where c_custkey % 3 = 0) pdfs, count(*) filter (where c_custkey % 4 = 0) hits from customer group by 1")
def scan_summary(spark, sf):
    k = F.col("c_custkey")
    return messages.scan_summary(table(spark, sf, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))).alias("supplier"), (k % 3 == 0).alias("has_pdf"), (k % 4 == 0).alias("keyword_hit")))


@query("select p_partkey from part where p_size % 5 > 0 and p_partkey % 3 > 0")
def unread_files(spark, sf):
    """Page files outside of folders that were read, without known stems."""
    p = table(spark, sf, "part")
    f = p.select("p_partkey", F.when(F.col("p_size") % 5 == 0, "/in/Trung_Lap").otherwise("/in/x").alias("folder"), F.col("p_partkey").cast("string").alias("stem"))
    known = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("file_stem"))
    return work.unread(f, ("trung_lap",), work.filled_stems(known)).select("p_partkey")
