"""Landed messages: whole, as trees of parts, or flat, with the path of each part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base64url, keyword_hit, mime_header, supplier_domain
from ..tables import written

SCHEMA = (
    "id string, label_ids array<string>, internal_date_ms bigint, subject string, sender string, date_header string, "
    "parts array<struct<path:string,filename:string,mime:string,size:bigint,attachment_id:string,data_b64url:string>>"
)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of landed messages; a broken line gives a row of nulls."""
    return spark.read.schema(SCHEMA).json(path)


def walk_parts(raw: DataFrame) -> DataFrame:
    """``raw(id, raw)``, messages as JSON → a row for each part of their trees, of any depth: ``id, path, node``, ``path`` being the part's place in
    each level, none for the root, and ``node`` a VARIANT. One level is opened at a time, for all messages; broken messages have no parts."""
    level = raw.select("id", F.array().cast("array<int>").alias("path"), F.variant_get(F.try_parse_json("raw"), "$.payload", "variant").alias("node")).where("node is not null")
    levels = []
    while level.limit(1).count():
        level = written(level, "parts")
        levels.append(level)
        below = level.select("id", "path", F.posexplode(F.try_variant_get("node", "$.parts", "array<variant>")).alias("at", "node"))
        level = below.select("id", F.array_append("path", F.col("at")).alias("path"), "node")
    return reduce(DataFrame.union, levels) if levels else level


def flatten_trees(raw: DataFrame) -> DataFrame:
    """``raw(id, raw)`` → rows of ``SCHEMA``. ``parts`` are all parts below the root, or the root if it has none below, a part after those in it."""
    get = lambda p, kind="string": F.try_variant_get("node", p, kind)
    inner = F.size(F.coalesce(get("$.parts", "array<variant>"), F.array().cast("array<variant>"))) > 0
    part = F.struct(
        F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), F.coalesce(get("$.filename"), F.lit("")).alias("filename"), F.coalesce(get("$.mimeType"), F.lit("")).alias("mime"), get("$.body.size", "bigint").alias("size"),
        get("$.body.attachmentId").alias("attachment_id"), F.nullif(get("$.body.data"), F.lit("")).alias("data_b64url"),
    )
    # what stands in a part comes before the part: its path goes on, while the part's ends with the greatest number
    place = F.array_append("path", F.lit(2**31 - 1))
    rows = walk_parts(raw).where((F.size("path") > 0) | ~inner).select("id", F.struct(place.alias("place"), part.alias("part")).alias("x"))
    parts = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"]).alias("parts"))
    v = F.try_parse_json("raw")
    of = lambda p, kind="string": F.try_variant_get(v, p, kind)
    heads = of("$.payload.headers", "array<struct<name:string,value:string>>")
    head = lambda n: F.coalesce(F.get(F.filter(heads, lambda h: F.lower(h["name"]) == n), F.lit(0))["value"], F.lit(""))
    about = raw.select("id", of("$.labelIds", "array<string>").alias("label_ids"), of("$.internalDate").try_cast("bigint").alias("internal_date_ms"), mime_header(head("subject")).alias("subject"), mime_header(head("from")).alias("sender"), head("date").alias("date_header"))
    return about.join(parts, "id", "left").select("id", "label_ids", "internal_date_ms", "subject", "sender", "date_header", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)).alias("parts"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of whole messages as a mail service gives them → rows of ``SCHEMA``; lines without an id are left out."""
    lines = spark.read.text(path).select(F.try_variant_get(F.try_parse_json("value"), "$.id", "string").alias("id"), F.col("value").alias("raw"))
    return flatten_trees(lines.where("id is not null"))


def listing(messages: DataFrame, label: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Messages of a label within days, both included. The bounds reach the scan."""
    if label:
        messages = messages.where(F.array_contains("label_ids", label))
    if since:
        messages = messages.where(F.col("internal_date_ms") >= F.unix_millis(F.to_timestamp(F.lit(since))))
    if until:
        messages = messages.where(F.col("internal_date_ms") < F.unix_millis(F.to_timestamp(F.lit(until)) + F.expr("interval 1 day")))
    return messages


def scan(messages: DataFrame, supported: list[str], keywords: list[str]) -> DataFrame:
    """Scan records: all bodies joined, attachment leaves, whether there is a PDF, the supplier (none where a PDF is attached) and keywords.
    The content stays only where a supplier was found."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    is_pdf = lambda p: F.contains(low(p["mime"]), F.lit("pdf")) | F.endswith(low(p["filename"]), F.lit(".pdf"))
    body = lambda p: F.concat(F.make_valid_utf8(base64url(p["data_b64url"]).cast("string")), F.lit("\n"))
    bodies = F.filter("parts", lambda p: p["data_b64url"].isNotNull() & (low(p["filename"]) == "") & ~is_pdf(p))
    leaf = lambda p: F.struct(p["filename"].alias("filename"), p["mime"].alias("mime"), p["size"].alias("size"), p["attachment_id"].alias("attachment_id"))
    m = messages.select(
        "id", "subject", "sender", F.date_format(F.timestamp_millis("internal_date_ms"), "yyyy-MM-dd HH:mm").alias("mail_date"),
        F.coalesce(F.array_join(F.transform(bodies, body), ""), F.lit("")).alias("content"), F.coalesce(F.exists("parts", is_pdf), F.lit(False)).alias("has_pdf"),
        F.transform(F.filter("parts", lambda p: (low(p["filename"]) != "") | is_pdf(p)), leaf).alias("attachments"),
    )
    m = m.withColumn("supplier", F.when(~F.col("has_pdf"), supplier_domain(F.col("content"), supported)))
    m = m.withColumn("keyword_hit", keyword_hit(keywords, "sender", "subject", "content"))
    return m.withColumn("content", F.when(F.col("supplier").isNotNull(), F.col("content")))


def first_body(messages: DataFrame) -> DataFrame:
    """The first part of web or plain text that is not blank."""
    texts = F.transform(F.filter("parts", lambda p: p["mime"].isin("text/html", "text/plain")), lambda p: F.make_valid_utf8(base64url(p["data_b64url"]).cast("string")))
    return messages.select("id", F.coalesce(F.get(F.filter(texts, lambda t: F.trim(t) != ""), F.lit(0)), F.lit("")).alias("body"))


def scan_summary(scans: DataFrame) -> DataFrame:
    """Messages and PDFs by supplier."""
    return scans.groupBy(F.coalesce("supplier", F.lit("")).alias("supplier")).agg(F.count("*").alias("n"), F.count_if("has_pdf").alias("pdfs"), F.count_if("keyword_hit").alias("hits"))
