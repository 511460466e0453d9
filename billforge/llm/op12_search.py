"""Ranked lexical search: items as queries against all documents, with integer scores.

An index holds the postings of the items' terms, a row a term and document, bucketed by term; a bucket is dealt into slices of documents, so
the postings of a very common term are many parts. A document's own length is a posting, too, of the empty term. Postings of the
items' terms are dealt by document before they meet the items, so a match is scored and summed where it is made, and only each
partition's best documents of an item are sent on to be ranked.

Cases: null texts and texts without a term are no documents and never found; equal scores go by ascending id, a null id first; a repeated row is a
document of its own, with a rank of its own; rows of items that repeat an id are one item, with the terms of all of them; items without a known term
have no rows; texts of any length are taken whole; an empty table on either side gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP, BUCKETS, SLICES = 50, 32, 16
#: Rows of item terms up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text) -> Column:
    """Runs of ASCII letters and digits and of all other characters, in order; only A-Z are lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda t: t != "")


def bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each term of an item once."""
    return items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).distinct()


def index(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """Postings ``(bucket, slice, term, key, doc_id, n, tf)`` of the ``vocabulary(term)``, and of the empty term for each document with a
    term; ``key`` numbers the rows of ``docs``. A written table, laid out by bucket and slice."""
    wanted = vocabulary.union(docs.sparkSession.createDataFrame([("",)], "term string"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("key"), terms(F.col("text")).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    found = rows.select("key", "doc_id", "n", F.explode(F.array_append("t", F.lit(""))).alias("term")).join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    found = found.groupBy("key", "doc_id", "n", "term").agg(F.count("*").alias("tf"))
    laid = found.select(bucket(F.col("term")).alias("bucket"), F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int").alias("slice"), "term", "key", "doc_id", "n", "tf")
    return common.materialize(laid.repartition("bucket", "slice"), "postings")


def weights(postings: DataFrame) -> tuple[int, int, DataFrame]:
    """Documents and terms with repeats, and ``(term, weight)``."""
    n, total = postings.where((F.col("bucket") == bucket(F.lit(""))) & (F.col("term") == "")).agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    df = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    return n, total, df.select("term", F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's best documents."""
    wanted = common.materialize(item_terms(items), "terms")
    small = wanted.count() <= BROADCAST_ROWS
    few = lambda d: F.broadcast(d) if small else d
    postings = index(docs, wanted.select("term").distinct(), small)
    n, total, weight = weights(postings)
    weighed = common.materialize(wanted.join(few(weight), "term").select("item_id", "term", "weight", bucket(F.col("term")).alias("bucket")), "weights")
    common.discard(wanted)
    length = F.expr(f"50 + (50L * n * {n}L) div {max(total, 1)}L")
    mine = postings.where("term <> ''").select("bucket", "term", "key", "doc_id", F.expr("1000L * tf").alias("t"), (20 * length).alias("m")).repartition("key")
    part = mine.select("bucket", "term", "key", "doc_id", F.expr("(1000000L * t) div (t + m)").alias("part"))
    scores = part.join(few(weighed), ["bucket", "term"]).groupBy("key", "doc_id", "item_id").agg(F.sum(F.col("weight") * F.col("part")).alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "key")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
o AS (SELECT k, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM o),
p AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, n, unnest(t) AS term FROM o) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, big_n),
s AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
      FROM p JOIN q USING (term) JOIN w USING (term), c GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, k))::INTEGER AS rank, doc_id, score
FROM s QUALIFY rank <= {TOP}
"""
