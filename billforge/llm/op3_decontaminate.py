"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased and cut into runs of letters and digits. A window that reaches the similarity shares word
shingles with its item, so shared shingles (seeds) fix where an item's window can lie; only these windows are
fingerprinted. Fingerprints are cut into RADIUS + 1 blocks, one of which is equal for any two within the radius;
pairs that share a block and lie within it are verified by exact weighted-shingle similarity: the sum of the
smaller shingle counts over the sum of the larger ones.

Cases: null and empty texts are clean; texts of any length are taken whole, and one shorter than an item is its only window; of several items that fit all are named; items without words match nothing; items shorter than a shingle are one
shingle; repeated rows get equal verdicts, and rows that repeat an id get their own; an empty table gives no rows,
an empty benchmark leaves all clean; extra columns are not read by the query and are kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Rows of item shingles up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _words(text) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(words) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(h, k: int) -> Column:
    """Hashes of all ``k``-word shingles of an array of word hashes."""
    one = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
    return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), one)).otherwise(F.array().cast("array<bigint>"))


def _by_length(h, n) -> Column:
    """Shingles of an item or window of ``n`` words."""
    out = _shingles(h, SHINGLE)
    for k in range(1, SHINGLE):
        out = F.when(n == k, _shingles(h, k)).otherwise(out)
    return out


def _fingerprint(shingles) -> Column:
    bit = lambda b: F.aggregate(shingles, F.lit(0), lambda s, x: s + F.getbit(x, b).cast("int"))
    ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * bit(b) > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def _blocks(fp, radius: int) -> Column:
    """The fingerprint's ``radius + 1`` blocks, nearly equal in width."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)])


def hits(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs(_key, text)`` → ``(_key, item_ids, similarity)`` of the contaminated ones. ``_key`` stands for the text."""
    it = items.select("item_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    it = it.withColumn("n", F.size("w")).withColumn("h", _hashes("w")).withColumn("s", _by_length(F.col("h"), F.col("n")))
    it = it.withColumn("fp", _fingerprint(F.col("s"))).withColumn("blocks", _blocks(F.col("fp"), radius))
    it = it.withColumn("counts", F.transform(F.array_distinct("s"), lambda x: F.struct(x.alias("h"), F.size(F.filter("s", lambda y: y == x)).alias("c"))))
    it = common.materialize(it.select("item_id", "n", "s", "fp", "blocks", "counts"), "items")
    keys = it.select("item_id", F.posexplode("s").alias("off", "h"))
    sizes = [r.k for r in it.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"_key binary, item_ids array<{items.schema['item_id'].dataType.simpleString()}>, similarity double")
    small = keys.count() <= BROADCAST_ROWS
    h = docs.select("_key", _hashes(_words(F.col("text"))).alias("wh"))
    seeds = None
    for k in sizes:
        s = h.select("_key", F.size("wh").alias("len"), F.posexplode(_shingles(F.col("wh"), k)).alias("pos", "h"))
        s = s.join(F.broadcast(keys) if small else keys, "h").select("_key", "item_id", "h", "len", (F.col("pos") - F.col("off")).alias("start"))
        seeds = s if seeds is None else seeds.union(s)
    # at the similarity s, item and window share at least s / (1 + s) of their shingles together; the window of a text shorter than the item is the text
    found = seeds.groupBy("_key", "item_id").agg(F.collect_set("start").alias("starts"), F.count("*").alias("hits"), F.max("len").alias("len"))
    window = F.greatest(F.least("n", "len") - F.least("n", F.lit(SHINGLE)) + 1, F.lit(0))
    found = found.join(it.select("item_id", F.size("s").alias("m"), "n"), "item_id").where(F.col("hits") >= F.ceil(similarity / (1 + similarity) * (F.col("m") + window) - 1e-9))
    found = common.materialize(found.groupBy("_key").agg(F.collect_list(F.struct("item_id", "n", "starts")).alias("found")), "seeds")
    # windows of the texts that hold seeds enough
    texts = docs.join(found, "_key").dropDuplicates(["_key"]).withColumn("wh", _hashes(_words(F.col("text"))))
    spots = texts.select("_key", "wh", F.inline("found")).withColumn(
        "starts", F.array_distinct(F.transform("starts", lambda x: F.greatest(F.lit(0), F.least(x, F.size("wh") - F.col("n")))))
    )
    win = spots.select("_key", "item_id", F.explode(F.transform("starts", lambda x: F.slice("wh", x + 1, F.col("n")))).alias("wh"))
    win = win.withColumn("ws", _by_length(F.col("wh"), F.size("wh"))).drop("wh").where(F.size("ws") > 0).withColumn("wfp", _fingerprint(F.col("ws")))
    win = win.join(it, "item_id").withColumn("wblocks", _blocks(F.col("wfp"), radius))
    near = F.exists(F.zip_with("blocks", "wblocks", lambda a, b: a == b), lambda x: x) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp"))) <= radius)
    both = F.aggregate("counts", F.lit(0), lambda t, c: t + F.least(c["c"], F.size(F.filter("ws", lambda y: y == c["h"]))))
    win = win.where(near).withColumn("both", both).withColumn("sim", F.col("both") / (F.size("s") + F.size("ws") - F.col("both")))
    return win.where(F.col("sim") >= similarity).groupBy("_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("sim").alias("similarity"))


def _key() -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, similarity`` for every row; the similarity is the best window's."""
    d = docs.select("doc_id", "text", _key().alias("_key"))
    found = common.materialize(hits(d.select("_key", "text"), items, similarity), "hits")
    out = d.select("doc_id", "_key").join(found, "_key", "left")
    return out.select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item, with the columns of ``docs``, whatever their names. An empty table gives no rows, an empty benchmark keeps all."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    d = docs.select("text", _key().alias("_key"), *[F.col(c).alias(x) for c, x in own.items()])
    found = common.materialize(hits(d.select("_key", "text"), common.read_table(spark, sf_dir, "benchmark")), "hits")
    return d.join(found.select("_key"), "_key", "left_anti").select(*[F.col(x).alias(c) for c, x in own.items()])
