"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Word unigrams and bigrams of every document are hashed into buckets, whose number grows with the n-grams of the corpus up
to ``MAX_BUCKETS``. Raw counts come from all documents, trusted counts and the threshold from all that are labelled, good and not
toxic. Texts are dealt to ``FOLDS`` parts by hash, and a document's score, the mean over its n-grams of log p_trusted -
log p_raw, comes from the counts of the other parts: neither it nor an exact copy is in the counts it is held against,
labelled or not. The threshold is the cut that best parts these held-out scores of documents labelled good (and not toxic)
from those of documents labelled bad, among the ones that pass the base rules. A document is kept if the base rules pass
and the score reaches it. Toxic documents of good quality are on neither side: the ratio does not tell them apart.

Texts are cut into words once: the counts and the words' hashes are written, counted and scored from there. All of it is
JVM-side column expressions; only the weights, ``FOLDS`` doubles a bucket, are sent around.

Cases: a null, empty or blank text has no words and fails the base rules; repeated rows count as often as they
appear and get the same verdict; without good labels the trusted side is empty, and without good or bad ones there is no
threshold: only the base rules decide; an empty table gives no rows; texts may have any number of words; extra columns are not
read by the query and are kept by the stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, ALPHA = 4, 1.0
#: Buckets, powers of two: about one for every GRAMS_A_BUCKET n-grams of the corpus.
MIN_BUCKETS, MAX_BUCKETS, GRAMS_A_BUCKET = 1 << 14, 1 << 17, 32
#: Bits of a word's hash that are written.
WORD_BITS = 20
#: Rows whose bits a bitmap of Spark's holds.
BITMAP_ROWS = 32_768
#: Steps of a score in which the threshold is sought.
STEPS = 1024
SYMBOLS = r"[#*$%&|<>]"



def grams(words: Column, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of an array of word hashes."""
    mask = F.lit(buckets - 1)
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.hash(a, b).bitwiseAND(mask))
    return F.concat(F.transform(words, lambda h: h.bitwiseAND(mask)), pairs)


def _windows(hashes: Column) -> Column:
    """Hashes of all 3-word windows; of the last two words, which begin none, of what is left."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of its texts, and ``_h``, ``WORD_BITS`` bits of its words' hashes.

    Windows found twice: if some hashes are equal, they are sorted as longs of hash and position, neighbours of equal hash bits are
    candidates, and these are compared as texts. Covered words follow from the gaps between window positions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{common.SPACES}]"))
    d = docs.withColumn("_w", F.array_remove(F.split(text, f"[{common.SPACES}]+"), ""))
    d = d.withColumn("_hash", F.transform("_w", lambda w: F.hash(w))).withColumn("_lines", lines)
    d = d.withColumn("_g", _windows(F.col("_hash")))
    n = F.size("_g")
    some = F.size(F.array_distinct("_g")) < n
    # as many low bits as positions need hold the position
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1
    packed = F.transform("_g", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))
    d = d.withColumn("_low", F.when(some, low)).withColumn("_s", F.when(F.col("_low").isNotNull(), F.sort_array(packed)))
    s = F.col("_s")
    top = lambda x: x.bitwiseAND(F.bitwise_not(F.col("_low")))
    twin = F.transform(s, lambda x, i: F.when((top(F.get(s, i - 1)) == top(x)) | (top(F.get(s, i + 1)) == top(x)), x.bitwiseAND(F.col("_low")).cast("int")))
    d = d.withColumn("_twin", F.array_compact(twin))
    # candidates compared as texts: sort (window, place), keep those equal to a neighbour
    named = F.array_sort(F.transform("_twin", lambda i: F.struct(F.concat_ws(" ", F.slice("_w", i + 1, 3)).alias("t"), i.alias("i"))))
    d = d.withColumn("_named", named)
    a = F.col("_named")
    sure = F.array_compact(F.transform(a, lambda x, i: F.when((F.get(a, i - 1)["t"] == x["t"]) | (F.get(a, i + 1)["t"] == x["t"]), x["i"])))
    d = d.withColumn("_at", F.array_sort(sure))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return d.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("_hash", lambda h: h.bitwiseAND(F.lit((1 << WORD_BITS) - 1))).alias("_h"),
        F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(FOLDS)).cast("int").alias("_fold"),
    )


def labelled(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)`` of every labelled document that counts: 1 for good and not toxic, 0 for bad."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality = 1 and toxic = 0")).alias("g"), F.max(F.expr("quality = 0")).alias("b"))
    return one.where("g or b").select("doc_id", F.coalesce("g", F.lit(False)).cast("int").alias("good"))


def marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs(_n, _id, ...)`` with ``_good``, 1 for the rows that ``known(_id, good)`` names as good, else 0.

    ``_n`` counts on within a partition. So good rows are bits, and what is sent around is a bit a row of ``docs``, not an id a label, nor the texts."""
    good = docs.select("_n", "_id").join(known.where("good = 1").select("_id").hint("merge"), "_id", "left_semi")
    bits = good.groupBy(F.floor(F.col("_n") / BITMAP_ROWS).alias("_block")).agg(F.bitmap_construct_agg(F.pmod("_n", F.lit(BITMAP_ROWS))).alias("_bits"))
    bits = common.materialize(bits, "trusted")
    at = F.pmod("_n", F.lit(BITMAP_ROWS))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")), F.lit(2))
    return docs.withColumn("_block", F.floor(F.col("_n") / BITMAP_ROWS)).join(F.broadcast(bits), "_block", "left").withColumn("_good", F.coalesce(bit, F.lit(0))).drop("_block", "_bits")


def trusted(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs(_n, _id, ...)`` that ``known(_id, good)`` names as good."""
    return marked(docs, known).where("_good = 1").drop("_good")


def weights(docs: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """``docs(_n, _id, _fold, _h)`` and ``known(_id, good)`` → one row: ``w``, the log ratios by bucket and fold, those of a fold being without its own texts."""
    # raw and trusted counts are taken in one pass over the n-grams
    each = marked(docs, known).select("_fold", "_good", F.explode(grams(F.col("_h"), buckets)).alias("b")).select((F.col("b") * FOLDS + F.col("_fold")).alias("cell"), "_good")
    table = each.groupBy("cell").agg(F.count("*").alias("r"), F.sum("_good").alias("g"))
    table = common.materialize(table.select(F.floor(F.col("cell") / FOLDS).cast("int").alias("b"), (F.col("cell") % FOLDS).alias("fold"), "r", "g"), "ngrams")
    n = {(r.fold, x): r[x] for r in table.groupBy("fold").agg(F.sum("r").alias("r"), F.sum("g").alias("g")).collect() for x in "rg"}
    mine = lambda x, k: F.sum(F.when(F.col("fold") != k, F.col(x)).otherwise(0)).alias(f"{x}{k}")
    rest = table.groupBy("b").agg(*[mine(x, k) for x in "rg" for k in range(FOLDS)])
    total = {(k, x): sum(n.get((j, x), 0) for j in range(FOLDS) if j != k) for k in range(FOLDS) for x in "rg"}
    rate = lambda x, k: F.log((F.coalesce(F.col(f"{x}{k}"), F.lit(0)) + ALPHA) / (total[k, x] + ALPHA * buckets))
    ratio = lambda k: rate("g", k) - rate("r", k) if total[k, "g"] else F.lit(0.0)
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(rest, "b", "left").select("b", F.array(*map(ratio, range(FOLDS))).alias("w"))
    # in two steps, so that few rows meet in the last task
    listed = lambda x: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(x, "w"))), lambda y: y["w"])).alias("w")
    parts = full.groupBy(F.floor(F.col("b") / 1024).alias("part")).agg(listed("b"))
    return parts.groupBy().agg(listed("part"))


def threshold(scored: DataFrame) -> float:
    """The cut with the largest share of good scores from it on plus bad scores below it, in the middle of its gap.

    ``scored(good, score)``. Without good or bad ones, or if no cut tells them apart, all scores reach it."""
    d = scored.groupBy(F.floor(F.col("score") * STEPS).alias("at"))
    rows = sorted(d.agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect(), key=lambda r: r["at"])
    n_good, n_bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not n_good or not n_bad:
        return float("-inf")
    best, cut, good, bad = 0, float("-inf"), 0, 0
    for r, after in zip(rows, rows[1:], strict=False):
        good, bad = good + r.good, bad + r.bad
        gain = bad * n_good - good * n_bad
        if gain > best:
            best, cut = gain, (r["at"] + 1 + after["at"]) / 2 / STEPS
    return cut


def judge(docs: DataFrame, labels: DataFrame, *carry: str) -> tuple[DataFrame, DataFrame]:
    """``docs(_id, text)``, and columns to carry → the table of word hashes, and of every row ``doc_id``, the columns to carry, the base counts,
    ``base_failed``, ``score`` and ``kept``. The verdict depends on the text alone."""
    known = common.materialize(labelled(labels), "labelled").withColumnRenamed("doc_id", "_id")
    d = measure(docs.select("_id", "text", *carry)).drop("text").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = common.materialize(d.withColumn("_n", F.monotonically_increasing_id()), "measured")
    n_grams = d.agg(F.coalesce(F.sum(F.greatest(2 * F.col("n_words") - 1, F.lit(0))), F.lit(0))).first()[0]
    buckets = min(max(1 << (n_grams // GRAMS_A_BUCKET).bit_length(), MIN_BUCKETS), MAX_BUCKETS)
    # the one row is read in place; joined, it would be copied to every document
    w = common.materialize(weights(d, known, buckets), "weights").select("w").scalar()
    each = d.select("_n", "_fold", F.explode(grams(F.col("_h"), buckets)).alias("b")).select("_n", F.get(w, F.col("b") * FOLDS + F.col("_fold")).alias("w"))
    scores = each.groupBy("_n").agg(F.avg("w").alias("score"))
    out = d.select("_n", F.col("_id").alias("doc_id"), *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").join(scores, "_n", "left")
    out = common.materialize(out.withColumn("score", F.coalesce("score", F.lit(0.0))), "scored")
    cut = threshold(out.where("not base_failed").select("doc_id", "score").join(known.withColumnRenamed("_id", "doc_id").hint("merge"), "doc_id").select("good", "score"))
    return d, out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "text")
    _, out = judge(docs, common.read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose verdict is ``kept``, with the columns of ``docs``. Verdicts come back by text, so no table holds the texts once more.
    An empty table gives no rows; columns may have any names."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("_key")
    d, out = judge(docs.select(F.col("doc_id").alias("_id"), "text", key), common.read_table(spark, sf_dir, "labels"), "_key")
    kept = common.materialize(out.where("kept").select("_key").distinct(), "kept")
    common.discard(d)
    return docs.select(key, *[F.col(c).alias(x) for c, x in own.items()]).join(kept, "_key", "left_semi").select(*[F.col(x).alias(c) for c, x in own.items()])
