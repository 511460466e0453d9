"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's target is its weight's share of all words, at most ``MOST`` times its own; a source is taken
in whole passes and one partial pass over its documents in seeded order. Passes are cut into blocks; the
exact block quotas of the sources are split among the output shards by a tree whose every node draws the
left half's quotas from the multivariate hypergeometric law; each shard then owns disjoint stretches of a
permutation of each source's blocks, drawn by a seeded hash, and orders its rows by another. Quotas are split on the driver:
it holds one row a source, and no other data.

Cases: null and empty texts have size 0 and are taken 0 words; a null source comes last; repeated rows are
rows of their own; texts of any length are taken whole; of equal hashes the row numbered first goes first; sources without words, and empty tables, have target 0; extra columns are not read by the
query and are kept by the stage, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, MOST, SHARDS, SEED, BLOCK = (1, 2, 3), 3, 16, 9, 64
#: Share of a source's target that the first documents may leave open.
NEAR = 0.001
#: Sources up to which a table of one row a source is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(src, source_size)``, one row a source → with ``target``. Sources whose ``MOST`` times size lies below
    their share are full; taken by rising size to weight, they are a prefix, and the rest share what is left."""
    order = Window.orderBy("src")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", (MOST * F.col("source_size")).cast("double")).withColumn("q", F.col("cap") / F.col("w"))
    prior = Window.orderBy("q", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("q", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gone = lambda c: F.coalesce(F.sum(c).over(prior), F.lit(0))
    t = t.withColumn("lam", (F.sum("source_size").over(every) - gone("cap")) / (F.sum("w").over(every) - gone("w")))
    t = t.withColumn("rate", F.max(F.when(F.col("q") > F.col("lam"), F.col("lam"))).over(every))
    return t.select("src", "source_size", F.when(F.col("q") <= F.col("lam"), F.col("cap")).otherwise(F.col("w") * F.col("rate")).alias("target"))


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw, by inversion outwards from the mode; time grows with the standard deviation."""
    lo, hi = max(0, draws - bad), min(good, draws)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p0 = math.exp(lc(good, mode) + lc(bad, draws - mode) - lc(good + bad, draws))
    u, a, b, pa, pb = rng.random() - p0, mode, mode, p0, p0
    while u > 0 and (a > lo or b < hi):
        if b < hi:
            pb *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= pb
            if u <= 0:
                return b
        if a > lo:
            pa *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= pa
            if u <= 0:
                return a
    return mode


def split_quotas(blocks: list[int], shards: int, rng: random.Random) -> list[list[int]]:
    """Blocks a source → blocks a shard and source; every node of the tree splits its quotas exactly."""
    if shards == 1:
        return [blocks]
    left = shards // 2
    draws, rest, mine = sum(blocks) * left // shards, sum(blocks), []
    for n in blocks:
        rest -= n
        got = hypergeometric(rng, n, rest, draws) if draws else 0
        mine.append(got)
        draws -= got
    return split_quotas(mine, left, rng) + split_quotas([a - b for a, b in zip(blocks, mine, strict=True)], shards - left, rng)


def _later(r: DataFrame, fit: DataFrame, few) -> DataFrame | None:
    """``(_n, src, size, place)`` of the documents behind the first that doesn't fit which fit what is left open, for sources that miss more than ``NEAR`` of
    their target; ``place`` counts from 0. Each round takes, in order, as many as fit; none fits after the last."""
    left, taken = fit.select("src", (F.col("left") - F.col("got")).alias("gap"), F.lit(0).cast("long").alias("count"), (NEAR * F.col("target")).alias("least"), "fit"), None
    while left.where("gap > least and gap >= 1").limit(1).count():
        rest = r.select("_n", "src", "size", "_key", "rank").join(few(left.where("gap > least")), "src").where((F.col("rank") > F.col("fit")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
        rest = rest.drop("rank", "fit", "least")
        rest = rest if taken is None else rest.join(taken.select("_n"), "_n", "left_anti")
        fits = F.col("before") + F.col("size") <= F.col("gap")
        new = common.materialize(common.ranked(rest, ["src"], "_key", ["_n"], weight="size").where(fits).select("_n", "src", "size", (F.col("count") + F.col("rank") - 1).alias("place")), "later")
        got = new.groupBy("src").agg(F.sum("size").alias("_got"), F.count("*").alias("_c"))
        if not new.limit(1).count():
            break
        taken = new if taken is None else taken.union(new)
        left = common.materialize(left.join(few(got), "src").select("src", (F.col("gap") - F.col("_got")).alias("gap"), (F.col("count") + F.col("_c")).alias("count"), "least", "fit"), "left")
    return taken


def mix_documents(base: DataFrame, shards: int = SHARDS, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``base(_n, src, size, _key)``, a written table of rows numbered ``_n`` → ``(_n, size, source_size, target, taken)`` for every row, and a row for
    each copy that the mix takes: ``(_n, shard, order_key)``, the place within a shard being that of the key."""
    spark = base.sparkSession
    r = common.ranked(base, ["src"], "_key", ["_n"], weight="size")
    sizes = common.materialize(targets(base.groupBy("src").agg(F.sum("size").alias("source_size"))), "sources")
    small = sizes.count() <= BROADCAST_ROWS
    few = lambda d: F.broadcast(d) if small else d
    r = r.withColumnRenamed("total", "source_size").join(few(sizes.drop("source_size")), "src")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    r = common.materialize(r.withColumn("passes", passes).withColumn("left", F.col("target") - passes * F.col("source_size")), "mix")

    # the partial pass: documents that fit, in order; where that leaves too much open, those that fit what is left, again and again, each time
    # in order; then the one that comes nearest to what is still missing
    fits = F.col("before") + F.col("size") <= F.col("left")
    fit = r.groupBy("src").agg(F.first("n").alias("n"), F.first("passes").alias("passes"), F.first("left").alias("left"), F.first("target").alias("target"), F.sum(fits.cast("long")).alias("fit"), F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0)).alias("got"))
    fit = common.materialize(fit.withColumn("more", F.lit(0).cast("long")), "fit")
    later = _later(r, fit, few)
    if later is not None:
        added = later.groupBy("src").agg(F.count("*").alias("_more"), F.sum("size").alias("_got"))
        fit = fit.join(few(added), "src", "left").select("src", "n", "passes", "left", "fit", (F.col("got") + F.coalesce("_got", F.lit(0))).alias("got"), F.coalesce("_more", F.lit(0)).alias("more"))
        r = r.join(later.select("_n", F.col("place").alias("_place")), "_n", "left")
    else:
        r = r.withColumn("_place", F.lit(None).cast("long"))
    gap = F.abs(F.col("size") - (F.col("left") - F.col("got")))
    near = r.where("_place is null").select("src", "rank", "size").join(few(fit), "src").where((F.col("rank") > F.col("fit")) & (gap < F.col("left") - F.col("got")))
    near = near.groupBy("src").agg(F.min_by("rank", F.struct(gap, F.col("rank"))).alias("extra"))
    took = fit.join(near, "src", "left").orderBy("src").collect()  # one row a source
    blocks = [-(-(x.passes * x.n + x.fit + x.more + (x.extra is not None)) // block) for x in took]
    quotas = split_quotas(blocks, shards, random.Random(seed))
    ends = [list(itertools.accumulate(q[i] for q in quotas)) for i in range(len(took))]
    plan = [(x.src["none"], x.src["name"], x.fit, x.more, x.extra or 0, n, e) for x, n, e in zip(took, blocks, ends, strict=True)]
    plan_rows = spark.createDataFrame(plan, "none boolean, name string, fit long, more long, extra long, blocks long, ends array<long>").select(F.struct("none", "name").alias("src"), "fit", "more", "extra", "blocks", "ends")
    r = r.join(few(plan_rows), "src")
    times = F.col("passes") + ((F.col("rank") <= F.col("fit")) | F.col("_place").isNotNull()).cast("long") + (F.col("rank") == F.col("extra")).cast("long")
    r = r.withColumn("times", times)
    # every copy's block of its source; a permutation of a source's blocks, drawn by a seeded hash, gives each shard its own
    place = F.when((F.col("p") < F.col("passes")) | (F.col("rank") <= F.col("fit")), F.col("rank") - 1).otherwise(F.col("fit") + F.coalesce("_place", "more"))
    copies = r.where("times > 0").select("_n", "src", "_key", "rank", "passes", "fit", "more", "_place", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("p"))
    copies = copies.select("_n", "src", F.floor((F.col("p") * F.col("n") + place) / F.lit(block)).alias("block"), F.xxhash64("_key", "p", F.lit(seed)).alias("order_key"))
    every = plan_rows.where("blocks > 0").select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    drawn = common.ranked(every.withColumn("_draw", F.xxhash64("src", "block", F.lit(seed))), ["src"], "_draw", ["block"]).join(few(plan_rows.select("src", "ends")), "src")
    drawn = drawn.select("src", "block", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"))
    return r.select("_n", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")), copies.join(drawn, ["src", "block"]).select("_n", "shard", "order_key")


def _base(docs: DataFrame, seed: int = SEED) -> list:
    return [common.source_key().alias("src"), F.size(common.words(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_key")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, with its ``copies`` (each a ``shard`` and an ``order_key`` within it; none if it is not taken)."""
    docs = common.read_table(spark, sf_dir, "documents")
    base = common.materialize(docs.select("doc_id", *_base(docs)).withColumn("_n", F.monotonically_increasing_id()), "sizes")
    rows, copies = mix_documents(base.drop("doc_id"))
    own = copies.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("shard", "order_key"))).alias("copies"))
    out = base.select("_n", "doc_id").join(rows, "_n").join(own, "_n", "left")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("copies", F.array().cast(own.schema["copies"].dataType)).alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, with the columns of ``docs``: partitions hold consecutive stretches of the shards, each in its own order.
    An empty table gives no rows; columns may have any names."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*_base(docs), *[F.col(c).alias(x) for c, x in own.items()]).withColumn("_n", F.monotonically_increasing_id())
    rows = common.materialize(rows, "rows")
    _, copies = mix_documents(rows.select("_n", "src", "size", "_key"))
    out = rows.join(common.materialize(copies, "copies"), "_n")
    return out.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key").select(*[F.col(x).alias(c) for c, x in own.items()])
