"""Shared pieces: written intermediate tables, connected components, bucket linking."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every word rule: space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"
_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master, all of whose tasks share this machine's disk, may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append("file://" + tempfile.mkdtemp(prefix="billforge-"))
    return _local_root[0]


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, to: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, or add its rows ``to`` a table written before, and read it back: cuts lineage, survives lost executors.

    Nothing reads the write's shuffle files again, so Spark is told to remove them as it ends."""
    spark = df.sparkSession
    path = to._written_path if to is not None else f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.mode("error" if to is None else "append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if not path:
            continue
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> Column:
    """Array of the text's ``[^\\x20\\x09-\\x0D]+`` words; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def source_key(source="source") -> Column:
    """Orders sources by code point, null last; never null itself."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))


def ranked(rows: DataFrame, by: list[str], key: str, ties: list[str], weight: str | None = None, slices: int = 12) -> DataFrame:
    """``rows`` with its exact place in each ``by`` group, in unsigned order of the hash ``key``.

    A group is cut into ``2**slices`` ranges of the hash; ranges are counted, the counts summed up before
    each range, and rows are numbered within a range only: no group meets in one task.
    Adds ``rank`` (from 1), ``n`` (the group's rows) and, with ``weight``, ``before`` and ``total``.
    """
    w = F.col(weight) if weight else F.lit(0)
    cut = rows.withColumn("slice", F.shiftrightunsigned(F.col(key), 64 - slices).cast("int"))
    sums = cut.groupBy(*by, "slice").agg(F.count("*").alias("c"), F.sum(w).alias("s"))
    so_far = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = sums.select(
        *by, "slice", F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(so_far), F.lit(0)).alias("s0"), F.sum("c").over(whole).alias("n"), F.sum("s").over(whole).alias("total")
    )
    inside = Window.partitionBy(*by, "slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(sums, [*by, "slice"]).withColumn("rank", F.col("c0") + F.row_number().over(Window.partitionBy(*by, "slice").orderBy(key, *ties)))
    if weight:
        out = out.withColumn("before", F.col("s0") + F.sum(w).over(inside) - w)
    else:
        out = out.drop("total")
    return out.drop("slice", "c0", "s0")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` → ``(node, component)``, component being the smallest reachable node.

    Alternating large-star and small-star rounds; each is an aggregation by node and a join,
    so a hub's edges are pre-aggregated and its join side can be split. Every round is written. The joins are
    merge joins: a written table of edges is small for its rows, and a broadcast one would lie in the driver.
    """
    cur = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _stars(cur):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least.hint("merge"), "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        new = materialize(small, "edges")
        discard(cur)
        cur = new
    heads = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)


def _stars(edges: DataFrame) -> bool:
    """Every node hangs on one centre, and no centre on another."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))))
    per = ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b"))
    return not per.where((F.col("a") > 1) | (F.col("a") > 0) & (F.col("b") > 0)).limit(1).count()


def sketches(sets: DataFrame, longs: int = 4) -> DataFrame:
    """``sets(id, set)`` → ``(id, size, p)``: elements dealt to 64 places a long, the parities of the places."""
    place = F.expr("shiftleft(1L, cast(t & 63 as int))")
    part = F.shiftright("t", 6).bitwiseAND(longs - 1)
    parity = [F.bit_xor(F.when(part == k, place).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(longs)]
    return sets.select("id", F.explode("set").alias("t")).groupBy("id").agg(F.count("*").alias("size"), *parity).select("id", "size", F.array(*[f"p{k}" for k in range(longs)]).alias("p"))


def may_reach(similarity: float, size, p, size2, p2, longs: int = 4) -> Column:
    """False only for sets whose sizes or parities rule the similarity out: sets differ in at least as many elements as their parities do."""
    differ = sum((F.bit_count(F.get(p, F.lit(k)).bitwiseXOR(F.get(p2, F.lit(k)))) for k in range(longs)), F.lit(0))
    return (F.least(size, size2) >= similarity * F.greatest(size, size2) - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * (size + size2) + 1e-9)


def size_class(size, similarity: float) -> Column:
    """Sets whose sizes let them reach the similarity are of one class or of two that adjoin."""
    return F.floor(F.log(F.col(size).cast("double")) / math.log(1.01 / similarity)).cast("int")


def jaccard_verifier(sets: DataFrame, similarity: float) -> Callable[[DataFrame], DataFrame]:
    """``sets(id, set)`` → a filter of ``pairs(u, v, ...)`` by the exact Jaccard similarity. Pairs that sketches rule out never meet their sets."""
    sketch = materialize(sketches(sets), "sketches")
    own = lambda d, n, *c: d.select(F.col("id").alias(n), *[F.col(x).alias(f"_{x}_{n}") for x in c])

    def verify(pairs: DataFrame) -> DataFrame:
        rest = pairs.columns
        some = pairs.join(own(sketch, "u", "size", "p"), "u").join(own(sketch, "v", "size", "p"), "v").where(may_reach(similarity, F.col("_size_u"), F.col("_p_u"), F.col("_size_v"), F.col("_p_v"))).select(*rest)
        both = F.size(F.array_intersect("_set_u", "_set_v"))
        return some.join(own(sets, "u", "set"), "u").join(own(sets, "v", "set"), "v").where(both >= similarity * (F.size("_set_u") + F.size("_set_v") - both) - 1e-9).select(*rest)

    return verify


def unit_verifier(sketch: DataFrame, units: DataFrame, cut: Callable[[Column], Column], similarity: float, longs: int) -> Callable[[DataFrame], DataFrame]:
    """Like ``jaccard_verifier``, of ``units(id, unit)``: pairs meet these, which are smaller to move than the sets that ``cut`` makes of them."""
    own = lambda d, n, *c: d.select(F.col("id").alias(n), *[F.col(x).alias(f"_{x}_{n}") for x in c])

    def verify(pairs: DataFrame) -> DataFrame:
        rest = pairs.columns
        some = pairs.join(own(sketch, "u", "size", "p"), "u").join(own(sketch, "v", "size", "p"), "v").where(may_reach(similarity, F.col("_size_u"), F.col("_p_u"), F.col("_size_v"), F.col("_p_v"), longs)).select(*rest)
        met = some.join(own(units, "u", "unit"), "u").join(own(units, "v", "unit"), "v").select(*rest, *[cut(F.col(f"_unit_{n}")).alias(f"_set_{n}") for n in "uv"])
        both = F.size(F.array_intersect("_set_u", "_set_v"))
        return met.where(both >= similarity * (F.size("_set_u") + F.size("_set_v") - both) - 1e-9).select(*rest)

    return verify


def prefix_pairs(ids: DataFrame, sets: DataFrame, similarity: float, slices: int = 1) -> DataFrame:
    """``ids(id, comp)`` and ``sets(id, set)`` → pairs ``(u, v)`` of different ``comp``, among them all of this Jaccard similarity.

    Sets are put in order of rising frequency. A pair at the similarity has its first common element early in both, with enough
    elements left after it, so only the first elements are joined: those that few sets share. Sets also differ in at least as many
    elements as the parities of their elements, dealt to 256 places, differ, which must not be too many.
    With ``slices``, sets are ordered and first elements joined a slice at a time, and what comes out is written."""
    part = lambda d, c, k: d.where(F.pmod(c, F.lit(slices)) == k) if slices > 1 else d
    cut = sets.join(ids, "id").select("id", "comp", F.size("set").alias("size"), F.explode("set").alias("t"))
    freq = cut.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    freq = materialize(freq, "frequencies") if slices > 1 else freq
    heads = pairs = None
    for k in range(slices):
        own = _prefixes(part(cut, "id", k), freq, similarity)
        heads = materialize(own, "prefixes", heads) if slices > 1 else own
    for k in range(slices):
        own = _meet(part(heads, "t", k), similarity)
        pairs = materialize(own, "prefix_pairs", pairs) if slices > 1 else own
    if slices > 1:
        discard(freq, heads)
    return pairs.distinct() if slices > 1 else pairs


def _prefixes(cut: DataFrame, freq: DataFrame, similarity: float) -> DataFrame:
    """``cut(id, comp, size, t)``, whole sets → the first elements that others share, with what a pair of them is judged by."""
    cut = cut.join(freq, "t", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    place = F.expr("shiftleft(1L, cast(t & 63 as int))")
    parity = [F.bit_xor(F.when(F.shiftright("t", 6).bitwiseAND(3) == k, place).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(4)]
    ordered = cut.groupBy("id", "comp", "size").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"), *parity)
    first = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    early = F.filter(F.transform(F.slice("o", F.lit(1), first.cast("int")), lambda x, i: F.struct(i.alias("pos"), x["f"].alias("f"), x["t"].alias("t"))), lambda x: x["f"] > 1)
    a = ordered.select("id", "comp", "size", F.array("p0", "p1", "p2", "p3").alias("p"), early.alias("e")).select("*", F.posexplode("e").alias("k", "x"))
    # the last few elements before this one: a pair that shares one of them is met there
    before = F.slice(F.transform("e", lambda x: x["t"]), F.greatest(F.col("k") - 5, F.lit(1)), F.least(F.col("k"), F.lit(6)))
    return a.select("id", "comp", F.col("x.t").alias("t"), "size", "p", (F.col("size") - F.col("x.pos")).alias("left"), before.alias("before"))


def _meet(a: DataFrame, similarity: float) -> DataFrame:
    b = a.select("t", F.col("p").alias("q"), F.col("id").alias("id2"), F.col("comp").alias("comp2"), F.col("size").alias("size2"), F.col("left").alias("left2"), F.col("before").alias("before2"))
    enough = F.least("left", "left2") >= similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - 1e-9
    differ = sum((F.bit_count(F.col("p")[k].bitwiseXOR(F.col("q")[k])) for k in range(4)), F.lit(0))
    alike = differ <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("size2")) + 1e-9
    return a.join(b, "t").where((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & enough & alike & ~F.arrays_overlap("before", "before2")).select(F.col("id").alias("u"), F.col("id2").alias("v")).distinct()


def shared_buckets(members: DataFrame, slices: int = 1) -> DataFrame:
    """``members(bucket, id)`` → the rows of buckets that hold two or more, written, with the bucket's size ``n`` and least id ``main``.

    Buckets are dealt to ``slices``, one after the other, so no more than a slice of the members is shuffled at a time; ``members`` is read once for each."""
    live = None
    for k in range(slices):
        own = members.where(F.pmod("bucket", F.lit(slices)) == k) if slices > 1 else members
        size = own.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("main")).where("n > 1")
        # Spark takes exploded rows to be as small as what they are made from, and would broadcast them
        rows = own.join(size.hint("merge"), "bucket").select("bucket", "id", F.col("id").alias("comp"), "n", "main", F.lit(1).cast("long").alias("most"))
        live = materialize(rows, "buckets", live)
    return live


def link_buckets(members: DataFrame, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], rounds: int = 6, similarity: float | None = None, few: int = 16, longs: int = 4, near: Callable[[Column, Column], Column] | None = None, slices: int = 1) -> DataFrame:
    """Components of the ids that share buckets and pass ``verify``.

    ``members(bucket, id)``, distinct but for chance; ``prepare`` takes the rows ``(bucket, id)`` of shared buckets and returns
    ``verify``, which takes ``pairs(u, v, ...)`` and returns those that are linked.
    Where all pairs of the buckets number little more than the members, they are verified at once.
    Else a round compares each bucket's members with one leader, so its pairs grow with the members, not
    with their square; members of one component are not compared again. In the end all pairs across the
    components of a bucket that were not tried yet are verified, so no link between components is lost: members outside
    of the bucket's most common component meet all, and only these pairs count when rounds are ended. With a
    ``similarity``, for which ``prepare`` returns ``(sets, verify)``, and where those pairs are many, buckets of more than ``few``
    members only pair members that the order of their sets' elements lets reach it (``prefix_pairs``). ``sets`` may be a function of the ids whose
    sets are asked for. A third value are ``sketches`` of ``longs``: members of smaller buckets are then compared by them as they meet.
    A check that needs the two ids alone is ``near``: it is part of the joins, so that pairs that fail it are not made.
    The members are looked through in ``slices`` of the buckets (``shared_buckets``), and the sets of large buckets in as many (``prefix_pairs``).
    Returns ``(id, component)`` of linked ids.
    """
    live = shared_buckets(members, slices)
    sets, verify, *sketch = prepare(live) if similarity else (None, prepare(live))
    tried = links = None
    written: list[DataFrame] = []
    before, settled = float("inf"), False
    for k in range(rounds):
        # of a bucket's n members, n - most meet the most common component and each other: a share of it for each member
        total, pairs = live.agg(F.count("*"), F.expr("sum((n - most) * (n + most - 1) / (2D * n))")).first()
        settled = not total or pairs <= max(16 * total, 50_000)
        # where a check needs the members' sets, it costs more than a round
        if not total or pairs <= max(total * (1 if similarity else 4), 50_000) or total > 0.95 * before:
            break
        before = total
        key = F.xxhash64(F.col("id"), F.col("bucket"), F.lit(k))
        lead = live.groupBy("bucket").agg(F.min_by(F.struct("id", "comp"), F.struct(key, "id")).alias("lead"))
        pairs = (
            live.join(lead, "bucket")
            .where(F.col("comp") != F.col("lead.comp"))
            .where(near(F.col("id"), F.col("lead.id")) if near else F.lit(True))
            .select(F.least("id", "lead.id").alias("u"), F.greatest("id", "lead.id").alias("v"), F.least("comp", "lead.comp").alias("cu"), F.greatest("comp", "lead.comp").alias("cv"))
            .distinct()
        )
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        good = materialize(verify(pairs), "links")
        written.append(pairs)
        tried = pairs.select("u", "v") if tried is None else tried.union(pairs.select("u", "v"))
        links = good.select("u", "v") if links is None else links.union(good.select("u", "v"))
        # two hops of least neighbours join nearly all; what they leave apart costs pairs, not links
        hop = good.select(F.inline(F.array(F.struct(F.col("cu").alias("node"), F.col("cv").alias("to")), F.struct(F.col("cv").alias("node"), F.col("cu").alias("to")))))
        hop = materialize(hop.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "hops")
        comps = hop.join(hop.select(F.col("node").alias("to"), F.col("to").alias("component")), "to").select("node", "component")
        # a bucket of two is settled by its only pair
        named = live.where("n > 2").join(comps, F.col("comp") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "comp").alias("comp"), "n")
        named = materialize(named, "named")
        discard(live, hop)
        mixed = named.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.count("*").alias("comps"))
        live = materialize(named.join(mixed.where("comps > 1").drop("comps"), "bucket"), "buckets")
        discard(named)
    small = live
    ordered = similarity and not settled
    if ordered:
        small, large = live.where(F.col("n") <= few), materialize(live.where(F.col("n") > few).select("id", "comp").distinct(), "large")
        # without such buckets the members' sets are not looked at
        ordered = bool(large.limit(1).count())
    close = near(F.col("id"), F.col("id2")) if near else F.lit(True)
    if sketch:
        # compared where they meet: only pairs that sketches leave are written
        small = small.join(sketch[0], "id").withColumn("class", size_class("size", similarity))
        close = may_reach(similarity, F.col("size"), F.col("p"), F.col("size2"), F.col("p2"), longs)
    # sets of the similarity are of one class of sizes or of two that adjoin, so a bucket's other classes need not meet, nor be in one task
    on = ["bucket", "class"] if sketch else ["bucket"]
    other = small.withColumn("class", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1))) if sketch else small
    other = other.select(*on, *[F.col(c).alias(f"{c}2") for c in ("id", "comp", *(("size", "p") if sketch else ()))])
    apart = (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("main")) | (F.col("comp") < F.col("comp2")))
    pairs = small.where("comp <> main").join(other, on).where(apart).where(close).select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v"))
    pairs = (pairs.union(prefix_pairs(large, sets(large) if callable(sets) else sets, similarity, slices)) if ordered else pairs).distinct()
    if near or tried is not None:
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        written.append(pairs)
    good = materialize(verify(pairs), "links")
    good = good.select("u", "v") if links is None else links.union(good.select("u", "v"))
    discard(live, *written)
    return connected_components(good).select(F.col("node").alias("id"), "component")


def shared_units(found: DataFrame, first: DataFrame, comps: DataFrame) -> DataFrame:
    """Occurrences of the classes that hold two or more: ``(key, at, class, head, gone)``.

    ``found(key, doc_id, at, id)`` are all occurrences, ``first(nid, id, lo, hi)`` the distinct units with the least and the
    greatest occurrence, ``comps(id, component)`` the components of linked ``nid``s. Classes are made from distinct units, so
    a unit of very many occurrences counts once; only shared occurrences are joined, and that join's skew can be split."""
    named = first.join(comps.withColumnRenamed("id", "nid"), "nid", "left").withColumn("class", F.coalesce("component", "nid"))
    classes = named.groupBy("class").agg(F.min("lo").alias("head"), F.max("hi").alias("tail")).where(~F.col("head").eqNullSafe(F.col("tail")))
    ids = named.join(classes, "class").select("id", "class", "head")
    gone = (F.col("key") != F.col("head.key")) | (F.col("at") != F.col("head.at"))
    return found.join(ids, "id").select("key", "at", "class", "head", gone.alias("gone"))


def unit_report(occurrences: DataFrame) -> DataFrame:
    """``shared_units`` → one row a ``key``: ``removed`` places, ``n_classes``, ``class_doc_ids``. Repeated rows fall together."""
    return occurrences.groupBy("key").agg(
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("at")))).alias("removed"), F.size(F.collect_set("class")).cast("long").alias("n_classes"),
        F.sort_array(F.collect_set("head.doc_id")).alias("class_doc_ids"),
    )


def text_key() -> Column:
    """128 bits that stand for a row's ``doc_id`` and ``text``."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x01")), F.coalesce(F.col("text"), F.lit("\x01"))).cast("binary")))


def n_lines(text="text") -> Column:
    """Lines with a word."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))).cast("long")
