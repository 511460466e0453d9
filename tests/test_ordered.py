"""Numbers, names and partly known keys against plain Python, with ranges and arrays so small that all paths are taken."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from billforge.operators import dedupe, matching, numbering, reconcile, work


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_numbers_follow_order(spark, range_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None, "b"]), rng.choice([None, *range(40)]), i, "x" * rng.randint(0, 9)) for i in range(400)] + [("hot", 3, 7, "same")] * 5
    d = spark.createDataFrame(rows, "k string, v int, id int, payload string")
    got = numbering.number_rows(d, ["k", ("v", "desc"), "id"], 10, range_rows=range_rows).orderBy("seq").collect()
    low = lambda x: (x is not None, x)
    want = sorted(sorted(sorted(rows, key=lambda r: r[2]), key=lambda r: (r[1] is None, -(r[1] or 0))), key=lambda r: low(r[0]) if r[0] else (False, ""))
    assert [r.seq for r in got] == list(range(11, 11 + len(rows)))
    assert [(r.k, r.v, r.id) for r in got] == [r[:3] for r in want]
    by = numbering.number_rows(d, ["id"], by=["k"], range_rows=range_rows).collect()
    for k in {r[0] for r in rows}:
        own = sorted((r.seq, r.id) for r in by if r.k == k)
        assert [s for s, _ in own] == list(range(1, len(own) + 1)) and [i for _, i in own] == sorted(i for _, i in own)


def test_numbers_keep_every_row(spark):
    """A million wide rows, two thirds of them equal in the first order column, whether or not Spark regroups partitions."""
    d = spark.range(1_000_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("o"), F.xxhash64("id").alias("h"), F.repeat(F.lit("payload"), 8).alias("p"))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            n = numbering.number_rows(d, ["o", "h"])
            assert tuple(n.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()) == (1_000_000, 1_000_000, 1, 1_000_000)
            back = n.select("seq", "o", "h", F.lag(F.struct("o", "h")).over(Window.partitionBy(F.floor((F.col("seq") - 1) / 1000)).orderBy("seq")).alias("prior"))
            assert back.where("prior is not null and prior >= struct(o, h)").count() == 0
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
    assert numbering.number_rows(d.limit(0), ["o"]).count() == 0


def greedy(rows):
    """(key, b, s, order, keep) in order → the order of the first representative that matches."""
    reps, out = {}, {}
    same = lambda x, y: not x or not y or x == y
    for k, b, s, o, keep in sorted(rows, key=lambda r: r[3]):
        hit = None if keep else next((r[2] for r in reps.get(k, []) if same(r[0], b) and same(r[1], s)), None)
        out[o] = hit
        if hit is None:
            reps.setdefault(k, []).append((b, s, o))
    return out


@pytest.mark.parametrize("fold_keys", [0, 3, 10_000])
def test_greedy_in_rounds(spark, fold_keys):
    rng = random.Random(5)
    order = rng.sample(range(5000), 900)
    rows = [(rng.choice(["hot", "hot", "x", "y"]), rng.choice(["", *"abcdefgh"]), rng.choice(["", *"uvwxyz"]), o, rng.random() < 0.05) for o in order]
    d = spark.createDataFrame(rows, "k string, b string, s string, o int, keep boolean")
    got = dedupe.fold_dedupe(d, ["k"], ["b", "s"], ["o"], "o", keep_if=F.col("keep"), fold_keys=fold_keys).select("o", "dup_of").collect()
    assert {r.o: r.dup_of for r in got} == greedy(rows) and len(got) == len(rows)


def test_one_key_of_many_numbers(spark):
    """One code with many different numbers, blank ones among them: rounds, and no array of them."""
    n = 20_000
    d = spark.range(n).select(F.lit("one").alias("k"), F.when(F.col("id") == 777, "").otherwise((F.col("id") % (n // 2)).cast("string")).alias("b"), F.lit("").alias("s"), F.col("id").alias("o"))
    got = dedupe.fold_dedupe(d, ["k"], ["b", "s"], ["o"], "o").select("o", "dup_of").collect()
    assert {r.o: r.dup_of for r in got} == greedy([("one", r.b, r.s, r.o, False) for r in d.collect()])


def test_first_match_and_known_codes(spark):
    rng = random.Random(2)
    side = lambda n: [(i, "s", str(rng.randint(1, 3)), rng.choice(["", "a", "b", "c"]), rng.choice(["", "1", "2"])) for i in range(n)]
    a, b = side(120), side(150)
    cols = "id int, series string, invoice_no string, buyer_name string, seller_tax_id string"
    frame = lambda rows: spark.createDataFrame(rows, cols).withColumn("buyer_tax_id", F.lit(""))
    got = {r.id: r.ex for r in reconcile.first_match(frame(a), frame(b).withColumnRenamed("id", "ex"), "id", "ex", "ex").collect()}
    same = lambda x, y: not x or not y or x == y
    want = {x[0]: next((y[0] for y in b if y[2] == x[2] and same(x[3].upper(), y[3].upper()) and same(x[4], y[4])), None) for x in a}
    assert got == {k: v for k, v in want.items() if v is not None}
    rows = [(i, rng.choice("pqrst"), rng.choice(["", "1", "2", "3"])) for i in range(60)]
    known = [(rng.choice("pqrs"), rng.choice(["1", "2"])) for _ in range(4)] + [("p", "")]
    r, k = spark.createDataFrame(rows, "id int, code string, number string"), spark.createDataFrame(known * 2, "code string, number string")
    hit = {i for i, c, n in rows if any(c == kc and same(n, kn) for kc, kn in known)}
    assert sorted(x.id for x in dedupe.wildcard_semi(r, k).collect()) == sorted(hit)
    assert {x.id for x in dedupe.wildcard_semi(r, k, anti=True).collect()} == {i for i, _, _ in rows} - hit


def one_after_the_other(names, taken, start):
    """Sequential naming: files that are the first of a free name before the rest."""
    there, taken, out = set(taken), set(taken), {}
    firsts = {}
    for i, n in names:
        firsts.setdefault(n, i)
    for i, n in sorted(names, key=lambda x: (firsts[x[1]] != x[0] or x[1] in there, x[0])):
        stem, dot, ext = n.rpartition(".") if "." in n[1:] else (n, "", "")
        name, k = n, start
        while name in taken:
            name = f"{stem}_{k}{dot}{ext}"
            k += 1
        taken.add(name)
        out[i] = name
    return out


@pytest.mark.parametrize("range_rows", [5, 50_000])
def test_free_names(spark, range_rows, monkeypatch):
    monkeypatch.setattr(numbering.number_rows, "__defaults__", (*numbering.number_rows.__defaults__[:-1], range_rows))
    rng = random.Random(8)
    pool = ["a.pdf", "a.pdf", "a.pdf", "a_1.pdf", "a_1.pdf", "a_2.pdf", "a_1_1.pdf", "a_01.pdf", "b", "b_1", ".x", "c.tar.gz", "a.PDF", "a_0.pdf"]
    names = [(i, rng.choice(pool)) for i in range(150)]
    there = ["a_3.pdf", "b", "b_2", "c_1.tar.gz", "c.tar_1.gz", "a_7.pdf"]
    files = spark.createDataFrame([("f", n, i) for i, n in names] + [("g", "a.pdf", 1000)], "folder string, name string, id int")
    got = {r.id: r.unique_name for r in dedupe.numbered_names(files, present=spark.createDataFrame([("f", n) for n in there], "folder string, name string")).collect()}
    assert got == one_after_the_other(names, there, 1) | {1000: "a.pdf"}


def test_moves_of_one_batch(spark):
    files = [("a", "pdf", "x", "t", 1), ("a", "pdf", "y", "t", 2), ("a", "pdf", "x", "t", 3), ("a", "pdf", "y", "t", 4), ("a_2", "pdf", "z", "t", 5), ("b", "pdf", "q", "t", 6), ("b", "pdf", "r", "t", 7), ("c", "", "k", "t", 8), ("a", "pdf", "y", "u", 9)]
    there = [("t", "b", "pdf", "q"), ("t", "b_2", "pdf", "o")]
    f = spark.createDataFrame(files, "stem string, suffix string, sha1 string, target string, id int")
    got = {r.id: (r.action, r.name) for r in work.move_plan(f, spark.createDataFrame(there, "folder string, stem string, suffix string, sha1 string"), "id").collect()}
    assert got == {1: ("move", "a.pdf"), 2: ("move", "a_3.pdf"), 3: ("drop", "a.pdf"), 4: ("move", "a_4.pdf"), 5: ("move", "a_2.pdf"), 6: ("drop", "b.pdf"), 7: ("move", "b_3.pdf"), 8: ("move", "c"), 9: ("move", "a.pdf")}


def test_matching_needs_whole_keys(spark):
    d = spark.createDataFrame([("k", None, 1), (None, "a", 2), ("k", "a", 3)], "k string, b string, o int")
    index = matching.least_index(d, ["k"], ["b"], {"o": F.col("o")})
    assert [tuple(r) for r in matching.least_match(spark.createDataFrame([("k", ""), ("k", None), (None, "a")], "k string, b string"), index, ["k"], ["b"], ["o"], ["k", "b"]).collect()] == [("k", "", 3)]
