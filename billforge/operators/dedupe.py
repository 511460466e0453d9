"""Duplicates under keys that are only partly known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .matching import least_index, least_match, settle_greedy, wildcard
from .numbering import number_rows


#: Different loose keys of one exact key up to which they are folded as one array.
FOLD_KEYS = 256


def fold_dedupe(rows: DataFrame, exact: list[str], loose: list[str], order: list[str], id_col: str, keep_if: Column | None = None, never_if: Column | None = None, fold_keys: int = FOLD_KEYS) -> DataFrame:
    """``rows`` with ``dup_of``: the first earlier representative of the same exact keys that matches on all loose keys.

    Duplicates never represent. The relation is not transitive, so a key's rows are settled in order. Only distinct loose
    keys can differ in what they match: their first rows are settled, and all other rows follow by a join. A key of few distinct loose
    keys is folded as an array; one of many is settled in rounds (``matching.settle_greedy``), with the same result.
    Rows with ``keep_if`` always represent; rows with ``never_if`` (a blank exact key) are never compared.
    """
    keep = F.coalesce(keep_if, F.lit(False)) if keep_if is not None else F.lit(False)
    never = F.coalesce(never_if, F.lit(False)) if never_if is not None else F.lit(False)
    base = rows.withColumn("_ord", F.struct(*[c for c in order if c != id_col], id_col)).withColumn("_keep", keep).withColumn("_never", never)
    live = base.where(~F.col("_never"))
    # of equal loose keys the first row, and the first that is kept by force, decide for the rest
    first = written(live.groupBy(*exact, *loose, "_keep").agg(F.min("_ord").alias("o")), "first")
    many = first.groupBy(*exact).agg(F.count("*").alias("_size")).where(F.col("_size") > fold_keys).select(*exact)
    if not many.limit(1).count():
        return _by_array(base, first, exact, loose, id_col)
    named = many.withColumn("_large", F.lit(True))
    base = base.join(named, exact, "left")
    large_rows, small_rows = base.where("_large").drop("_large"), base.where("_large is null").drop("_large")
    large_first, small_first = first.join(many, exact, "left_semi"), first.join(many, exact, "left_anti")
    return _by_array(small_rows, small_first, exact, loose, id_col).unionByName(_by_rounds(large_rows, large_first, exact, loose, id_col))


def _by_rounds(base: DataFrame, first: DataFrame, exact: list[str], loose: list[str], id_col: str) -> DataFrame:
    reps = settle_greedy(first, exact, loose)
    index = least_index(reps, exact, loose, {"rep": F.col("o")})
    combos = first.select(*exact, *loose).distinct()
    heads = combos.join(least_match(combos, index, exact, loose, ["rep"], [*exact, *loose]), [*exact, *loose])
    out = base.join(heads, [*exact, *loose], "left")
    return out.withColumn("dup_of", F.when(~F.col("_keep") & ~F.col("_never") & (F.col("rep") < F.col("_ord")), F.col("rep")[id_col])).drop("_ord", "_keep", "_never", "rep")


def _by_array(base: DataFrame, first: DataFrame, exact: list[str], loose: list[str], id_col: str) -> DataFrame:
    groups = first.groupBy(*exact).agg(F.array_sort(F.collect_list(F.struct("o", F.col("_keep").alias("keep"), *loose))).alias("g"))
    rep_type = f"array<struct<o:{base.schema['_ord'].dataType.simpleString()},{','.join(f'{k}:{first.schema[k].dataType.simpleString()}' for k in loose)}>>"

    def match(r, x):
        return reduce(lambda a, k: a & wildcard(r[k], x[k]), loose, F.lit(True))

    reps = F.aggregate(
        "g", F.array().cast(rep_type),
        lambda acc, x: F.when(x["keep"] | ~F.exists(acc, lambda r: match(r, x)), F.concat(acc, F.array(F.struct(x["o"].alias("o"), *[x[k].alias(k) for k in loose])))).otherwise(acc),
    )
    out = base.join(groups.select(*exact, reps.alias("_reps")), exact, "left")
    mine = F.struct(*loose)
    # a forced representative only covers rows after it
    hit = F.get(F.filter("_reps", lambda r: (r["o"] < F.col("_ord")) & match(r, mine)), F.lit(0))["o"][id_col]
    return out.withColumn("dup_of", F.when(~F.col("_keep") & ~F.col("_never"), hit)).drop("_ord", "_keep", "_never", "_reps")


def wildcard_semi(rows: DataFrame, known: DataFrame, code: str = "code", number: str = "number", anti: bool = False) -> DataFrame:
    """Rows whose code is known with a number that is equal, or blank on either side; or, with ``anti``, the others.

    A code's numbers are looked up under what both sides know, so a code of very many numbers makes no pairs."""
    k = known.select(F.col(code).alias("_c"), F.col(number).alias("_n"))
    # a code is found under each of its numbers, by rows without a number, and, where it is known without one, by all rows
    own = k.where("_n is not null").union(k.select("_c", F.lit("").alias("_n"))).distinct()
    blank = k.where("_n = ''").select(F.col("_c").alias("_b")).distinct()
    exact, any_number = (F.col(code) == F.col("_c")) & (F.col(number) == F.col("_n")), F.col(code) == F.col("_b")
    if anti:
        return rows.join(own, exact, "left_anti").join(blank, any_number, "left_anti")
    hit = rows.join(own.withColumn("_hit", F.lit(True)), exact, "left").drop("_c", "_n").join(blank.withColumn("_any", F.lit(True)), any_number, "left").drop("_b")
    return hit.where("_hit or _any").drop("_any", "_hit")


def identical(files: DataFrame, content: str, id_col: str) -> DataFrame:
    """Byte-identical files by size and hash: the smallest id of each content stays."""
    f = files.select(F.col(id_col).alias("id"), F.octet_length(content).alias("size"), F.sha1(F.col(content).cast("binary")).alias("sha1"))
    heads = f.groupBy("size", "sha1").agg(F.min("id").alias("kept"), F.count("*").alias("copies"))
    return f.join(heads, ["size", "sha1"]).select("id", "size", "sha1", "kept", "copies")


def numbered_names(files: DataFrame, folder: str = "folder", name: str = "name", order: str = "id", present: DataFrame | None = None, start: int = 1) -> DataFrame:
    """``files`` with ``unique_name``, unique in their folder and against ``present(folder, name)``.

    As if files were taken one after the other, those that are the first of a free name before all others: they keep it. Each of the rest gets
    the least free number behind its stem, from ``start`` on, numbers that a present or a wanted name has being taken. The r-th free number is
    found without looking for it: taken numbers and requests stand in one order, and a request's place there is its number."""
    cols = files.columns
    dot = r"(?s)^(.+)(\.[^.]*)$"
    parts = lambda c: (F.when(F.rlike(c, F.lit(dot)), F.regexp_extract(c, dot, 1)).otherwise(c), F.when(F.rlike(c, F.lit(dot)), F.regexp_extract(c, dot, 2)).otherwise(""))
    kind = files.schema[name].dataType.simpleString()
    there = (files.select(F.col(folder).alias("_f"), F.col(name).alias("_w")).limit(0) if present is None else present.select(F.col(folder).alias("_f"), F.col(name).alias("_w"))).distinct()
    asked = number_rows(files, [order], by=[folder, name], out="_k")
    held = there.withColumn("_held", F.lit(True))
    asked = asked.join(held, F.col(folder).eqNullSafe(F.col("_f")) & F.col(name).eqNullSafe(F.col("_w")), "left").drop("_f", "_w")
    free = F.col("_held").isNull() & (F.col("_k") == 1)
    asked = asked.withColumn("_r", F.when(~free, F.col("_k") - F.when(F.col("_held").isNull(), 1).otherwise(0))).drop("_held")
    stem, ext = parts(F.col(name))
    asked = written(asked.withColumns({"_stem": stem, "_ext": ext}), "names")
    # numbers that names have taken: the digits behind the last underscore, as they would be written
    names = asked.select(F.col(folder).alias("_f"), F.col(name).alias("_w")).union(there).distinct()
    stem, ext = parts(F.col("_w"))
    digits = r"(?s)^(.*)_([1-9][0-9]{0,17}|0)$"
    taken = names.select("_f", stem.alias("_s"), ext.alias("_e")).where(F.rlike("_s", F.lit(digits))).select("_f", F.regexp_extract("_s", digits, 1).alias("_stem"), "_e", F.regexp_extract("_s", digits, 2).cast("long").alias("_n")).where(F.col("_n") >= start)
    wanted = asked.where("_r is not null").select(F.col(folder).alias("_f"), "_stem", F.col("_ext").alias("_e"), "_r")
    stems = wanted.select("_f", "_stem", "_e").distinct()
    on = lambda a, b: F.col(f"{a}._f").eqNullSafe(F.col(f"{b}._f")) & (F.col(f"{a}._stem") == F.col(f"{b}._stem")) & (F.col(f"{a}._e") == F.col(f"{b}._e"))
    taken = taken.alias("t").join(stems.alias("s"), on("t", "s"), "left_semi")
    family = ["_f", "_stem", "_e"]
    # numbers free before a taken one; a request comes behind all taken numbers with fewer free before them than its rank
    gaps = number_rows(taken, ["_n"], by=family, out="_j").select(*family, (F.col("_n") - start - F.col("_j") + 1).alias("_at"), F.lit(0).alias("_ask"), F.lit(None).cast("long").alias("_r"))
    line = gaps.union(wanted.select(*family, (F.col("_r") - 1).alias("_at"), F.lit(1).alias("_ask"), F.col("_r")))
    spot = number_rows(line, ["_at", "_ask"], by=family, out="_p").where("_ask = 1").select(*family, "_r", "_p")
    named = asked.alias("a").join(spot.alias("p"), F.col(f"a.{folder}").eqNullSafe(F.col("p._f")) & (F.col("a._stem") == F.col("p._stem")) & (F.col("a._ext") == F.col("p._e")) & (F.col("a._r") == F.col("p._r")), "left")
    number = (F.col("p._p") + (start - 1)).cast("string")
    made = F.when(F.col("a._r").isNull(), F.col(f"a.{name}")).otherwise(F.concat("a._stem", F.lit("_"), number, "a._ext"))
    return named.select(*[F.col(f"a.{c}") for c in cols], made.cast(kind).alias("unique_name"))
