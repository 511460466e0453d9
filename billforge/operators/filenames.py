"""Matching invoices to files by what the file names hold.

Numbers and codes are taken out of the names and joined on equality, so no pair of a file and a foreign invoice is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits_key


def _numbers(stem) -> Column:
    """The digit runs of a name without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.regexp_replace(n, "^0+", "")))


def _code(series) -> Column:
    """A series without its leading form number."""
    s = F.upper(F.trim(F.coalesce(series, F.lit(""))))
    return F.when(F.rlike(s, F.lit(r"^\d.{6}$")), F.substring(s, 2, 6)).otherwise(s)


def _lengths(values: DataFrame, column: str) -> list[int]:
    """The different lengths of a column's values: as many numbers as the longest value has characters at most."""
    return sorted(r[0] for r in values.select(F.length(column)).distinct().collect() if r[0])


def holding(stems: DataFrame, codes: DataFrame) -> DataFrame:
    """``(stem, ord, _c)``: which of ``codes(_c)`` a name holds as a part of it, case aside. Names give their pieces of the codes' lengths, and
    these meet the codes on equality."""
    up = F.upper("stem")
    piece = lambda n: F.when(F.length("stem") >= n, F.transform(F.sequence(F.lit(1), F.length("stem") - n + 1), lambda i: F.substr(up, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    lengths = _lengths(codes, "_c")
    pieces = F.array_distinct(F.concat(*map(piece, lengths))) if lengths else F.array().cast("array<string>")
    return stems.select("stem", "ord", F.explode(pieces).alias("_c")).join(codes, "_c", "left_semi")


def match_stems(rows: DataFrame, stems: DataFrame) -> DataFrame:
    """``rows(xml_stem, series, invoice_no)`` with ``pdf_stem``. In order: the same name; names with number and series; with the number; with
    one of the name's own codes (8 or more characters, letters and digits) as a part or at the end; else the row's own name. Of several the
    shortest, then the first in ``stems(stem, ord)``.

    What names hold is an index: under each number, number with series, and code, the best name only. A row asks by equality, so a number
    that many names and many rows hold makes no pairs of them."""
    r = rows.withColumns({"_n": digits_key(F.col("invoice_no")), "_c": _code(F.col("series"))})
    key, best = ["xml_stem", "_n", "_c"], F.min(F.struct(F.length("stem").alias("n"), F.col("ord").alias("o"), F.col("stem").alias("stem"))).alias("_best")
    asked = r.select(*key).distinct()
    tier = lambda d, t: d.select(*key, F.struct(F.lit(t).alias("tier"), "_best").alias("_hit"))
    same = asked.join(stems.groupBy(F.col("stem").alias("xml_stem")).agg(best), "xml_stem")
    numbers = stems.select("stem", "ord", F.explode(_numbers("stem")).alias("_n")).join(asked.select("_n").where("_n <> ''").distinct(), "_n", "left_semi")
    held = holding(stems, asked.select("_c").where("_c <> ''").distinct())
    both = numbers.join(held.select("stem", "ord", "_c"), ["stem", "ord"]).groupBy("_n", "_c").agg(best)
    tokens = F.filter(F.split(F.upper("xml_stem"), r"[_\-\s]+"), lambda t: (F.length(t) >= 8) & F.rlike(t, F.lit("[A-Z]")) & F.rlike(t, F.lit("[0-9]")))
    own = asked.select(*key, F.explode(F.array_distinct(tokens)).alias("k"))
    up = F.upper("stem")
    ends = [F.when(F.length("stem") >= n, F.right(up, F.lit(n))) for n in _lengths(own, "k")]
    keys = F.array_distinct(F.concat(F.slice(F.split(up, "_"), F.lit(2), F.greatest(F.size(F.split(up, "_")) - 1, F.lit(0))), F.array_compact(F.array(*ends)) if ends else F.array().cast("array<string>")))
    codes = stems.select("stem", "ord", F.explode(keys).alias("k")).join(own.select("k").distinct(), "k", "left_semi").groupBy("k").agg(best)
    hits = tier(same, 0).union(tier(asked.join(both, ["_n", "_c"]), 1)).union(tier(asked.join(numbers.groupBy("_n").agg(best), "_n"), 2)).union(tier(own.join(codes, "k"), 3))
    found = hits.groupBy(*key).agg(F.min("_hit").alias("_hit"))
    return r.join(found, key, "left").withColumn("pdf_stem", F.coalesce("_hit._best.stem", "xml_stem")).drop("_hit", "_n", "_c")


def duplicate_files(stems: DataFrame, rows: DataFrame, present: DataFrame) -> DataFrame:
    """``stem, dup_of``: files whose name says that they repeat an invoice whose own file is present: the same name with ``_k`` after it, or a
    name with the invoice's series code (5 or more characters) and number (3 or more digits). The first row by ``ord`` wins.

    Of each number and code the first row is kept, and the first with another file, as a file is no repeat of itself."""
    r = rows.join(present.select(F.col("stem").alias("file_stem")).distinct(), "file_stem", "left_semi").select("file_stem", "ord", digits_key(F.col("invoice_no")).alias("_n"), _code(F.col("series")).alias("_c"))
    s = stems.select("stem", F.lit(0).alias("ord")).distinct()
    order = F.min(F.struct("ord", "file_stem"))
    by_name = s.select("stem", F.regexp_replace("stem", r"_\d+$", "").alias("file_stem")).where("stem <> file_stem").join(r.groupBy("file_stem").agg(order.alias("_hit")), "file_stem").select("stem", "_hit")
    long = r.where((F.length("_n") >= 3) & (F.length("_c") >= 5))
    first = long.groupBy("_n", "_c").agg(order.alias("_first"))
    second = long.join(first, ["_n", "_c"]).where("file_stem <> _first.file_stem").groupBy("_n", "_c").agg(order.alias("_second"))
    named = s.select("stem", "ord", F.explode(_numbers("stem")).alias("_n")).join(holding(s, long.select("_c").distinct()), ["stem", "ord"])
    by_number = named.join(first, ["_n", "_c"]).join(second, ["_n", "_c"], "left").select("stem", F.when(F.col("_first.file_stem") != F.col("stem"), F.col("_first")).otherwise(F.col("_second")).alias("_hit")).where("_hit is not null")
    return by_name.union(by_number).groupBy("stem").agg(F.min("_hit")["file_stem"].alias("dup_of"))
