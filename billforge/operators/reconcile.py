"""Merging invoice rows of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits_key, fold_accents, norm_code, norm_number
from ..schema import blank_cell, blank_value
from .dedupe import fold_dedupe
from .matching import least_index, least_match
from .numbering import number_rows

#: Buyer keys that say there is no name.
NO_NAMES = ("", "NAN", "NONE", "CAN KIEM TRA")


def _digits(c) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def buyer_unit(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``buyer_name`` replaced by the unit that ``units(tax_id, unit)`` has for the tax id's digits; the first of equal ids."""
    u = units.groupBy(F.col("tax_id").alias("_tax")).agg(F.min("unit").alias("_unit"))
    return rows.withColumn("_tax", _digits(F.col("buyer_tax_id"))).join(u, "_tax", "left").withColumn("buyer_name", F.coalesce("_unit", "buyer_name")).drop("_tax", "_unit")


def with_identity(rows: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Adds series_key, number_key, buyer_key and seller_key; blanks match anything, a blank number nothing.

    The buyer's key is the unit of the tax id's first ten digits, where ``units(tax_id, unit)`` has one, else the name; without
    accents and case, and blank where the name says that there is none. Series and number: upper case, digits without zeros."""
    if units is not None:
        u = units.groupBy(F.col("tax_id").alias("_tax")).agg(F.min("unit").alias("_unit"))
        rows = rows.withColumn("_tax", F.substring(_digits(F.col("buyer_tax_id")), 1, 10)).join(u, "_tax", "left").drop("_tax")
    name = F.coalesce("_unit", "buyer_name") if units is not None else F.col("buyer_name")
    key = F.trim(F.regexp_replace(F.upper(fold_accents(name)), "[^A-Z0-9]+", " "))
    out = rows.withColumns({
        "series_key": F.upper(F.trim(F.coalesce("series", F.lit("")))), "number_key": digits_key(F.col("invoice_no")), "buyer_key": F.when(key.isin(*NO_NAMES), "").otherwise(key), "seller_key": _digits(F.col("seller_tax_id")),
    })
    return out.drop("_unit")


def priority_union(sources: list[DataFrame], order: list[str], id_col: str, units: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """All sources' rows in order of priority, later rows of a known invoice dropped; ``source_rank`` counts from 0.

    With ``present(stem)``, rows of the last source count only if their file, without page number, is still there, or if they name none."""
    rows = None
    for rank, s in enumerate(sources):
        if present is not None and rank == len(sources) - 1:
            s = s.withColumn("_stem", F.regexp_replace(F.coalesce("file_stem", F.lit("")), r"_p\d+$", ""))
            named = s.where("_stem <> ''").join(present.select(F.col("stem").alias("_stem")).distinct(), "_stem", "left_semi")
            s = named.unionByName(s.where("_stem = ''")).drop("_stem")
        s = s.withColumn("source_rank", F.lit(rank))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    rows = with_identity(rows, units)
    out = fold_dedupe(rows, ["series_key", "number_key"], ["buyer_key", "seller_key"], ["source_rank", *order], id_col, never_if=F.col("number_key") == "")
    return out.where("dup_of is null").drop("dup_of")


def first_match(incoming: DataFrame, existing: DataFrame, in_id: str, ex_id: str, ex_order: str, units: DataFrame | None = None) -> DataFrame:
    """``(in_id, ex_id)``: the first existing row of the same series and number whose buyer and seller fit."""
    exact, loose = ["series_key", "number_key"], ["buyer_key", "seller_key"]
    a = with_identity(incoming, units).where("number_key <> ''")
    b = with_identity(existing, units).where("number_key <> ''").withColumn("_o", F.struct(F.col(ex_order).alias("o"), F.col(ex_id).alias("id")))
    # rows of equal keys find the same: each different key asks once
    asked = a.select(*exact, *loose).distinct()
    hit = least_match(asked, least_index(b, exact, loose, {"_o": F.col("_o")}), exact, loose, ["_o"], [*exact, *loose])
    return a.join(hit, [*exact, *loose]).select(in_id, F.col("_o.id").alias(ex_id))


def merge_xml(existing: DataFrame, incoming: DataFrame, order: str, fields: tuple[str, ...], units: DataFrame | None = None) -> DataFrame:
    """Result rows with the rows of XML files merged in: both have ``order``, ``fields`` and the identity's columns.

    An incoming row goes to the first row of its identity, existing ones first, or is added. A row that was read from a document is
    replaced once, but for its file name and, where the XML has none, its plate; a row from XML only has its blanks filled, by each
    incoming row in turn. Adds ``outcome``: kept, added, replaced or filled."""
    every = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    every = with_identity(every, units).withColumn("_id", F.struct("_new", order))
    d = fold_dedupe(every, ["series_key", "number_key"], ["buyer_key", "seller_key"], [], "_id", keep_if=F.col("_new") == 0, never_if=F.col("number_key") == "")
    d = d.withColumn("_of", F.coalesce("dup_of", "_id"))
    own = d.groupBy("_of").agg(F.array_sort(F.collect_list(F.struct("_id", *fields))).alias("x"))
    head, rest = F.get("x", F.lit(0)), F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0)))
    scanned = (F.col("_of._new") == 0) & (F.lower(F.trim(F.coalesce(head["provenance"], F.lit("")))) != "xml") & (F.size("rest") > 0)
    text = lambda c: c.cast("string")

    def merged(f: str) -> Column:
        first, later = head[f], F.transform("rest", lambda r: r[f])
        new = F.get(later, F.lit(0))
        if f == "file_stem":
            return F.when(scanned & blank_value(text(first)), new).otherwise(first)
        base = F.when(blank_cell(text(new)) & ~blank_cell(text(first)), first).otherwise(new) if f == "plate" else new
        filled = lambda b, xs: F.when(blank_cell(text(b)), F.coalesce(F.get(F.filter(xs, lambda v: ~blank_cell(text(v))), F.lit(0)), b)).otherwise(b)
        return F.when(scanned, filled(base, F.slice(later, 2, F.greatest(F.size(later) - 1, F.lit(0))))).otherwise(filled(first, later))

    out = own.withColumn("rest", rest)
    can_fill = lambda f: blank_cell(text(head[f])) & F.exists(F.transform("rest", lambda r: ~blank_cell(text(r[f]))), lambda x: x)
    gained = reduce(lambda a, f: a | can_fill(f), (f for f in fields if f != "file_stem"), F.lit(False))
    outcome = F.when(scanned, "replaced").when(F.col("_of._new") == 1, "added").when(gained, "filled").otherwise("kept")
    return out.select(F.col(f"_of.{order}").alias(order), F.col("_of._new").alias("added"), *[merged(f).alias(f) for f in fields], outcome.alias("outcome"))


def lookup_ranked(rows: DataFrame, dims: list[DataFrame], key: str, value: str) -> DataFrame:
    """Left join to the union of dimension tables; a key's value comes from the first table that has it."""
    every = None
    for rank, d in enumerate(dims):
        d = d.select(key, value, F.lit(rank).alias("_r"))
        every = d if every is None else every.union(d)
    best = every.groupBy(key).agg(F.min_by(value, "_r").alias(value))
    return rows.join(best, key, "left")


def prefix_lookup(rows: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """``names(key, tax_id, ordinal)``: the first key that equals the name or is its beginning, at a word's end.

    Every beginning of a name at a word's end is joined on equality, so no pair of a name and a foreign key is made."""
    words = F.split(F.col(name), " ")
    starts = rows.select(name).distinct().withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))))
    hit = starts.join(names, "key").groupBy(name).agg(F.min_by("tax_id", "ordinal").alias("tax_id"))
    return rows.join(hit, name, "left")


def continue_sequence(new: DataFrame, last: int, order: list) -> DataFrame:
    """``new`` with ``seq``, from ``last`` + 1 on in the given order (``numbering.number_rows``)."""
    return number_rows(new, order, last)


def last_filled(rows: DataFrame, position: str, *columns: str) -> DataFrame:
    """One row: the last ``position`` at which one of the columns is filled, 0 for none, and the greatest of them all."""
    filled = F.lit(False)
    for c in columns:
        filled = filled | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return rows.agg(F.coalesce(F.max(F.when(filled, F.col(position))), F.lit(0)).alias("last"), F.count("*").alias("rows"))


def append_master(master: DataFrame, new: DataFrame, order: list[str], position: str = "row_no", seq: str = "seq") -> DataFrame:
    """``new`` as rows to append: after the master's last filled row, its sequence continued (a sequence that is no number counts as the row's place)."""
    end = last_filled(master, position, "code", "number").first()
    held = master.where(F.col(position) == end["last"]).agg(F.max(F.col(seq).cast("string").try_cast("bigint")).alias("s")).first() if end["last"] else None
    base = held["s"] if held and held["s"] is not None else end["last"]
    out = continue_sequence(new, 0, order)
    return out.withColumn(position, F.lit(end["last"]) + F.col("seq")).withColumn(seq, F.lit(base) + F.col("seq"))


def known_codes(sheets: DataFrame) -> DataFrame:
    """A master workbook's ``(code, number)`` of all sheets → ``code, numbers``: the normal forms, a blank number for rows without one."""
    k = sheets.select(norm_code(F.col("code")).alias("code"), norm_number(F.col("number")).alias("number")).where("code <> ''")
    return k.groupBy("code").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
