"""Invoice XML → invoice rows. A file is parsed once, in a pandas pass; values are then cleaned by column expressions.

A file that is no XML, or that has no number or series, gives a row with ``reject`` and no fields, and never ends the job."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import page_fields, rules
from ..functions.text import file_in_name, fold_accents, plain
from ..schema import NO_PLATE, nz

#: Names of extra fields that hold a vehicle, without accents and spaces.
VEHICLE_FIELDS = ("sophuongtien", "phuongtien", "bienso", "soxe", "bsx", "plate")
_RAW = (
    "reject string, series_code string, form string, number string, issued string, buyer_name string, buyer_tax_id string, seller_name string, seller_tax_id string, "
    "plates array<string>, goods_name string, total string, line_sums array<string>"
)


class Tree:
    """Elements in document order by local name, each with its leading text and the place where its last descendant stands."""

    def __init__(self, content: str | bytes):
        self.names: list[str] = []
        self.texts: list[list[str]] = []
        self.ends: list[int] = []
        open_, p = [], expat.ParserCreate(namespace_separator="}")
        p.StartElementHandler = lambda name, _: (open_.append(len(self.names)), self.names.append(name.rpartition("}")[2]), self.texts.append([]), self.ends.append(0))
        p.EndElementHandler = lambda _: self.ends.__setitem__(open_.pop(), len(self.names) - 1)
        # text before the first child only
        p.CharacterDataHandler = lambda s: self.texts[-1].append(s) if open_ and open_[-1] == len(self.names) - 1 else None
        p.Parse(content if isinstance(content, bytes) else content.lstrip("﻿ \t\r\n").encode(), True)

    def all(self, name: str, at: int | None = 0) -> list[int]:
        """Places of the elements of this name in the one at ``at``, itself included; none in none."""
        return [] if at is None else [i for i in range(at, self.ends[at] + 1) if self.names[i] == name]

    def first(self, name: str, at: int | None = 0) -> int | None:
        return next(iter(self.all(name, at)), None)

    def text(self, name: str, at: int | None = 0) -> str:
        i = self.first(name, at)
        return "" if i is None else "".join(self.texts[i]).strip()

    def party(self, name: str) -> int | None:
        """The invoice body's party; else the first with a name or tax id (signature blocks have neither); else the first."""
        body = self.first(name, self.first("NDHDon"))
        every = self.all(name)
        named = (i for i in every if self.text("Ten", i) or self.text("MST", i))
        return body if body is not None else next(named, every[0] if every else None)


def read_invoice(content: str | bytes | None) -> tuple:
    """The raw values of one file, as ``_RAW``."""
    try:
        t = Tree(content or "")
    except expat.ExpatError as e:
        return (f"NOT_XML: {e}",) + (None,) * 12
    head = t.first("TTChung")
    number, code = t.text("SHDon", head), t.text("KHHDon", head)
    if not number or not code:
        return ("NO_NUMBER_OR_SERIES",) + (None,) * 12
    buyer, seller = t.party("NMua"), t.party("NBan")
    extra = [(plain(t.text("TTruong", i)).lower().replace(" ", ""), t.text("DLieu", i)) for i in t.all("TTin")]
    vehicles = [v for k, v in extra if v and any(x in k for x in VEHICLE_FIELDS)]
    others = [v for k, v in extra if v and not any(x in k for x in VEHICLE_FIELDS)]
    name = t.text("Ten", buyer)
    # the buyer's contact, vehicle fields with the last one first, the phone, other fields, name and address
    plates = [t.text("HVTNMHang", buyer), *vehicles[::-1], t.text("SDThoai", buyer), *others, name, t.text("DChi", buyer)]
    lines = [i for i in t.all("HHDVu") if t.text("TChat", i) in ("", "1")]
    goods = next((x for x in (t.text("THHDVu", i) for i in lines) if x), "")
    return (
        None, code, t.text("KHMSHDon", head), number, t.text("NLap", head), name, t.text("MST", buyer), t.text("Ten", seller), t.text("MST", seller), plates, goods, t.text("TgTCThue", t.first("TToan")),
        [t.text("ThTien", i) for i in lines],
    )


def money(c) -> Column:
    """Commas dropped, rounded half to even."""
    return F.bround(F.regexp_replace(c, ",", "").try_cast("double")).cast("bigint")


def parse_all(files: DataFrame, xml: str = "content", units: DataFrame | None = None, issuer: str | None = None) -> DataFrame:
    """``files(path, content)`` → invoice rows with ``reject``, null for good ones. ``units(tax_id, unit)`` names known buyers."""
    names = [c.split()[0] for c in _RAW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["path"]].reset_index(drop=True), pd.DataFrame([read_invoice(x) for x in b["content"]], columns=names, dtype=object)], axis=1)

    r = files.select("path", F.col(xml).alias("content")).mapInPandas(run, f"path string, {_RAW}")
    bare = lambda c, p: F.regexp_replace(c, p, "")
    total = F.aggregate(F.transform("line_sums", lambda v: F.coalesce(money(v), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, v: s + v)
    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    day = F.when(F.col("issued").rlike(iso), F.concat_ws("/", *[F.regexp_extract("issued", iso, i) for i in (3, 2, 1)])).otherwise(F.col("issued"))
    plates = F.filter(F.transform("plates", page_fields.plate_in), lambda p: p.isNotNull())
    by_seller = F.when(F.contains(F.upper(fold_accents(F.col("seller_name"))), F.lit("PETROLIMEX")), "petrolimex").otherwise("standard")
    good = F.col("reject").isNull()
    rows = r.select(
        file_in_name(F.col("path")).alias("file_stem"), F.when(good, F.lit(issuer) if issuer else by_seller).alias("issuer"), F.lit("xml").alias("doc_kind"), nz("buyer_name").alias("buyer_name"),
        nz(bare(F.col("buyer_tax_id"), r"\s")).alias("buyer_tax_id"), F.upper(F.concat("form", "series_code")).alias("series"), page_fields.unzeroed(F.col("number")).alias("invoice_no"), day.alias("invoice_date"),
        F.coalesce(money(nz("total")), F.nullif(total, F.lit(0).cast("bigint"))).alias("pre_tax_amount"), F.when(good, F.coalesce(F.get(plates, F.lit(0)), F.lit(NO_PLATE))).alias("plate"),
        F.when(good, rules.goods_class(F.col("goods_name"))).alias("goods"), F.lit("xml").alias("provenance"), nz(bare(F.col("seller_tax_id"), r"\s")).alias("seller_tax_id"), F.upper("series_code").alias("series_code"), "reject",
    )
    if units is not None:
        from .reconcile import buyer_unit

        rows = buyer_unit(rows, units)
    return rows


def parse_invoices(files: DataFrame, xml: str = "content", units: DataFrame | None = None) -> DataFrame:
    """The rows of files that are invoices."""
    return parse_all(files, xml, units).where("reject is null").drop("reject", "series_code")
