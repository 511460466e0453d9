"""Pages of a file: groups that form one invoice, missing pages, second readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_pages(pages: DataFrame) -> DataFrame:
    """``pages(file, page_no, series, number, heading)`` → with ``group_no``.

    A page joins the open group if it has the group's (series, number), or if it has neither number, series nor heading. The
    group's identity is set only as it opens, and only where a number was found."""
    rows = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page_no", "series", "number", "heading"))).alias("p"))
    kind = "struct<g:int,id:string,out:array<struct<page_no:int,group_no:int>>>"
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    ident = lambda x: F.when(~blank(x["number"]), F.concat_ws("|", F.coalesce(x["series"], F.lit("")), x["number"]))

    def step(s, x):
        same = (ident(x) == s["id"]) | (ident(x).isNull() & blank(x["series"]) & ~x["heading"])
        joins = (s["g"] > 0) & F.coalesce(same, F.lit(False))
        g = F.when(joins, s["g"]).otherwise(s["g"] + 1)
        return F.struct(g.alias("g"), F.when(joins, s["id"]).otherwise(ident(x)).alias("id"), F.concat(s["out"], F.array(F.struct(x["page_no"].cast("int").alias("page_no"), g.alias("group_no")))).alias("out")).cast(kind)

    start = F.struct(F.lit(0).alias("g"), F.lit(None).cast("string").alias("id"), F.array().cast("array<struct<page_no:int,group_no:int>>").alias("out")).cast(kind)
    return rows.select("file", F.inline(F.aggregate("p", start, step)["out"]))


def missing_pages(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Pages that have an image but no row."""
    return images.join(rows, ["file", "page_no"], "left_anti")


def gaps(rows: DataFrame) -> DataFrame:
    """Page numbers missing below each file's last one."""
    top = rows.groupBy("file").agg(F.max("page_no").alias("top"))
    return top.select("file", F.explode(F.sequence(F.lit(1), F.col("top").cast("int"))).alias("page_no")).join(rows, ["file", "page_no"], "left_anti")
