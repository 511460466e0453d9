"""Named SQL functions, the suppliers' registry, and the page table function."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import html, money, text
from . import patterns as P

#: SQL bodies over ``x``: they stay in the JVM.
SQL_FUNCTIONS = {
    "norm_code": "upper(trim(regexp_replace(trim(coalesce(x, '')), '[*]+$', '')))",
    "norm_number": "upper(regexp_replace(regexp_replace(trim(coalesce(x, '')), '[.]0+$', ''), '^0+', ''))",
    "digits_key": "regexp_replace(regexp_replace(coalesce(x, ''), '[^0-9]', ''), '^0+', '')",
    "fold_accents": text.FOLD_SQL,
    "words_to_number": money.WORDS_SQL,
    "is_suspicious_number": "cast(length(regexp_replace(coalesce(x, ''), '[^0-9]', '')) not between 4 and 8 or regexp_replace(coalesce(x, ''), '[^0-9]', '') rlike '^(010|030|031)' as string)",
}


def register(spark: SparkSession) -> list[str]:
    """Registers the SQL functions and the table functions with the session, temporarily; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns {'bigint' if name == 'words_to_number' else 'string'} return {body}")
    spark.udtf.register("page_numbers", F.udtf(PageNumbers, returnType="line_no int, kind string, value string"))
    spark.udtf.register("page_groups", F.udtf(PageGroups))
    return [*SQL_FUNCTIONS, "page_numbers", "page_groups"]


class PageNumbers:
    """Candidates of a page's text: amounts and invoice numbers, with their line."""

    def eval(self, page: str):
        for i, line in enumerate(text.plain(page).splitlines()):
            for v in re.findall(P.GROUPED_OR_PLAIN, re.sub(r"(?<=[\s|])[%§](?=\d)", "8", line)):
                n = int(re.sub(r"\D", "", v))
                if P.MIN_AMOUNT <= n <= (P.MAX_AMOUNT if re.search("[.,]", v) else P.MAX_PLAIN_AMOUNT):
                    yield i, "amount", str(n)
            if not re.search(P.NUMBER_SKIP, line, re.I):
                for v in re.findall(P.NUMBER_ANY, line):
                    yield i, "number", v.lstrip("0") or v


class PageGroups:
    """``page_groups(TABLE(...))``: pages ``(file, page_no, series, number, heading)`` → ``file, page_no, group_no``, the invoice of its file that a
    page belongs to, by the rule of ``operators.pages.group_pages``. It asks for its rows by file and in order of the pages, so nobody has to say so
    in the call; a file's pages pass one by one, and nothing is held but the group."""

    @staticmethod
    def analyze(pages):
        from pyspark.sql import types as T
        from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn

        names = [] if pages.dataType is None else pages.dataType.fieldNames()
        for c in ("file", "page_no", "series", "number", "heading"):
            if c not in names:
                raise ValueError(f"pages need a column {c}")
        out = T.StructType([T.StructField("file", pages.dataType["file"].dataType), T.StructField("page_no", T.IntegerType()), T.StructField("group_no", T.IntegerType())])
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("file")], orderBy=[OrderingColumn("page_no")])

    def __init__(self):
        self.group, self.held = 0, None

    def eval(self, page):
        ident = f"{page['series'] or ''}|{page['number']}" if page["number"] else None
        nothing = ident is None and not page["series"] and page["heading"] is False
        if not (self.group and (nothing or ident is not None and ident == self.held)):
            self.group, self.held = self.group + 1, ident
        yield page["file"], page["page_no"], self.group


@dataclass
class Suppliers:
    """Suppliers by priority: the first whose matcher takes a domain gives the key, and by it the link's rule."""

    entries: list[tuple[int, str, Callable[[Column], Column], Callable[[Column], Column]]] = field(default_factory=list)

    def add(self, key: str, priority: int, matcher: Callable[[Column], Column], extractor: Callable[[Column], Column]) -> None:
        self.entries = sorted([*self.entries, (priority, key, matcher, extractor)], key=lambda e: e[:2])

    def key(self, domain: Column) -> Column:
        out = F.lit(None).cast("string")
        for _, key, matcher, _ in reversed(self.entries):
            out = F.when(matcher(domain), key).otherwise(out)
        return out

    def link(self, domain: Column, links: Column) -> Column:
        out, key = F.lit(None).cast("string"), self.key(domain)
        for _, name, _, extractor in self.entries:
            out = F.when(key == name, extractor(links)).otherwise(out)
        return out


def default_suppliers() -> Suppliers:
    s = Suppliers()
    for i, (part, key) in enumerate(html.DOMAIN_RULES):
        s.add(key, i, lambda d, part=part: F.contains(F.lower(d), F.lit(part)), html.LINK_RULES[key])
    return s
