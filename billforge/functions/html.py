"""Anchors of message bodies, and the choice of an invoice link among them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_LINK = StructType([StructField(n, StringType()) for n in ("href", "text", "before", "after", "parent")])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """The visible text, and anchors as places in it: of the anchor, and of the element around it."""

    def __init__(self) -> None:
        super().__init__()
        self.text, self.size, self.skip = [], 0, 0
        self.open: list[tuple[str, int, list[dict]]] = [("", 0, [])]  # tag, where it begins, its anchors
        self.links: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in _VOID:
            return
        href = (dict(attrs).get("href") or "").strip()
        if tag == "a" and href:
            link = {"href": href, "begin": self.size, "end": None, "around": (self.open[-1][1], None)}
            self.links.append(link)
            self.open[-1][2].append(link)
        self.open.append((tag, self.size, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if any(t == tag for t, _, _ in self.open[1:]):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, begin, own = self.open.pop()
        for link in own:
            link["around"] = (begin, self.size)
            link["end"] = self.size if link["end"] is None else link["end"]
        if tag == "a" and self.open:
            for link in self.open[-1][2]:
                link["end"] = self.size if link["end"] is None else link["end"]
        return tag

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.size += len(data)


def _parse(html: str | None) -> tuple[str, list[dict]]:
    p = _Reader()
    p.feed(html or "")
    p.close()
    while p.open:
        p._close()
    whole = "".join(p.text)
    one = lambda a, b: " ".join(whole[a:b].split())
    links = [
        {"href": x["href"], "text": one(x["begin"], x["end"]), "before": one(x["around"][0], x["begin"])[-400:], "after": one(x["end"], x["around"][1])[:400], "parent": one(*x["around"])}
        for x in p.links
    ]
    return whole, links


@F.pandas_udf(ArrayType(_LINK))
def anchors(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Anchors with a target: their text, the text before and after them in the element around them (400 characters), and all of its text."""
    for s in it:
        yield s.map(lambda h: _parse(h)[1])


@F.pandas_udf(StringType())
def visible_text(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text lines without scripts and styles."""
    for s in it:
        yield s.map(lambda h: "\n".join(x for x in (" ".join(y.split()) for y in _parse(h)[0].split("\n")) if x))


def _holds(c, *parts: str) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(c), p))


def _first(links, *tiers) -> Column:
    """The target of the first anchor that the first tier with any takes."""
    return F.coalesce(*[F.get(F.filter(links, t), F.lit(0))["href"] for t in tiers])


def pick_link(links, marker: str, host: str, prefer: str = "") -> Column:
    """The first anchor whose text holds ``marker`` and whose target is on ``host``; one with ``prefer`` in it goes first."""
    ok = lambda a: _holds(a["text"], marker) & _holds(a["href"], host)
    return _first(links, *([lambda a: ok(a) & F.contains(a["href"], F.lit(prefer))] if prefer else []), ok)


def second_link(links) -> Column:
    """Of the anchors that read "link": the one that is followed by a note on the PDF, else the second, else the only one."""
    own = F.filter(links, lambda a: F.lower(a["text"]) == "link")
    noted = F.get(F.filter(own, lambda a: _holds(a["after"], "tải nhanh", "dạng pdf")), F.lit(0))["href"]
    return F.coalesce(noted, F.when(F.size(own) >= 2, F.get(own, F.lit(1))["href"]).otherwise(F.get(own, F.lit(0))["href"]))


def exported_link(links, host: str) -> Column:
    own = lambda a: _holds(a["href"], host) & (F.lower(a["text"]) == "link")
    return _first(links, lambda a: own(a) & _holds(a["href"], "export=pdf"), own)


#: How each supplier's messages link to an invoice.
LINK_RULES = {
    "easyinvoice": second_link,
    "meinvoice": lambda x: pick_link(x, "tra cứu", "meinvoice.vn"),
    "pvoil": lambda x: _first(x, lambda a: _holds(a["text"], "tại đây", "here") & _holds(a["href"], "hoadon.pvoil.vn")),
    "smartsign": lambda x: exported_link(x, "tracuuhd.smartsign.com.vn"),
    "fast": lambda x: _first(x, lambda a: _holds(a["text"], "nhấn vào đây", "click here") & _holds(a["parent"], "pdf file")),
    "ehoadon": lambda x: _first(x, lambda a: _holds(a["href"], "ehoadon.vn") & ~F.contains(a["href"], F.lit("hdpb6a")) & (_holds(a["text"], "tracuu.ehoadon.vn") | F.regexp_replace(a["text"], r"\s", "").rlike(r"(?U)^\w+$"))),
    "vnpt": lambda x: _first(x, lambda a: _holds(a["text"], "tải pdf", "tai pdf"), lambda a: _holds(a["href"], "vnpt-invoice.com.vn") & _holds(a["href"], "pdf"), lambda a: _holds(a["href"], "vnpt-invoice.com.vn")),
}
#: Parts of a supplier's domain, in this order.
DOMAIN_RULES = (("easyinvoice", "easyinvoice"), ("meinvoice.vn", "meinvoice"), ("pvoil", "pvoil"), ("smartsign.com.vn", "smartsign"), ("fast", "fast"), ("ehoadon.vn", "ehoadon"), ("vnpt", "vnpt"))
#: Parts of a supplier's name or of a link.
NAME_RULES = (("easyinvoice", "easyinvoice"), ("meinvoice", "meinvoice"), ("pvoil", "pvoil"), ("smartsign", "smartsign"), ("fast", "fast"), ("ehoadon", "ehoadon"), ("bkav", "ehoadon"), ("vnpt", "vnpt"))


def invoice_link(links, key) -> Column:
    """The invoice's link by the rule of the supplier's key; null for a supplier without one."""
    out = F.lit(None).cast("string")
    for name, rule in LINK_RULES.items():
        out = F.when(key == name, rule(links)).otherwise(out)
    return out


def key_of(name, url) -> Column:
    return supplier_key(F.lower(F.concat_ws(" ", name, url)), list(NAME_RULES))


def _query_value(url, *names: str) -> Column:
    """The first filled query parameter of these names, decoded."""
    return F.coalesce(*[F.nullif(F.trim(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(n)))), F.lit("")) for n in names])


def _quoted(c) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def clicked_url(url) -> Column:
    """Where a click on a smartsign link leads: the code's own page; the link itself if it has no code."""
    code = _query_value(url, "code")
    return F.coalesce(F.concat(F.lit("https://tracuuhdc.smartsign.com.vn/hddt/?code="), _quoted(code), F.lit("&xdb=1")), url)


def xml_plan(key, url, links) -> Column:
    """``array<struct<way, url>>``: how to get a message's XML, by ``get`` or by opening a ``page``; empty if there is no way."""
    u = F.coalesce(url, F.lit(""))
    code = _query_value(u, "sc", "code", "Code")
    site = F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(u, F.lit("AUTHORITY")))
    view = F.regexp_replace(u, "(?i)/Invoice/(DownloadInvPdf|getinvoice)", "/Invoice/ViewFromEmail")
    last = F.nullif(F.element_at(F.split(F.regexp_replace(u, "/+$", ""), "/"), -1), F.lit(""))
    ways = {
        "vnpt": ("get", _first(links, lambda a: _holds(a["href"], "getinvoice") | _holds(a["text"], "xml"))),
        "fast": ("get", _first(links, lambda a: _holds(a["href"], "type=2") | F.contains(F.right(F.lower(a["before"]), F.lit(60)), F.lit("xml")))),
        "meinvoice": ("page", F.concat(site, F.lit("/tra-cuu/?sc="), _quoted(code))),
        "easyinvoice": ("page", F.coalesce(_first(links, lambda a: _holds(a["href"], "viewfromemail")), F.when(view != u, view))),
        "ehoadon": ("page", F.concat(F.lit("https://tchd.ehoadon.vn/TCHD?MTC="), last)),
    }
    ways["pvoil"] = ways["easyinvoice"]
    out = F.lit(None).cast("struct<way:string,url:string>")
    for name, (way, target) in ways.items():
        out = F.when((key == name) & target.isNotNull(), F.struct(F.lit(way).alias("way"), target.alias("url"))).otherwise(out)
    return F.array_compact(F.array(out))


def supplier_key(domain, rules: list[tuple[str, str]]) -> Column:
    """Ordered substring rules (part, key); the first wins."""
    out = F.lit(None).cast("string")
    for part, key in reversed(rules):
        out = F.when(F.contains(domain, F.lit(part)), key).otherwise(out)
    return out
