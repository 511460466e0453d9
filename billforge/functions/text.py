"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .patterns import NAME_LABELS


def _latin() -> dict[str, str]:
    """Latin letters with marks and the plain letters they are made from, by their canonical decomposition; đ has none."""
    out = {"đ": "d", "Đ": "D"}
    for c in map(chr, range(0xC0, 0x1F00)):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            out[c] = base[0]
    return out


_LATIN = _latin()
_FROM, _TO = "".join(_LATIN), "".join(_LATIN.values())
_MARKS = "[\\u0300-\\u036f\\u1dc0-\\u1dff\\u20d0-\\u20ff]"


def bind(value, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(c) -> Column:
    """White space to single spaces, no double quotes."""
    return F.trim(F.replace(F.regexp_replace(c, r"\s+", " "), F.lit('"'), F.lit("")))


def fold_accents(c) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _FROM, _TO), _MARKS, "")


#: ``fold_accents`` as SQL over ``x``.
FOLD_SQL = f"regexp_replace(translate(coalesce(x, ''), '{_FROM}', '{_TO}'), r'{_MARKS}', '')"


def norm_code(c) -> Column:
    """Lookup codes: trimmed, no trailing stars, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\*+$", "")))


def norm_number(c) -> Column:
    """Invoice numbers: no leading zeros, no integral fraction, upper case; all zeros become blank, which matches any."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\.0+$", ""), "^0+", ""))


def same_number(a, b) -> Column:
    return (a == "") | (b == "") | (a == b)


def digits_key(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), "^0+", "")


def root_domain(c) -> Column:
    """The last three labels of a host name."""
    parts = F.split(F.lower(c), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".")


def supplier_domain(text, supported: list[str], suffix: str = "vn") -> Column:
    """The first supported domain of the text, else the first one."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([a-z0-9][a-z0-9.-]*\.{suffix})"), F.lit(1))
    known = F.filter(found, lambda d: F.exists(F.array(*map(F.lit, supported)), lambda s: F.contains(d, s)))
    return root_domain(F.coalesce(F.get(known, 0), F.get(found, 0)))


def keyword_hit(keywords: list[str], *fields) -> Column:
    hay = F.lower(F.concat_ws("\n", *fields))
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(hay, k))


def base64url(c) -> Column:
    return F.unbase64(F.translate(c, "-_", "+/"))


def safe_name(c) -> Column:
    return F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")


def plain(c: str | None) -> str:
    """``fold_accents`` of one value."""
    return "".join(_LATIN.get(x, "" if unicodedata.combining(x) else x) for x in c) if isinstance(c, str) else ""


def ascii_key(c) -> Column:
    """Without accents, lower case, trimmed: for comparing headers and names."""
    return F.trim(F.lower(fold_accents(c.cast("string"))))


def name_key(c, labels: tuple[str, ...] = NAME_LABELS) -> Column:
    """Upper case without accents, all but letters and digits as single spaces, a label at the beginning left out."""
    key = F.trim(F.regexp_replace(F.upper(fold_accents(c.cast("string"))), "[^A-Z0-9]+", " "))
    return F.regexp_replace(key, "^(?:" + "|".join(labels) + r")\s*", "") if labels else key


def message_link(c, form: str = "https://mail.google.com/mail/u/0/#all/%s") -> Column:
    return F.format_string(form, c)


def reply_class(c) -> Column:
    """What a lookup page answers: bad_captcha, not_found, message; null for no answer."""
    t = ascii_key(c)
    wrong = F.contains(t, F.lit("ma xac nhan")) & (F.contains(t, F.lit("khong")) | F.contains(t, F.lit("sai")))
    none = F.contains(t, F.lit("khong ton tai")) | F.contains(t, F.lit("khong tim thay"))
    return F.when(t == "", None).when(wrong, "bad_captcha").when(none, "not_found").otherwise("message")


def clamp(c, low: int, high: int, default: int | None = None) -> Column:
    """A whole number within bounds; the default for what is no whole number."""
    n = F.trim(c.cast("string")).try_cast("int")
    return F.when(n.isNull(), F.lit(default).cast("int")).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n)))


def quoted(c) -> Column:
    """An argument of a command line, in double quotes where it needs them."""
    return F.when((c == "") | c.rlike(r'[\s"&|<>^()]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def _decode_header(v: str | None) -> str | None:
    from email.header import decode_header

    try:
        return "".join(x.decode(enc or "utf-8", "ignore") if isinstance(x, bytes) else x for x, enc in decode_header(v)).strip() if v else ""
    except (ValueError, LookupError):
        return v.strip()


@F.pandas_udf(StringType())
def mime_header(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Header values with encoded words (RFC 2047), decoded; a value that can't be decoded stays."""
    for s in it:
        yield s.map(_decode_header, na_action=None)


def file_in_name(c) -> Column:
    """A path's name without folders and suffix."""
    return F.regexp_extract(c, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def drop_marker_urls(c, marker: str) -> Column:
    return F.regexp_replace(c, rf"https?://\S*{marker}\S*", "")
