"""Fields of an invoice page's text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_PLATE, REVIEW, blank_value, nz
from . import money
from . import patterns as P, rules
from . import text as T


def _found(c, pattern: str, group: int = 1, flags: str = "(?i)") -> Column:
    """What the pattern's group matches first; null for nothing."""
    # bound: Spark would look twice for what is found
    return T.bind(F.regexp_extract(c, flags + pattern, group), lambda m: F.when(m != "", m))


def _all(c, pattern: str, flags: str = "(?i)") -> Column:
    return F.regexp_extract_all(c, F.lit(flags + pattern), F.lit(1))


def _repaired(c, repairs) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), repairs, c)


def lines(c, most: int | None = None) -> Column:
    """The text's lines, white space as single spaces, without empty ones; of the first ``most`` only."""
    every = F.split(c, P.LINE_ENDS)
    every = every if most is None else F.slice(every, 1, most)
    return F.filter(F.transform(every, T.clean), lambda x: x != "")


def unzeroed(c) -> Column:
    """Without leading zeros, unless nothing else is there."""
    return F.regexp_replace(c, "^0+(?=0*[^0])", "")


def _longest(found) -> Column:
    """The longest element, the first of equals; null for none."""
    return F.aggregate(found, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull() | (F.length(x) > F.length(s)), x).otherwise(s))


# ---- series and numbers
def _plain(c, folded: Column | None) -> Column:
    """The text without accents; ``folded``, where the caller has it."""
    return T.fold_accents(c) if folded is None else folded


def _upper_plain(c, folded: Column | None = None) -> Column:
    return F.translate(F.upper(_plain(c, folded)), "£€", "KC")


def series(c, folded: Column | None = None) -> Column:
    """The invoice series that the text states, misreadings repaired; null for none."""
    found = T.bind(_upper_plain(c, folded), lambda t: F.coalesce(*[F.trim(_found(t, p)) for p in P.SERIES]))
    return _repaired(found, P.SERIES_REPAIRS)


def normal_series(c) -> Column:
    """A series that was read by itself, repaired; null unless it has the form of one."""
    v = F.regexp_replace(F.upper(T.fold_accents(F.translate(F.coalesce(c, F.lit("")), "£€", "KC"))), "[^0-9A-Z]", "")
    start = v
    for p, r in reversed(P.SERIES_STARTS):
        start = F.when(v.rlike(p), F.regexp_replace(v, p, r)).otherwise(start)
    v = _repaired(start, P.SERIES_WHOLE)
    return F.when(v.rlike(P.SERIES_VALID), v)


def invoice_number(c, folded: Column | None = None) -> Column:
    """The longest number of 4 to 8 digits that the first lines state; null for none.

    A line with the document's title and a number, a line that is only a label (the number then stands in the line before or
    after), and lines with a label and a number give candidates, in this order. Lines without four digits in a row are not searched for numbers."""
    skip = lambda x: x.rlike("(?i)" + P.NUMBER_SKIP)
    sized = lambda x: F.filter(x, lambda n: n.isNotNull() & F.length(n).between(4, 8))
    digits = lambda x: x.rlike("[0-9]{4}")
    none = F.array().cast("array<string>")

    def beside(x) -> Column:
        return F.when(x.isNotNull() & ~skip(x), unzeroed(F.try_element_at(_all(x, P.NUMBER_ANY), F.lit(-1))))

    def of_line(all_lines):
        def give(x, i):
            title = F.when(digits(x), _found(x, P.NUMBER_EXPLICIT))
            alone = x.rlike("(?i)" + P.NUMBER_LABEL_ALONE) & ~skip(x)
            return F.when(title.isNotNull(), F.array(unzeroed(title))).when(alone, sized(F.array(F.when(i > 0, beside(F.get(all_lines, i - 1))), beside(F.get(all_lines, i + 1))))).otherwise(none)

        return give

    def of(every) -> Column:
        labelled = F.transform(F.slice(every, 1, 30), lambda x: F.when(~digits(x) | skip(x), none).otherwise(sized(F.array(*[unzeroed(_found(x, p)) for p in P.NUMBER_IN_LINE]))))
        return _longest(F.concat(F.flatten(F.transform(every, of_line(every))), F.flatten(labelled)))

    return T.bind(lines(_plain(c, folded), 40), of)


def image_number(c, file_name, folded: Column | None = None) -> Column:
    """As ``invoice_number``; where there is none, from the file's name, else by labels of the unfolded text."""
    by_label = [unzeroed(_found(c, p, flags="(?iu)")) for p in P.NUMBER_IN_IMAGE]
    return F.coalesce(invoice_number(c, folded), unzeroed(_found(F.coalesce(file_name, F.lit("")), P.NUMBER_IN_IMAGE_NAME)), *by_label)


def file_stem(c) -> Column:
    """A file's name without suffix and page number."""
    return F.regexp_replace(T.file_in_name(F.coalesce(c, F.lit(""))), r"(?i)_p\d+$", "")


def page_number(c) -> Column:
    """The page that a row's file name ends in, else 1."""
    return F.coalesce(F.regexp_extract(c, r"_p(\d+)$", 1).try_cast("int"), F.lit(1))


def file_number(file_name, series_) -> Column:
    """The invoice number in a file's name, after its series or after any; null for none."""
    stem = file_stem(file_name)
    key = F.regexp_replace(F.upper(T.fold_accents(series_)), "[^0-9A-Z]", "")
    own = F.concat(F.lit(r"(?i)(?:^|[_\-\s])"), key, F.lit(r"[_\-\s]+0*(\d{4,8})(?=$|[_\-\s])"))
    mine = F.when(key != "", F.nullif(F.call_function("regexp_extract", stem, own, F.lit(1)), F.lit("")))
    return unzeroed(F.coalesce(mine, *[_found(stem, p) for p in P.NUMBER_IN_FILE]))


def official_file(file_name) -> Column:
    return file_stem(file_name).rlike("(?i)" + P.OFFICIAL_FILE)


def number_digits(c) -> Column:
    """Letters that were read for digits as digits; null unless 4 to 8 digits come out."""
    d = F.regexp_replace(F.translate(F.regexp_replace(F.upper(T.fold_accents(c)), "[^0-9A-Z]", ""), *P.NUMBER_LETTERS), "[^0-9]", "")
    return F.when(F.length(d).between(4, 8), unzeroed(d))


def header_identity(c) -> Column:
    """``struct(series, number)`` of a header's text; of several numbers the longest, of equals the largest."""
    t = _upper_plain(c)
    ser = F.coalesce(normal_series(series(c)), normal_series(_found(t, P.SERIES_IN_HEADER)))
    own = F.filter(F.split(t, P.LINE_ENDS), lambda x: ~x.rlike("(?i)" + P.HEADER_SKIP) & x.rlike("(?i)" + P.HEADER_LABEL))
    nums = F.filter(F.flatten(F.transform(own, lambda x: F.transform(_all(x, P.HEADER_NUMBER), number_digits))), lambda n: n.isNotNull())
    best = F.array_max(F.transform(nums, lambda n: F.struct(F.length(n).alias("n"), n.alias("v"))))["v"]
    return F.struct(ser.alias("series"), F.coalesce(best, number_digits(_found(t, P.HEADER_ZEROS))).alias("number"))


# ---- date, plate
def date(c, folded: Column | None = None) -> Column:
    """``dd/mm/yyyy`` of the first numeric date with slashes, else of one in words; null for none. It need not be a real day.

    The text is folded once, each pattern is looked for once, and its parts are read from what it found."""
    letters = lambda x: F.translate(x, *P.DATE_LETTERS)

    def parts(m, p) -> Column:
        day, month = letters(_found(m, p, 1)), letters(_found(m, p, 2))
        return F.when(day.rlike("^[0-9]+$") & month.rlike("^[0-9]+$"), F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), _found(m, p, 3)))

    form = lambda t, p: T.bind(_found(t, p, 0), lambda m: F.when(m.isNotNull(), parts(m, p)))
    words = lambda t: F.when(t.rlike(P.DATE_WORDS_HINT), F.coalesce(*[form(t, p) for p in P.DATE_WORDS]))
    return T.bind(F.regexp_replace(_plain(c, folded), r"(?i)\bn[i1]m\b", "nam"), lambda t: F.coalesce(form(t, P.DATE_NUMERIC), words(t)))


def _plate_text(c, folded: Column | None = None) -> Column:
    return F.regexp_replace(F.upper(_plain(c, folded)), P.DASHES, "-")


def _plate_form(t, pattern: str) -> Column:
    def parts(m) -> Column:
        part = lambda i: F.regexp_extract(m, pattern, i)
        return F.when(m != "", F.concat(part(1), F.lit("-"), part(2), F.lit("."), part(3)))

    return T.bind(F.regexp_extract(t, pattern, 0), parts)


def plate_in(c) -> Column:
    """The first plate of a short value; null for none."""
    return _plate_form(_plate_text(c), P.PLATE_PARTS + r"(?!\d)")


def plate(c, folded: Column | None = None) -> Column:
    """The plate of a line that names the buyer or the vehicle, else the first of the page; null for none."""
    p = P.PLATE_PARTS + r"\b"
    own = lambda t: F.get(F.filter(F.split(t, P.LINE_ENDS), lambda x: x.rlike(P.PLATE_LINE) & x.rlike(p)), F.lit(0))
    return T.bind(_plate_text(c, folded), lambda t: F.when(t.rlike(p), _plate_form(F.coalesce(own(t), t), p)))


def clean_plate(c) -> Column:
    """A value that is a plate, in its form, or the sentinel."""
    raw = F.regexp_replace(F.regexp_replace(_plate_text(c), P.PLATE_LABEL, ""), "[^0-9A-Z]", "")
    return F.coalesce(_plate_form(raw, r"^(\d{2}[A-Z]{1,2})(\d{3})(\d{2,3})$"), F.lit(NO_PLATE))


def is_plate(c) -> Column:
    return F.coalesce(F.trim(c).rlike("(?i)" + P.PLATE_WHOLE), F.lit(False))


def name_plate(c) -> Column:
    """The plate in a folder's or file's name; null for none."""
    return _plate_form(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)_p\d+$", "")), P.PLATE_IN_NAME)


def plate_with_alias(current, alias) -> Column:
    """The alias's plate where none was read, or where only the letters before the dash differ."""
    cur, other = clean_plate(current), name_plate(alias)
    tail = lambda x: F.substring_index(x, "-", -1)
    return F.when(other.isNotNull() & ((cur == NO_PLATE) | (tail(cur) == tail(other))), other).otherwise(current)


def plates_differ_ef(current, other) -> Column:
    """Two plates of which one has an E where the other has an F."""
    a, b = clean_plate(current), clean_plate(other)
    off = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y)), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    return (a != NO_PLATE) & (b != NO_PLATE) & (F.length(a) == F.length(b)) & (F.size(off) == 1) & F.coalesce(F.get(off, F.lit(0)).isin("EF", "FE"), F.lit(False))


# ---- buyer
def cut_at_tax_id(c) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, f"(?is){P.TAX_LABEL_AFTER}.*$", "")), r"[:,;\s]+$", "")


def strip_label(c) -> Column:
    return F.trim(F.regexp_replace(c, "(?iu)" + P.BUYER_PREFIX, ""))


def buyer_value(c) -> Column:
    """A buyer's name without what follows it on the line; null if it is too short, a plate or another label."""
    v = strip_label(cut_at_tax_id(T.clean(c)))
    v = F.regexp_replace(v, f"(?isu){P.FIELD_AFTER}.*$", "")
    v = F.regexp_replace(F.regexp_replace(v, r"\s+[g=_'\"|]{1,2}$", ""), r"^[\s:\-–—]+|[\s:\-–—]+$", "")
    return F.when((F.length(v) > 5) & ~is_plate(v) & ~T.fold_accents(v).rlike("(?i)" + P.BUYER_IS_LABEL), v)


def buyer_name(c, folded: Column | None = None) -> Column:
    """The buyer by label, of the text as it is, else without accents; null for none."""
    own = lambda t, p: F.get(F.filter(F.transform(_all(t, p, "(?iu)"), buyer_value), lambda v: v.isNotNull()), F.lit(0))
    plain = _plain(c, folded)
    return F.coalesce(*[own(c, p) for p in P.BUYER_LABELS], *[own(plain, p) for p in P.BUYER_LABELS_PLAIN])


def image_buyer(c) -> Column:
    """The buyer in a text that was read from an image: behind a label or on the next line, else a known beginning."""
    letters = lambda v: F.when((F.length(v) > 5) & v.rlike("[A-Za-zÀ-ỹ]") & ~is_plate(v), v)
    found = []
    for p in P.BUYER_LABELS_IMAGE:
        rest = F.regexp_replace(_found(c, rf"{p}([\s\S]+)", flags="(?iu)"), r"^[ :\t]+", "")
        first = F.when(F.contains(rest, F.lit("\n")), F.substring_index(rest, "\n", 1)).otherwise(F.substring(rest, 1, 120))
        later = F.substring_index(F.regexp_extract(rest, r"^[^\n]*\n[\n :\t]*([\s\S]*)", 1), "\n", 1)
        found += [letters(strip_label(cut_at_tax_id(F.trim(x)))) for x in (first, later)]
    return F.coalesce(*found, *[F.nullif(cut_at_tax_id(T.clean(_found(c, p))), F.lit("")) for p in P.BUYER_PHRASES])


def buyer_tax_id(c, folded: Column | None = None) -> Column:
    """The labelled tax id behind the first buyer label, or of the whole text if there is none; behind a label without one, the
    ten digits nearest to the word for tax."""

    own = lambda z: F.regexp_replace(_found(z, P.TAX_ID), r"\s", "")

    def of(t) -> Column:
        behind = F.regexp_extract(t, rf"(?i)(?:{P.BUYER_ZONE})([\s\S]*)", 1)
        # nothing behind: no label, or one that ends the text
        return T.bind(behind, lambda z: F.when(z != "", F.coalesce(own(z), money.nearest_tax(z))).when(~t.rlike("(?i)" + P.BUYER_ZONE), own(t)))

    return T.bind(_plain(c, folded), of)


# ---- goods
def valid_goods(c) -> Column:
    """4 to 80 characters with a letter, no number, and no word that names something else."""
    bad = F.exists(F.array(*map(F.lit, P.NO_GOODS)), lambda b: F.contains(F.upper(c), b))
    return F.coalesce(F.length(c).between(4, 80) & c.rlike("[A-Za-zÀ-ỹ]") & ~c.rlike(r"^[\d.,\s]+$") & ~bad, F.lit(False))


def goods_name(c, folded: Column | None = None) -> Column:
    """The goods that a text speaks of: fuel classes by how they are misread, else the phrase of a line; null for none."""
    t = _plain(c, folded)
    every = F.split(t, P.LINE_ENDS)
    phrase = lambda x, p: F.nullif(T.clean(_found(F.regexp_replace(x, P.GOODS_LINE_START, ""), p)), F.lit(""))
    first = lambda xs, p: F.get(F.filter(F.transform(xs, lambda x: phrase(x, p)), lambda x: x.isNotNull()), F.lit(0))
    head = F.transform(every, lambda x: x.rlike("(?i)" + P.GOODS_HEADER))
    below = F.when(F.array_contains(head, True), F.slice(every, F.array_position(head, True).cast("int") + 1, F.size(every)))
    below = F.filter(below, lambda x: ~x.rlike("(?i)" + P.GOODS_HEADER) & x.rlike("(?i)" + P.GOODS_LATER_LINE))
    fuel = lambda x, p: x.rlike("(?i)" + p)
    by_line = (
        F.when(fuel(t, P.GOODS_PETROL), "Xang").when(fuel(t, P.GOODS_DIESEL), "Dau")
        .otherwise(F.coalesce(first(F.filter(every, lambda x: fuel(x, P.GOODS_LINE)), P.GOODS_PHRASE), first(below, P.GOODS_LATER_PHRASE)))
    )
    of = lambda compact: F.when(fuel(compact, P.GOODS_PETROL_COMPACT), "Xang").when(fuel(compact, P.GOODS_DIESEL_COMPACT), "Dau")
    return F.coalesce(T.bind(F.regexp_replace(F.upper(t), "[^A-Z0-9]", ""), of), by_line)


def table_goods(rows) -> Column:
    """``array<array<string>>``, a table's rows of cells → the first goods name below a header of that column; null for none."""
    cells = lambda r: F.filter(F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    skip = lambda x: F.lower(T.clean(x)).isin(*P.TABLE_SKIP)

    def step(s, r):
        own = cells(r)
        header = F.exists(F.array(*map(F.lit, P.TABLE_HEADERS)), lambda h: F.contains(F.lower(F.array_join(own, " ")), h))
        numbers = F.array_join(own, "").rlike(r"^[\d\s()=xX×.,]+$")
        plain = F.forall(own, skip) | F.forall(own, lambda x: x.rlike(r"^[ABC\d\s=xX×.,/()+]+$"))
        good = F.get(F.filter(F.transform(own, T.clean), lambda x: ~F.lower(x).isin(*P.TABLE_SKIP) & valid_goods(x)), F.lit(0))
        idle = s["found"].isNotNull() | (F.size(own) == 0)
        return (
            F.when(idle, s).when(header, F.struct(F.lit(True).alias("below"), s["found"].alias("found"))).when(~s["below"] | numbers | plain, s)
            .otherwise(F.struct(F.lit(False).alias("below"), good.alias("found")))
        )

    start = F.struct(F.lit(False).alias("below"), F.lit(None).cast("string").alias("found"))
    return F.aggregate(rows, start, step)["found"]


# ---- whole pages
def issuer(c) -> Column:
    out = F.lit(P.OTHER_ISSUER)
    for name, p in reversed(P.ISSUERS):
        out = F.when(c.rlike("(?i)" + p), name).otherwise(out)
    return out


def heading(c) -> Column:
    return F.substring(c, 1, P.HEADER_CHARS).rlike("(?iu)" + P.HEADING)


def pump_log(c) -> Column:
    """Pages of a pump's log that are no part of an invoice."""
    t = F.upper(T.fold_accents(c))
    return F.ltrim(t).startswith(P.PUMP_LOG_START) | (t.rlike(P.PUMP_LOG) & ~F.substring(t, 1, 500).rlike(P.INVOICE_SIGN))


def invoice_pages(pages: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Pages without pump logs; of a file that has nothing else, all."""
    keep = ~F.coalesce(pump_log(F.col(text)), F.lit(False))
    return pages.withColumn("_keep", keep).withColumn("_any", F.max("_keep").over(Window.partitionBy(file))).where("_keep or not _any").drop("_keep", "_any")


def extract_rows(pages: DataFrame) -> DataFrame:
    """``pages(file, page_no, text, doc_kind, tables)`` → invoice rows; ``doc_kind`` is text or image, ``tables`` may be left out.

    Text pages take goods from tables first; images take buyers and numbers by the rules for misread text. A number in the file's name
    wins where the text's looks wrong, or where the name has the official form."""
    if "tables" not in pages.columns:
        pages = pages.withColumn("tables", F.lit(None).cast("array<array<string>>"))
    t, is_text = F.coalesce("text", F.lit("")), F.col("doc_kind") == "text"
    # nearly every field is looked for in the text without accents: it is made once, as a column
    p, f = pages.withColumn("_plain", T.fold_accents(t)), F.col("_plain")
    p = p.withColumns({"series": series(t, f), "_no": F.when(is_text, invoice_number(t, f)).otherwise(image_number(t, F.col("file"), f))})
    by_name = file_number(F.col("file"), F.col("series"))
    number = F.when(by_name.isNotNull() & (rules.suspicious_number(F.col("_no")) | official_file(F.col("file"))), by_name).otherwise(F.col("_no"))
    goods = F.coalesce(F.when(is_text, table_goods(F.col("tables"))), goods_name(t, f))
    amount = money.pre_tax_amount(t, f)
    return p.select(
        "file", "page_no", issuer(t).alias("issuer"), "doc_kind", F.when(is_text, buyer_name(t, f)).otherwise(image_buyer(t)).alias("buyer_name"), buyer_tax_id(t, f).alias("buyer_tax_id"), "series", number.alias("invoice_no"),
        date(t, f).alias("invoice_date"), amount.alias("pre_tax_amount"), F.coalesce(plate(t, f), F.lit(NO_PLATE)).alias("plate"), rules.goods_class(goods).alias("goods"), F.col("doc_kind").alias("provenance"),
    )


FIELDS = ("buyer_name", "buyer_tax_id", "series", "invoice_no", "invoice_date", "pre_tax_amount", "plate", "goods")


def merge_reading(rows: DataFrame, second: DataFrame, keys: tuple[str, ...], year: int, source: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows whose fields give way to a second reading's where that has a value and the field needs a better one; where one did, the
    provenance says so. Rows without a second reading stay."""
    s = second.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    j = rows.join(s, list(keys), "left")
    better = {f: ~blank_value(F.col(f"_{f}").cast("string")) & rules.needs_better(f, F.col(f), year) for f in fields}
    any_better = reduce(lambda a, b: a | b, better.values())
    seen = F.when(nz("provenance").isNull(), F.lit(source)).otherwise(F.concat(F.col("provenance"), F.lit("+" + source)))
    new = {f: F.when(better[f], F.col(f"_{f}")).otherwise(F.col(f)) for f in fields} | {"provenance": F.when(any_better, seen).otherwise(F.col("provenance"))}
    return j.withColumns(new).select(*rows.columns)


def apply_overrides(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules in order: ``{target, value, when: {column: value or prefix ending in *}}``; conditions look at the row as the rules before left it."""
    for r in rules:
        ok = F.lit(True)
        for column, want in r["when"].items():
            c = F.coalesce(F.col(column).cast("string"), F.lit(""))
            ok = ok & (c.startswith(want[:-1]) if str(want).endswith("*") else c.isin(*want) if isinstance(want, (list, tuple)) else c == want)
        kind = rows.schema[r["target"]].dataType
        rows = rows.withColumn(r["target"], F.when(ok, F.lit(r["value"]).cast(kind)).otherwise(F.col(r["target"])))
    return rows


def result_order(file: str = "file", alias: str | None = None) -> list[Column]:
    """Sort keys: the name before its page number, the page, the file."""
    name = F.coalesce(nz(alias), F.trim(file)) if alias else F.trim(file)
    return [F.regexp_replace(name, r"_p\d+[\s\S]*$", ""), F.coalesce(F.regexp_extract(name, r"_p(\d+)", 1).try_cast("int"), F.lit(0)), F.trim(file)]


def lookup_fields(c) -> Column:
    """``struct(number, code)`` of a message's visible text; codes end in one star."""
    trimmed = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"^[\s:*#\-]+", ""), r"[\s:#\-]+$", ""), r"\s+|\*+$", "")
    first = lambda ps: F.coalesce(*[_found(c, p, flags="(?iu)") for p in ps])
    number, code = trimmed(first(P.LOOKUP_NUMBER)), F.nullif(trimmed(first(P.LOOKUP_CODE)), F.lit(""))
    return F.struct(F.nullif(number, F.lit("")).alias("number"), F.concat(code, F.lit("*")).alias("code"))


def quick_info(c) -> Column:
    """``struct(series, number, tax_id)`` as a download's page states them."""
    return F.struct(_found(c, P.QUICK_SERIES, flags="(?iu)").alias("series"), _found(c, P.QUICK_NUMBER, flags="(?iu)").alias("number"), _found(c, P.QUICK_TAX_ID).alias("tax_id"))


def download_name(info, suggested, supplier) -> Column:
    """``taxid_series_number.pdf`` where series and number are known, else the suggested name, else one by supplier."""
    known = F.concat(F.coalesce(info["tax_id"], F.lit("0000000000")), F.lit("_"), info["series"], F.lit("_"), info["number"], F.lit(".pdf"))
    return F.coalesce(known, nz(suggested), F.concat(supplier, F.lit("_invoice.pdf")))


def xml_name(content, fallback) -> Column:
    """``series_number.xml`` of an invoice XML's beginning."""
    head = F.substring(content, 1, 20_000)
    tag = lambda t, v: F.nullif(F.regexp_extract(head, rf"<{t}>\s*({v})\s*</{t}>", 1), F.lit(""))
    return F.coalesce(F.concat(tag("KHHDon", r"[^<\s]+"), F.lit("_"), tag("SHDon", r"\d+"), F.lit(".xml")), fallback)


def needs_review(c) -> Column:
    return c == REVIEW
