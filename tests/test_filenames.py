"""File matching against all pairs, and numbers that very many files and invoices share."""

import json
import random
import re

from pyspark.sql import functions as F

from billforge.operators import filenames
from billforge.sources import messages

WORDS = ["HD", "hoadon", "C26TAA", "1C26TAA", "K26TXN", "file", "AB12CD34EF", "ZX98YU76", "p2", "p2_1"]


def code(series):
    s = (series or "").strip().upper()
    return s[1:] if re.match(r"^\d.{6}$", s) else s


def numbers(stem):
    return {n.lstrip("0") for n in re.findall(r"\d+", stem)}


def match(row, stems):
    xml, series, number = row
    n, c = re.sub(r"\D", "", number or "").lstrip("0"), code(series)
    best = []
    for stem, o in stems:
        up = stem.upper()
        tokens = [t for t in re.split(r"[_\-\s]+", xml.upper()) if len(t) >= 8 and re.search("[A-Z]", t) and re.search("[0-9]", t)]
        tier = 0 if stem == xml else 1 if n and n in numbers(stem) and c and c in up else 2 if n and n in numbers(stem) else 3 if any(t in up.split("_")[1:] or up.endswith(t) for t in tokens) else None
        if tier is not None:
            best.append((tier, len(stem), o, stem))
    return min(best)[3] if best else xml


def tables(seed):
    rng = random.Random(seed)
    name = lambda: rng.choice("_- ").join(rng.choice([*WORDS, str(rng.randint(0, 30)), f"00{rng.randint(1, 9)}", str(rng.randint(100, 120))]) for _ in range(rng.randint(1, 4)))
    stems = [(s, i) for i, s in enumerate(sorted({name() for _ in range(90)}))]
    rows = [(rng.choice([name(), stems[rng.randrange(len(stems))][0]]), rng.choice(["1C26TAA", "C26TAA", "1K26TXN", "", None, " k26txn"]), rng.choice(["7", "007", "No 115", "", None, "103", "12"])) for _ in range(80)]
    return rows, stems


def test_match_against_all_pairs(spark):
    for seed in (1, 2):
        rows, stems = tables(seed)
        d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, xml_stem string, series string, invoice_no string")
        got = {r.i: r.pdf_stem for r in filenames.match_stems(d, spark.createDataFrame(stems, "stem string, ord int")).collect()}
        assert got == {i: match(r, stems) for i, r in enumerate(rows)}


def test_duplicates_against_all_pairs(spark):
    rows, stems = tables(3)
    invoices = [(stems[i % len(stems)][0] if i % 3 else "gone", i, s, n) for i, (_, s, n) in enumerate(rows)]
    want = {}
    for stem, _ in stems:
        hits = []
        for f, o, s, n in invoices:
            n, c = re.sub(r"\D", "", n or "").lstrip("0"), code(s)
            if f != "gone" and f != stem and (re.sub(r"_\d+$", "", stem) == f or len(n) >= 3 and len(c) >= 5 and n in numbers(stem) and c in stem.upper()):
                hits.append((o, f))
        if hits:
            want[stem] = min(hits)[1]
    d = spark.createDataFrame(invoices, "file_stem string, ord int, series string, invoice_no string")
    s = spark.createDataFrame(stems, "stem string, ord int")
    assert {r.stem: r.dup_of for r in filenames.duplicate_files(s.select("stem"), d, s.select("stem")).collect()} == want and want


def test_a_number_of_all_makes_no_square(spark):
    """20,000 names and 20,000 invoices of the same nine numbers: 44 million pairs, if they were made."""
    n = 20_000
    stems = spark.range(n).select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit("y C26TAA "), (F.col("id") % 9 + 1).cast("string")).alias("stem"), F.col("id").alias("ord"))
    rows = spark.range(n).select(F.concat(F.lit("inv"), F.col("id").cast("string"), F.lit("q")).alias("xml_stem"), F.lit("1C26TAA").alias("series"), (F.col("id") % 9 + 1).cast("string").alias("invoice_no"), "id")
    got = filenames.match_stems(rows, stems)
    assert {(r.k, r.s) for r in got.groupBy((F.col("id") % 9).alias("k"), F.col("pdf_stem").alias("s")).count().select("k", "s").collect()} == {(k, f"x{k}y C26TAA {k + 1}") for k in range(9)}


def test_message_trees(spark, tmp_path):
    leaf = lambda mime, data=None, name="", **b: {"mimeType": mime, "filename": name, "body": {"data": data, **b} if data else b}
    deep = leaf("text/html", "aHRtbA==")
    for i in range(12):
        deep = {"mimeType": "multipart/mixed", "parts": [leaf("text/plain", f"{i:02}"), deep]}
    trees = [
        {"id": "a", "internalDate": "0", "labelIds": ["L"], "payload": {"headers": [{"name": "Subject", "value": "=?UTF-8?B?w4E=?="}, {"name": "FROM", "value": "x"}], "parts": [{"mimeType": "multipart/alternative", "body": {"data": "own"}, "parts": [leaf("text/plain", "in1"), leaf("text/html", "in2")]}, leaf("application/pdf", None, "f.pdf", attachmentId="A", size=5)]}},
        {"id": "b", "payload": {"mimeType": "text/plain", "body": {"data": "only"}}}, {"id": "c", "payload": deep}, {"id": "d"}, {"id": "e", "payload": {"parts": []}},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, trees)) + "\n{broken\n\n")
    got = {r.id: r for r in messages.read_trees(spark, str(tmp_path / "m.json")).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"} and (got["a"].subject, got["a"].sender, got["a"].internal_date_ms, got["a"].label_ids) == ("Á", "x", 0, ["L"])
    assert [(p.path, p.data_b64url, p.attachment_id) for p in got["a"].parts] == [("0.0", "in1", None), ("0.1", "in2", None), ("0", "own", None), ("1", None, "A")]
    assert [(p.path, p.data_b64url) for p in got["b"].parts] == [("", "only")] and got["d"].parts == [] and [p.path for p in got["e"].parts] == [""]

    def walk(parts):
        for p in parts:
            yield from walk(p.get("parts", []))
            yield (p.get("body") or {}).get("data")

    assert [p.data_b64url for p in got["c"].parts] == list(walk(deep["parts"]))
