"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of a text, as words joined by single spaces with A-Z lower-cased; equal ones are one. Their
5-word shingles give ROWS * BANDS minimum hashes; a pair at the similarity shares a band with probability
1 - (1 - 0.8**2)**6 = 0.998. Colliding paragraphs are verified by the exact Jaccard similarity of their shingles;
components keep the paragraph that comes first by document and place.

Passages that two longer lines share are found too: lines of PASSAGE words or more are also cut by content into pieces (at pairs
of words whose hash is the least within REACH words, so that a passage is cut alike wherever it stands). Equal pieces are
one class, which keeps its first; a line with PASSAGE words or more in shared pieces holds a shared passage.

Cases: null and empty texts have no paragraphs; paragraphs of fewer than SHINGLE words have no shingle and stay; rows
that repeat an id and its text are one document and get equal rows; ties are broken by place; texts of any length are
taken whole; an empty table gives no rows; extra columns are not read; a null id is smaller than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

SHINGLE, SIMILARITY, ROWS, BANDS, SEED = 5, 0.8, 2, 6, 8
#: Of passages inside lines: words to either side that a cut looks at, and words from which a passage counts.
REACH, PASSAGE = 4, 16
CHUNK_BYTES = 4 << 20


def paragraphs(text: bytes | None) -> list[tuple[int, bytes]]:
    """(line number, normal form) of the lines with a word."""
    lines = ((i, b" ".join(x.split())) for i, x in enumerate((text or b"").lower().split(b"\n")))
    return [(i, x) for i, x in lines if x]


def _chunks(texts: list) -> Iterator[list[int]]:
    held, total = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        total += len(t or b"")
        if total >= CHUNK_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def _unit_rows(batches: Iterator[pd.DataFrame], rows: int, bands: int, size: int, least: int, passage: int) -> Iterator[pd.DataFrame]:
    """A row a paragraph, with ``bands``, and with ``passage`` a row a piece, without."""
    rng = np.random.default_rng(SEED)
    mul = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in batches:
        texts = list(b["text"])
        for part in _chunks(texts):
            found = [(k, i, x) for k in part for i, x in paragraphs(texts[k]) if x.count(b" ") >= least - 1]
            if not found:
                continue
            owner, at = np.array([k for k, _, _ in found]), np.array([i for _, i, _ in found], np.int32)
            words, first = hashing.word_hashes([x for _, _, x in found], SEED)
            h, bounds = hashing.shingles_of(words, first, size)
            h ^= h >> np.uint64(29)
            out = np.empty((len(found), bands), np.uint64)
            for band in range(bands):
                key = np.full(len(found), band, np.uint64)
                for r in range(rows):
                    key = (key ^ np.minimum.reduceat(h * mul[band * rows + r], bounds[:-1])) * mix[r]
                    key ^= key >> np.uint64(32)
                out[:, band] = key
            yield _rows_of(b, owner, at, 0, np.diff(first), [xxhash.xxh3_128_digest(x) for _, _, x in found], list(out.view(np.int64)))
            if passage:
                unit, word, count, ids = hashing.pieces(words, first, REACH, passage)
                raw = ids.tobytes()
                yield _rows_of(b, owner[unit], at[unit], word, count, [raw[i : i + 16] for i in range(0, len(raw), 16)], None)


def _rows_of(b: pd.DataFrame, owner: np.ndarray, at: np.ndarray, word, words, ids: list, bands) -> pd.DataFrame:
    own = b.iloc[owner]
    return pd.DataFrame({
        "key": own["key"].to_numpy(), "doc_id": own["doc_id"].array, "at": at, "word": np.zeros(len(at), np.int32) + np.asarray(word, np.int32), "words": np.asarray(words, np.int32), "id": ids, "bands": bands,
    })


def paragraph_units(docs: DataFrame, size: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, least: int | None = None, passage: int = 0) -> DataFrame:
    """``docs(key, doc_id, text binary)`` → ``(key, doc_id, at, word, words, id, bands)``: the paragraphs of ``least`` words (``size`` where not
    given), and pieces (``bands`` null) of those of ``passage`` words or more."""
    kinds = {x.name: x.dataType.simpleString() for x in docs.schema}
    schema = f"key {kinds['key']}, doc_id {kinds['doc_id']}, at int, word int, words int, id binary, bands array<long>"
    return docs.select("key", "doc_id", "text").mapInPandas(lambda it: _unit_rows(it, rows, bands, size, least or size, passage), schema)


def similar_paragraphs(docs: DataFrame, found: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, close: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``found`` as of ``paragraph_units`` → distinct paragraphs ``(nid, id, lo, hi)``, ``lo`` and ``hi`` being the least and greatest
    ``(doc_id, key, at)``, and ``(id, component)`` of linked ``nid``s. ``close(id, bucket)`` are buckets beside those of the bands."""
    where = F.struct("doc_id", "key", "at")
    first = found.groupBy("id").agg(F.min(where).alias("lo"), F.max(where).alias("hi"), F.first("bands").alias("bands"))
    first = common.materialize(first.withColumn("nid", F.monotonically_increasing_id()), "distinct")
    members = first.select(F.col("nid").alias("id"), F.posexplode("bands").alias("band", "v")).select(F.xxhash64("band", "v").alias("bucket"), "id")
    if close is not None:
        members = members.union(first.select("nid", "id").join(close.hint("merge"), "id").select("bucket", F.col("nid").alias("id")))
    sets: DataFrame | None = None

    def prepare(live: DataFrame):
        nonlocal sets

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts, wanted = list(b["text"]), [{x["at"]: x["nid"] for x in xs} for xs in b["need"]]
                for part in _chunks(texts):
                    own = [(wanted[k][i], x) for k in part for i, x in paragraphs(texts[k]) if i in wanted[k]]
                    words, starts = hashing.word_hashes([x for _, x in own], SEED)
                    h, bounds = hashing.shingles_of(words, starts, size)
                    h = h.view(np.int64)
                    yield pd.DataFrame({"id": [n for n, _ in own], "set": [np.unique(h[s:e]) for s, e in zip(bounds, bounds[1:], strict=False)]})

        ids = live.select(F.col("id").alias("nid")).distinct()
        need = first.join(ids, "nid", "left_semi").select("lo.key", F.struct("lo.at", "nid").alias("x")).groupBy("key").agg(F.collect_list("x").alias("need"))
        sets = common.materialize(docs.join(need, "key").select("text", "need").mapInPandas(cut, "id long, set array<long>").dropDuplicates(["id"]), "shingles")

        return sets, common.jaccard_verifier(sets, similarity)

    comps = common.materialize(common.link_buckets(members, prepare, similarity=similarity), "components")
    common.discard(sets)
    return first.drop("bands"), comps


def shared_passages(found: DataFrame, passage: int) -> DataFrame:
    """``paragraph_units`` → ``(key, passages)``: by line, the pieces shared with another place, where they make up ``passage`` words."""
    pieces = found.where("bands is null")
    often = pieces.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    shared = common.materialize(pieces.join(often, "id").select("key", "doc_id", "at", "word", "words", "id"), "passages")
    where = F.struct("doc_id", "key", "at", "word")
    heads = shared.groupBy("id").agg(F.min(where).alias("head"), F.max(where).alias("tail")).where(~F.col("head").eqNullSafe(F.col("tail")))
    gone = (F.col("key") != F.col("head.key")) | (F.col("at") != F.col("head.at")) | (F.col("word") != F.col("head.word"))
    own = shared.join(heads, "id").select("key", "at", "word", "words", gone.alias("gone"))
    lines = own.groupBy("key", "at").agg(F.collect_set(F.struct("word", "words", "gone")).alias("x"))
    lines = lines.where(F.aggregate("x", F.lit(0), lambda n, p: n + p["words"]) >= passage)
    spans = F.transform(F.sort_array("x"), lambda p: F.struct(F.col("at").alias("at"), p["word"].alias("word"), p["words"].alias("words"), p["gone"].alias("gone")))
    return lines.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("passages"), F.count("*").alias("n_passages"))


def dedup_paragraphs(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, n_paragraphs, removed, n_classes, class_doc_ids, n_passages, passages``: the line numbers to remove; the documents that keep
    a paragraph of the classes (of two occurrences or more) that the document has a part in, itself included; the lines that hold a passage
    shared with another place, and its pieces (line, first word, words, and whether it goes as it stands elsewhere before)."""
    d = docs.select("doc_id", common.text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    units = common.materialize(paragraph_units(d, size, passage=passage), "paragraphs")
    found = units.where("bands is not null")
    first, comps = similar_paragraphs(d, found, size, similarity)
    own = common.materialize(common.unit_report(common.shared_units(found, first, comps)), "removed")
    passages = common.materialize(shared_passages(units, passage), "spans")
    common.discard(units, first, comps)
    ids = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", common.text_key().alias("key"), common.n_lines().alias("n_paragraphs")).join(own, "key", "left").join(passages, "key", "left")
    return out.select(
        "doc_id", "n_paragraphs", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_classes"),
        F.coalesce("class_doc_ids", F.array().cast(f"array<{ids}>")).alias("class_doc_ids"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("passages", F.array().cast(passages.schema["passages"].dataType)).alias("passages"),
    )


def kept_text(text, removed) -> F.Column:
    """The text without the removed lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i)), "\n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_paragraphs(common.read_table(spark, sf_dir, "documents"))
    return out.withColumn("n_removed", F.size("removed").cast("long"))
