"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at least one bit of some masked-out group,
or are equal; elsewhere they then differ in at most two. So for each of ``groups`` groups every distinct
fingerprint masks the group out and emits all variants of the rest within half of that radius (one bit).
Close fingerprints meet on a common variant; meetings are deduplicated and verified on all 64 bits.
Of two groups, one even holds all but one of the differing bits, and the rest of each fingerprint is a variant of the other's: variants
that are the rest of no fingerprint are left out, so copies meet on a variant for each rest that is there, not on all 33 around it.

Cases: null, empty and blank texts have fingerprint zero and link like others; repeated rows and ties
share a fingerprint, and only distinct fingerprints are compared; an empty table gives no rows; columns
besides ``doc_id`` and ``text`` are not read; a null ``doc_id`` keeps its row and never names a component
unless no other id is there.

The pipeline's stage finds candidates by the same fingerprints and components, and is wider than the query: near copies there are texts
whose sets of five-word shingles have a Jaccard similarity of 0.8, which may lie up to 11 bits apart, too far for balls. So texts also meet
in bands of minimum hashes; a pair at the similarity shares a band with probability 1 - (1 - 0.8**3)**12 = 0.9998. Candidates of
both kinds are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing, op8_paragraphs

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Groups of bits: more distinct fingerprints than this take four, whose 48 bits keep chance meetings rare, fewer take two.
FEW_FINGERPRINTS = 1 << 24
#: Of the stage: words of a shingle, Jaccard similarity, minimum hashes of a band, bands.
STAGE_WORDS, STAGE_SIMILARITY, STAGE_ROWS, STAGE_BANDS = 5, 0.8, 3, 12
#: Shingles hashed at a time; a document is never cut by it, as bit counts of its parts are summed.
CHUNK_BYTES = 4 << 20


def _fingerprints(texts: list[bytes], size: int, seed: int) -> np.ndarray:
    h, bounds = hashing.shingles([b" ".join(t.lower().split()) for t in texts], size, seed)
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    out = np.zeros(len(texts), np.uint64)
    if not len(full):
        return out
    # parts of at most 65535 shingles fit counters of 16 bits, four in a word
    parts = np.repeat(bounds[full], (n[full] + 65534) // 65535)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum((n[full] + 65534) // 65535)])
    parts = parts + 65535 * (np.arange(len(parts)) - np.repeat(first[:-1], np.diff(first)))
    ones = np.zeros((len(full), 64), np.int64)
    for j in range(16):
        lanes = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0001000100010001), parts)
        for k in range(4):
            c = ((lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            ones[:, 16 * k + j] = np.add.reduceat(c, first[:-1])
    bits = ones * 2 > n[full, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp long)`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if t is not None else b"" for t in b["text"]]
            out, i = [], 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j]) <= CHUNK_BYTES):
                    total += len(texts[j])
                    j += 1
                out.append(_fingerprints(texts[i:j], size, seed))
                i = j
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, f"doc_id {ids}, fp long")


def near_components(distinct: DataFrame, radius: int = RADIUS, groups: int = 2) -> DataFrame:
    """``distinct(fp)`` → ``(id, component)`` of the fingerprints that link to another."""
    if radius > 3:
        raise ValueError("balls of one bit meet up to radius 3")
    width = 64 // groups
    variants = []
    for g in range(groups):
        mask = ~(((1 << width) - 1) << (g * width)) & ((1 << 64) - 1)
        flips = [0] + [1 << b for b in range(64) if mask >> b & 1]
        # two groups' variants may fall on one bucket, which costs a pair, not a link
        signed = [x - (1 << 64) if x >> 63 else x for x in [mask, *[f ^ (g * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for f in flips]]]
        rest = F.col("fp").bitwiseAND(F.lit(signed[0]))
        variants += [rest.bitwiseXOR(F.lit(x)) for x in signed[1:]]
    members = distinct.select(F.col("fp").alias("id"), F.explode(F.array(*variants)).alias("bucket"))
    if groups == 2:
        # the first variant of each group is the rest itself
        rests = distinct.select(F.explode(F.array(variants[0], variants[len(variants) // 2])).alias("bucket")).distinct()
        members = common.materialize(members.join(rests.hint("merge"), "bucket", "left_semi").select("bucket", "id"), "members")
    comps = common.link_buckets(members, lambda _: lambda pairs: pairs, near=lambda u, v: F.bit_count(u.bitwiseXOR(v)) <= radius)
    common.discard(members)
    return comps


def simhash_dedup(docs: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS, groups: int | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; the component is the smallest ``doc_id`` reachable.

    Two groups emit 66 variants of 32 free bits a fingerprint, four 196 of 48 bits; both lose no link. n fingerprints meet by chance about
    66 n / 2**33 times each with two groups and 196 n / 2**50 with four."""
    fps = common.materialize(fingerprints(docs, size), "fingerprints")
    least = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = groups or (2 if least.count() <= FEW_FINGERPRINTS else 4)
    comps = common.materialize(near_components(least.select("fp"), radius, groups), "components")
    # all three sides grow with the corpus: none is broadcast
    named = least.join(comps.hint("merge"), F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(roots.hint("merge"), "root").select("fp", "component_id")
    return fps.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(common.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """``docs(_key, text)`` → ``(_key, component)``: texts linked by the stage's similarity; equal words are one text, no words another.

    Texts of one component of ``simhash_dedup`` are a bucket more, beside the bands."""
    flat = docs.select(F.col("_key").alias("key"), F.lit(0).alias("doc_id"), F.translate(F.coalesce("text", F.lit("")), "\n", " ").cast("binary").alias("text"))
    found = common.materialize(op8_paragraphs.paragraph_units(flat, STAGE_WORDS, STAGE_ROWS, STAGE_BANDS, least=1), "texts")
    prints = simhash_dedup(docs.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.xxhash64(F.lit("simhash"), "component_id").alias("bucket"))
    close = common.materialize(found.select("key", "id").join(prints.hint("merge"), "key").select("id", "bucket").distinct(), "close")
    first, comps = op8_paragraphs.similar_paragraphs(flat, found, STAGE_WORDS, STAGE_SIMILARITY, close)
    named = first.join(comps.withColumnRenamed("id", "nid"), "nid", "left").select("id", F.coalesce("component", "nid").alias("component"))
    named = found.select(F.col("key").alias("_key"), "id").distinct().join(named, "id").select("_key", "component")
    return docs.select("_key").distinct().join(named, "_key", "left").select("_key", F.coalesce("component", F.lit(-1)).alias("component"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the first ``doc_id``, null last, and among its texts the one of the smallest hash; columns are as they
    were, also one named ``_key``."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    d = docs.select("doc_id", "text", common.text_key().alias("_key"), *[F.col(c).alias(x) for c, x in own.items()])
    ids = d.groupBy("_key").agg(F.first("doc_id").alias("doc_id")).join(near_copies(d.select("_key", "text")), "_key")
    keep = ids.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "_key"))["_key"].alias("_key"))
    keep = common.materialize(keep.select("_key"), "keep")
    return d.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*[F.col(x).alias(c) for c, x in own.items()])
