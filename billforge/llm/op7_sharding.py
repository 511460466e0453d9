"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within each source; ordered by fractional rank
(2 rank - 1) / 2n, every stretch of the order holds the sources in their overall proportions, and it is cut
into shards whose row counts differ by one at most (law ``rows``).

Cases: null texts have size 1 and CRC-32 zero, as empty ones; a null source is a stratum of its own; rows that
are equal in id and text take neighbouring places, whichever comes first; an empty table gives no rows; extra
columns are not read by the query. The stage returns them too; one that has a result's name comes back as ``doc_`` and the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS, SEED, CELLS = 16, 7, 4096


def shuffle_key(seed: int, doc_id, text) -> Column:
    """A seeded hash of a row, 60 bits of MD5 in the upper bits of a long."""
    md5 = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text).cast("binary"))
    return F.shiftleft(F.conv(F.substring(md5, 1, 15), 16, 10).cast("long"), 4)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, then the columns to carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").alias("_id"), common.source_key().alias("_src"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        shuffle_key(seed, F.col("doc_id"), text).alias("_key"), F.struct(*carry).alias("_rest") if carry else F.lit(None).cast("int").alias("_rest"),
    )
    if not carry:
        base = common.materialize(base, "sizes")
    r = common.ranked(base, ["_src"], "_key", ["_id", "_crc"])
    r = r.withColumn("_at", (2 * F.col("rank") - 1) / (2.0 * F.col("n"))).withColumn("_cell", F.floor(F.col("_at") * CELLS).cast("int")).drop("rank", "n")
    r = common.materialize(r, "ranks")
    # at most CELLS rows: places before each stretch of fractional ranks, and all rows
    every = Window.orderBy("_cell")
    cells = r.groupBy("_cell").agg(F.count("*").alias("c"))
    cells = cells.select("_cell", (F.sum("c").over(every) - F.col("c")).alias("c0"), F.sum("c").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    place = F.col("c0") + F.row_number().over(Window.partitionBy("_cell").orderBy("_at", "_src", "_key", "_id", "_crc")) - 1
    r = r.join(F.broadcast(cells), "_cell").withColumn("_place", place).withColumn("shard", F.expr(f"_place * {shards} div n").cast("int"))
    slot = F.col("_place") - F.expr(f"(shard * n + {shards - 1}) div {shards}")
    return r.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col("_rest")[c].alias(c) for c in carry],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.read_table(spark, sf_dir, "documents"))


RESULTS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``query`` with the other columns of ``docs``."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("doc_id", "text", "source", *[F.col(c).alias(x) for c, x in own.items()])
    taken = set(RESULTS) | set(docs.columns)
    names = {}
    for c in docs.columns:
        if c != "doc_id":
            name = c
            while name in RESULTS or (name != c and name in taken):
                name = f"doc_{name}"
            taken.add(name)
            names[c] = name
    out = shard_documents(rows, carry=tuple(own[c] for c in names))
    return out.select(*RESULTS, *[F.col(own[c]).alias(x) for c, x in names.items()])


#: CRC-32 by bytes, with a table made from its polynomial.
SQL = """
with crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) tab),
d as (select doc_id, source, coalesce(text, '') text, octet_length(encode(coalesce(text, ''))) n from documents),
s as (select doc_id, source, cast(n + 1 as bigint) size, substr(md5('7|' || coalesce(cast(doc_id as varchar), '') || '|' || text), 1, 15) k,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(hex(encode(text)), cast(2 * i + 1 as bigint), 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) text_crc32 from d, crc),
r as (select *, (2 * row_number() over (partition by source order by k, doc_id, text_crc32) - 1) / (2.0::double * count(*) over (partition by source)) pos, count(*) over () n from s),
p as (select *, row_number() over (order by pos, source is null, coalesce(source, ''), k, doc_id, text_crc32) - 1 place from r)
select doc_id, size, text_crc32, 'rows' law, cast(place * 16 // n as int) shard, cast(place - ((place * 16 // n) * n + 15) // 16 as bigint) slot, cast(null as int) grown_shard from p
"""
