"""Suffix-array dedup: bytes under any LENGTH-byte string that also starts elsewhere.

Every window of LENGTH bytes belongs to the anchor that its content selects (the rightmost least hash of its
GRAM-byte grams), so equal windows have equal anchors at equal offsets. Anchors that occur once are dropped; the
windows of an anchor form one context (at most 2 LENGTH - GRAM bytes). Contexts equal to another are covered whole.
Where an anchor has several contexts, their enhanced suffix array is built and a stack scan of its common-prefix
intervals reports the maximal repeats: intervals of LENGTH or more whose left neighbours differ, with all their
occurrences. A group of more than GROUP contexts is dealt out before it is scanned: equal windows stand at equal distances
from the anchor, so contexts are cut into stretches of WIDTHS windows of like distance, and stretches whose windows may be
equal share all bytes that lie in every one of them. Groups that are still too large are cut into narrower stretches; the
narrowest is one window, of which equal ones need no scan.

Cases: null texts are empty; texts shorter than LENGTH lose nothing; repeated rows cover each other; bytes that are
no full character may be left where a span ends within one; ties of hashes are ordered by place; texts of any length
are cut into overlapping pieces, windows never; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM, GROUP = 200, 32, 1000
WIDTHS = (16, 1)
PIECE = 1 << 20  # windows looked at together, of one long text or several short ones
CHUNK = 400  # contexts in one suffix array
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    size = 1 << max(16, (len(raw) + 1).bit_length())
    up, down = _powers(size)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    h = (c[gram:] - c[:-gram]) * down[: len(c) - gram]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    n = -(-len(h) // w) * w
    x = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    x[: len(h)] = h
    x = x.reshape(-1, w)
    pre = np.minimum.accumulate(x, axis=1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(h) - w + 1
    return np.minimum(suf[:m], pre[w - 1 : w - 1 + m])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, in one or more parts: its index, anchor hashes, the first and last window of each anchor, and the bytes from
    the first window's start to the anchor."""
    batch: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, PIECE):
            piece = t[at : at + PIECE + length - 1]
            if size + len(piece) > 2 * PIECE and batch:
                yield from _anchors(batch, length, gram)
                batch, size = [], 0
            batch.append((k, at, piece))
            size += len(piece)
    if batch:
        yield from _anchors(batch, length, gram)


def _anchors(batch: list[tuple[int, int, bytes]], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    w = length - gram + 1
    h = _gram_hashes(np.frombuffer(b"".join(p for _, _, p in batch), np.uint8), gram)
    least = _window_min(h, w)
    lens = np.array([len(p) for _, _, p in batch])
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    # windows where the anchor changes: a text begins, the entering gram is least, or the least one has left
    change = h[w - 1 : w - 1 + len(least)] == least
    entered = change.copy()
    change[1:] |= least[1:] != least[:-1]
    change[begin] = True
    ends = begin + lens - length + 1  # the first window past each text
    change[ends[:-1]] = True
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], len(least)) - 1
    owner = np.searchsorted(begin, starts, "right") - 1
    real = starts < ends[owner]
    starts, stops, owner = starts[real], stops[real], owner[real]
    at = starts + w - 1
    for a in range(0, len(starts), 4096):
        i = a + np.flatnonzero(~entered[starts[a : a + 4096]])
        if len(i):
            rows = np.lib.stride_tricks.sliding_window_view(h, w)[starts[i]]
            at[i] = starts[i] + w - 1 - np.argmin(rows[:, ::-1], axis=1)
    cut = np.searchsorted(owner, np.arange(len(batch) + 1))
    for j, (k, off, _) in enumerate(batch):
        a, b = cut[j], cut[j + 1]
        yield k, h[at[a:b]], starts[a:b] - begin[j] + off, stops[a:b] - begin[j] + off, at[a:b] - starts[a:b]


def maximal_repeats(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Suffixes of ``length`` bytes or more in order, as (context, offset), and the maximal repeat groups
    ``(common prefix, first, last)`` over that order."""
    sizes = np.array([len(c) for c in contexts])
    width = int(sizes.max())
    buf = np.frombuffer(b"".join(c + b"\0" * width for c in contexts), np.uint8)
    if any(0 in c for c in contexts):  # padding must differ from every byte of the texts
        real = np.concatenate([np.repeat([True, False], [len(c), width]) for c in contexts])
        buf = np.where(real, buf.astype(np.uint16) + 1, 0).astype(">u2")
    n = np.maximum(sizes - length + 1, 0)
    who = np.repeat(np.arange(len(contexts)), n)
    off = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    rest = sizes[who] - off
    longest = np.argsort(-rest, kind="stable")  # of equal padded suffixes the longer stand first
    who, off, rest = who[longest], off[longest], rest[longest]
    base = np.cumsum(sizes + width) - (sizes + width)
    rows = np.lib.stride_tricks.sliding_window_view(buf, width)[base[who] + off]
    order = np.argsort(rows.view(f"S{width * buf.itemsize}")[:, 0], kind="stable")
    who, off, rest = who[order], off[order], rest[order]
    rows = rows[order]
    if len(rows) < 2:
        return who, off, []
    same = rows[1:] == rows[:-1]
    lcp = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    lcp = np.minimum(lcp, np.minimum(rest[1:], rest[:-1]))
    left = np.where(off > 0, buf[np.maximum(base[who] + off - 1, 0)].astype(np.int64), 257 + np.arange(len(who)))
    turns = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    groups: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
    last = -2
    for i in np.append(np.flatnonzero(lcp >= length), len(lcp) + 1).tolist():
        runs = [(i, int(lcp[i]))] if i < len(lcp) else []
        if i != last + 1:  # a gap: everything open ends at the suffix after the last common prefix
            runs = [(last + 1, 0), *runs]
        for at, value in runs:
            first = at
            while stack and stack[-1][0] > value:
                size, first = stack.pop()
                if turns[at] != turns[first]:
                    groups.append((size, first, at))
            if value >= length and (not stack or stack[-1][0] < value):
                stack.append((value, first))
        last = i
    return who, off, groups


def covered(contexts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Merged spans of each context that lie in a maximal repeat of ``length`` or more."""
    who, off, groups = maximal_repeats(contexts, length)
    reach = np.zeros(len(who), np.int64)
    for size, a, b in groups:
        np.maximum(reach[a : b + 1], size, out=reach[a : b + 1])
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    hit = np.flatnonzero(reach)
    hit = hit[np.lexsort((off[hit], who[hit]))]
    for k, a, b in zip(who[hit].tolist(), off[hit].tolist(), (off[hit] + reach[hit]).tolist(), strict=True):
        spans = out[k]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return out


def merge(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<b:int,e:int>>"


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs(text binary)`` → ``(key binary, spans array<struct<b, e>>)`` of the texts that hold repeats; key is the MD5."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            for part in _grouped(anchors(list(b["text"]), length, gram), 200_000):
                hs = np.concatenate([x[1] for x in part])
                of = np.repeat(ids[[x[0] for x in part]], [len(x[1]) for x in part])
                o = np.lexsort((hs, of))
                hs, of = hs[o], of[o]
                new = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (of[1:] != of[:-1])]))
                yield pd.DataFrame({"a": hs[new].view(np.int64), "c": np.minimum(np.diff(np.append(new, len(hs))), 2).astype(np.int32), "id": of[new]})

    # the id stands for a text; two texts that share one look at each other's anchors too, which loses nothing
    d = docs.select(F.xxhash64("text").alias("id"), "text").where(F.octet_length("text") >= length)
    rows = common.materialize(d.mapInPandas(count, "a long, c int, id long"), "anchors")
    twice = rows.groupBy("a").agg(F.sum("c").alias("c")).where("c > 1").select("a")
    need = common.materialize(rows.join(twice, "a", "left_semi").groupBy("id").agg(F.collect_set("a").alias("need")), "need")
    common.discard(rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("g", "ch", "key", "starts", "n", "off", "ctx")
        for b in batches:
            texts = list(b["text"])
            needs = [np.sort(np.array(x, np.int64)) for x in b["need"]]
            out: dict[str, list] = {k: [] for k in names}
            for k, hs, first, last, off in anchors(texts, length, gram):
                hs = hs.view(np.int64)
                i = np.flatnonzero(np.isin(hs, needs[k]))
                own: dict[tuple[int, int, bytes], list[int]] = {}
                for a, s, e, o in zip(hs[i].tolist(), first[i].tolist(), last[i].tolist(), off[i].tolist(), strict=True):
                    own.setdefault((a, o, texts[k][s : e + length]), []).append(s)
                for (a, o, ctx), starts in own.items():
                    for name, v in zip(names, (a.to_bytes(8, "big", signed=True), xxhash.xxh3_128_digest(ctx), b["key"].iloc[k], starts, len(starts), o, ctx), strict=True):
                        out[name].append(v)
                if len(out["g"]) > 20_000:
                    yield pd.DataFrame(out)
                    out = {k: [] for k in out}
            yield pd.DataFrame(out)

    full = d.join(need, "id").select("text", "need", F.unhex(F.md5("text")).alias("key"))
    ctx = common.materialize(full.mapInPandas(cut, "g binary, ch binary, key binary, starts array<int>, n long, off int, ctx binary"), "contexts")
    common.discard(need)
    cover = common.materialize(_cover(ctx, length, WIDTHS), "cover")
    at = ctx.select("g", "ch", "key", F.explode("starts").alias("s")).distinct().join(cover, ["g", "ch"])
    moved = F.transform("spans", lambda x: F.struct((x["b"] + F.col("s")).alias("b"), (x["e"] + F.col("s")).alias("e")))
    spans = common.materialize(at.select("key", F.explode(moved).alias("x")).groupBy("key").agg(F.collect_set("x").alias("spans")), "spans")
    common.discard(ctx, cover)
    return spans


def _cover(rows: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """``rows(g, ch, n, off, ctx)``, the contexts of groups ``g`` with their content's hash, occurrences and the bytes before the anchor
    → ``(g, ch, spans)``: the parts of each context that stand in its group twice or more."""
    uniq = common.materialize(rows.groupBy("g", "ch").agg(F.sum("n").alias("n"), F.min("off").alias("off"), F.min("ctx").alias("ctx")), "contexts")
    kinds = common.materialize(uniq.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    mixed = uniq.join(kinds, "g")

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, bytes, bytes]] = []
        for b in batches:
            for row in zip(b["g"], b["ch"], b["ctx"], strict=True):
                if len(held) >= CHUNK and row[0] != held[-1][0]:
                    yield _spans(held)
                    held = []
                held.append(row)
        if held:
            yield _spans(held)

    def _spans(held: list[tuple[bytes, bytes, bytes]]) -> pd.DataFrame:
        found = covered([x[2] for x in held], length)
        keep = [(g, ch, [{"b": s, "e": e} for s, e in f]) for (g, ch, _), f in zip(held, found, strict=True) if f]
        return pd.DataFrame(keep, columns=["g", "ch", "spans"])

    some = mixed.where(F.col("kinds") <= GROUP).select("g", "ch", "ctx").repartition("g").sortWithinPartitions("g")
    some = some.mapInPandas(suffixes, f"g binary, ch binary, spans {_SPANS}")
    if kinds.where(F.col("kinds") > GROUP).limit(1).count():
        width = widths[0]

        def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ("g", "ch", "n", "off", "ctx", "of_g", "of_ch", "o")
            for b in batches:
                out: list[tuple] = []
                for g, ch, n, off, c in zip(b["g"], b["ch"], b["n"], b["off"], b["ctx"], strict=True):
                    last = len(c) - length  # the windows start at 0 to last, off to off - last bytes before the anchor
                    for k in range((off - last) // width, off // width + 1):
                        lo, hi = max(0, off - (k + 1) * width + 1), min(last, off - k * width)
                        core = c[off - k * width : off - (k + 1) * width + 1 + length]
                        part = c[lo : hi + length]
                        out.append((xxhash.xxh3_128_digest(k.to_bytes(4, "big", signed=True) + core), xxhash.xxh3_128_digest(part), n, off - lo, part, g, ch, lo))
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

        hot = mixed.where(F.col("kinds") > GROUP).select("g", "ch", "n", "off", "ctx")
        parts = common.materialize(hot.mapInPandas(stretches, "g binary, ch binary, n long, off int, ctx binary, of_g binary, of_ch binary, o int"), "stretches")
        found = _cover(parts, length, widths[1:])
        moved = F.transform("spans", lambda x: F.struct((x["b"] + F.col("o")).alias("b"), (x["e"] + F.col("o")).alias("e")))
        found = parts.select("g", "ch", F.col("of_g"), "of_ch", "o").join(found, ["g", "ch"]).select(F.col("of_g").alias("g"), F.col("of_ch").alias("ch"), F.explode(moved).alias("x"))
        some = some.union(found.groupBy("g", "ch").agg(F.collect_set("x").alias("spans")))
    whole = uniq.where("n > 1").select("g", "ch", F.array(F.struct(F.lit(0).alias("b"), F.octet_length("ctx").alias("e"))).alias("spans"))
    return whole.union(some.join(uniq.where("n > 1").select("g", "ch"), ["g", "ch"], "left_anti"))


def _grouped(parts: Iterator, size: int) -> Iterator[list]:
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept binary`` for every row: merged removed spans, and the other bytes."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    spans = repeat_spans(d.select("text"), length, gram)
    d = d.withColumn("key", F.unhex(F.md5("text"))).join(spans, "key", "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gone = [merge([(x["b"], x["e"]) for x in s]) if s is not None else [] for s in b["spans"]]
            kept = []
            for t, g in zip(b["text"], gone, strict=True):
                ends = [0, *[e for _, e in g]]
                kept.append(b"".join(t[e:s] for e, (s, _) in zip(ends, [*g, (len(t), 0)], strict=True)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t) for t in b["text"]], "spans": [[{"b": s, "e": e} for s, e in g] for g in gone], "kept": kept})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(strip, f"doc_id {ids}, n_bytes long, spans {_SPANS}, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.read_table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return out.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of LENGTH bytes, counted; runs of those found twice, merged.
SQL = """
with d as (select doc_id, row_number() over () rid, encode(coalesce(text, '')) t, octet_length(encode(coalesce(text, ''))) n from documents),
w as (select rid, i, md5(t[i + 1 : i + 200]) k from (select rid, t, unnest(range(n - 199)) i from d where n >= 200)),
hit as (select rid, i, i - lag(i) over (partition by rid order by i) > 200 fresh from w where k in (select k from w group by k having count(*) > 1)),
run as (select rid, min(i) b, max(i) + 200 e from (select rid, i, sum(coalesce(fresh, true)::int) over (partition by rid order by i) g from hit) group by rid, g),
cut as (select rid, b, e, coalesce(lag(e) over (partition by rid order by b), 0) p from run),
r as (select rid, sum(e - b) removed, count(*) spans, max(e) last, string_agg(hex(t[p + 1 : b]), '' order by b) h from cut join d using (rid) group by rid)
select doc_id, cast(n as bigint) n_bytes, cast(coalesce(removed, 0) as bigint) n_removed, cast(coalesce(spans, 0) as bigint) n_spans, sha256(unhex(coalesce(h, '') || hex(t[coalesce(last, 0) + 1 : n]))) kept_sha256 from d left join r using (rid)
"""
