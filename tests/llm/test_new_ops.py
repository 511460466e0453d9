"""op11 to op13 against plain Python, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from billforge.llm import op11_whitening as o11
from billforge.llm import op12_search as o12
from billforge.llm import op13_chat as o13


# ---- whitening
def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"component": F.lit(1), "n": F.lit(2), "id": F.lit(0), "x": F.lit("")})


@pytest.mark.parametrize("far", [1, 10**13])
def test_whitening(spark, far):
    """Correlated vectors, also far from zero, where only an exact scatter has the variances; and vectors that don't count."""
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + far
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)] + [(5, [float(c) for c in data[5]]), (None, [float(c) for c in data[6]])]
    bad = [(400, None), (401, []), (402, [1.0] * 5), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("nan")] + [0.0] * 5), (405, [float("inf")] + [0.0] * 5)]
    d = vectors(spark, rows + bad, "double").repartition(5)
    got = o11.whiten(d, components=4).collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    exact = np.array([[Fraction(int(a), n) - Fraction(int(b), n * n) for a, b in zip(r, q, strict=True)] for r, q in zip(x.T @ x, np.outer(s, s), strict=True)])
    v = exact.astype(float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert len(got) == 4 * n and collections.Counter(r.vec_id for r in got) == collections.Counter(4 * [i for i, _ in rows])
    want = ((x - np.array([Fraction(int(c), n) for c in s])).astype(float) @ u) / np.sqrt(e)
    dev = {i: int(((n * r - s) ** 2).sum()) for (i, _), r in zip(rows, x, strict=True)}
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
        assert r.n == n and r.deviation == (dev[r.vec_id] if dev[r.vec_id] < 2**63 else None) and r.identity_error < 1e-9
        assert abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-9 * r.explained
    sign = {c: np.sign(by[0, c][0].whitened) * np.sign(want[0, c - 1]) for c in range(1, 5)}
    for (i, _), w in zip(rows, want, strict=True):
        for c in range(1, 5):
            assert all(abs(r.whitened * sign[c] - w[c - 1]) < 1e-7 for r in by[i, c])


def test_residues():
    rng = random.Random(1)
    moduli = o11.primes(2 * 10**40)
    assert len(set(moduli)) == len(moduli) and all(2**19 < p < 2**20 and all(p % k for k in range(2, 1024)) for p in moduli) and math.prod(moduli) > 2 * 10**40
    values = [rng.randint(-(10**40), 10**40) for _ in range(50)] + [0, -1]
    assert o11.from_residues(np.array([[v % p for v in values] for p in moduli]), moduli).tolist() == values


def test_whitening_without_spread(spark):
    schema = [f.name for f in o11.whiten(vectors(spark, [])).schema]
    assert o11.whiten(vectors(spark, [])).count() == 0 and schema[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert o11.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # a plane in three dimensions has two components; one row a vector of the most common length
    flat = o11.whiten(vectors(spark, [(i, [float(i), float(i * i), float(2 * i)]) for i in range(9)] + [(50, [1.0])]))
    assert flat.groupBy("component").count().count() == 2 and flat.where("vec_id = 50").count() == 0
    assert o11.whiten(vectors(spark, [(i, [3e38 * (-1) ** i, 1.0 * i]) for i in range(4)])).where("deviation is not null").count() == 0


# ---- search
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, top=50):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, collections.Counter(t)) for i, x in docs if (t := terms(x))]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    wanted = collections.defaultdict(set)
    for i, x in items:
        wanted[i] |= set(terms(x))
    out = []
    for item, ts in wanted.items():
        scores = []
        for at, (i, b) in enumerate(bags):
            m = 50 + (50 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, at))
        out += [(item, k + 1, i if some else None, -s) for k, (s, some, i, _) in enumerate(sorted(scores)[:top])]
    return out


def search_tables(spark, seed=3, n=260):
    rng = random.Random(seed)
    words = [*"abcdefghijklmnopqrstuvwxyz", "Ärger", "ärger", "x1", "日本", "ſ", "İ", "naïve"]
    say = lambda k: "".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) + rng.choice([" ", "_", "  ", "\n", "'", "\x7f"]) for _ in range(k))
    docs = [(i, say(rng.randint(0, 40))) for i in range(n)] + [(3, "a b"), (3, "a b"), (None, "x1 a"), (900, None), (901, ""), (902, " ?! "), (903, "Ärger " * 30_000 + "q")]
    items = [(i, say(9)) for i in range(6)] + [(7, None), (8, "neverseen"), (1, "x1 日本"), (1, "x1"), (None, "ärger q")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit("t"), "key": F.lit(1), "score": F.lit(2), "bucket": F.lit(3)})
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "weight": F.lit(9)})


@pytest.mark.parametrize("most", [500_000, 0])
def test_search(spark, most, monkeypatch):
    """Item terms broadcast, and joined by a shuffle."""
    monkeypatch.setattr(o12, "BROADCAST_ROWS", most)
    docs, items, d, q = search_tables(spark)
    assert sorted(map(str, map(tuple, o12.search(d, q).collect()))) == sorted(map(str, ranked(docs, items)))
    assert len(o12.search(d, q, top=2).collect()) == len(ranked(docs, items, 2))


def test_search_of_nothing(spark):
    docs, items, d, q = search_tables(spark, n=5)
    assert o12.search(d.limit(0), q).count() == 0 and o12.search(d, q.limit(0)).count() == 0
    assert o12.search(d.where("text is null"), q).count() == 0


# ---- chats
def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"segments": F.lit(1), "turns": F.lit("x"), "x": F.lit(None).cast("int")})


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "[[INST]]", "", " ", "[INST", "/INST]", "<s> a </s>", " é😀\n\n", "[TEXT] [TURN] x", "a" * 70_000 + " </s>", "[/TEXT] [TEXT]", "$1 \\$"]


def test_chats(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", "tool", "[TEXT] \\", None]), rng.choice([*HARD, None])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(90, 1, "user", "q"), (90, 1, "user", "q"), (90, None, "system", "s"), (90, 2, "assistant", "r"), (None, 0, "user", "x"), (91, 0, "user", "q"), (91, 1, "assistant", None)]
    d = o13.format_chats(chats(spark, rows))
    got = {r.conv_id: r for r in o13.digests(d).collect()}
    texts = {r.conv_id: r for r in d.select("conv_id", "segments", o13.formatted("segments").alias("f"), o13.read_turns(o13.formatted("segments")).alias("t")).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[c]
        assert [(t.role, t.text) for t in texts[c].t] == [(r, x) for *_, r, x in turns]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss))
        assert g.formatted_chars == len(texts[c].f) and texts[c].f.count("[INST]") == sum(r == "user" for *_, r, _ in turns) and texts[c].f.count("</s>") == sum(r == "assistant" for *_, r, _ in turns)
        roles, bad = [r for *_, r, _ in turns], None
        for i, r in enumerate(roles):
            if r not in (("system", "user") if not i else o13.INST.follows.get(roles[i - 1], ())):
                bad = i
                break
        bad = len(roles) if bad is None and roles[-1] != "assistant" else bad
        assert g.order_error == bad and g.valid == (bad is None)
    assert o13.format_chats(chats(spark, [])).count() == 0


def test_templates(spark):
    chatml = o13.Template(
        roles={r: o13.Role(f"<|{r}|>\n", "<|end|>\n", r == "assistant") for r in ("user", "assistant")}, other=o13.Role("<|other|>", "<|end|>\n"), between="<|:|>", follows={"user": ("assistant",), "assistant": ("user",)}, first=("user",), last=("assistant",)
    )
    d = o13.format_chats(chats(spark, [(1, 0, "user", "<|end|> hi"), (1, 1, "assistant", "<|user|>\\"), (1, 2, "x<|:|>", "y")]), chatml)
    r = d.select(o13.formatted("segments").alias("f"), o13.read_turns(o13.formatted("segments"), chatml).alias("t"), "order_error").first()
    assert r.f == "<|user|>\n<\\|end|> hi<|end|>\n<|assistant|>\n<\\|user|>\\\\<|end|>\n<|other|>x<\\|:|><|:|>y<|end|>\n" and r.order_error == 2
    assert [(t.role, t.text) for t in r.t] == [("user", "<|end|> hi"), ("assistant", "<|user|>\\"), ("x<|:|>", "y")]
    for bad in (dict(between=""), dict(between="<|a\\"), dict(between="x<")):
        with pytest.raises(ValueError):
            o13.Template(**{**{k: getattr(chatml, k) for k in ("roles", "other", "follows", "first", "last")}, "between": bad["between"]})


# ---- licenses, at every offset
def test_licenses_at_every_offset(spark):
    """Templates with words changed, left out and put in, against the best alignment over all windows of all offsets; within 3 % of the coverage either verdict will do."""
    from billforge.llm import op6_licenses as o6

    rng = random.Random(17)
    vocabulary = [f"word{i}" for i in range(300)]
    templates = {"one": " ".join(rng.choices(vocabulary, k=60)), "two": " ".join(rng.sample(vocabulary, 25)), "three": "Released under the Foo License version two point zero of this kind"}
    texts = []
    for i in range(90):
        w = o6.WORD.findall(templates[rng.choice(sorted(templates))].lower())
        edits = int(rng.choice([0, 0.05, 0.08, 0.1, 0.15, 0.3]) * len(w))
        for _ in range(edits):
            at, kind = rng.randrange(len(w)), rng.random()
            w[at : at + (kind < 0.7)] = [] if kind < 0.35 else [rng.choice(vocabulary)]
        noise = lambda: rng.choices([*vocabulary, "released", "under", "the"], k=rng.randint(0, 50))
        texts.append((i, " ".join([*noise(), *w, *noise(), *(w if i % 9 == 0 else [])])))
    texts += [(900, None), (901, ""), (902, "released under the")]
    got = {r.doc_id: set(r.licenses) for r in o6.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), templates).collect()}
    sure = 0
    for i, t in texts:
        words = o6.WORD.findall((t or "").lower())
        for n, x in templates.items():
            own = o6.WORD.findall(x.lower())
            slack = max(2, len(own) // 4)
            best = max((len(o6.patience(own, words[p : p + len(own) + slack])) for p in range(len(words))), default=0) / len(own)
            if abs(best - o6.COVERAGE) >= 0.03:
                assert (n in got[i]) == (best > o6.COVERAGE), (i, n, best)
                sure += n in got[i]
    assert sure >= 25
