"""Secret scans: fixed base patterns, and formats learned by grammar inference.

Labelled credentials form a prefix tree of character classes; states whose outgoing frequencies agree within Hoeffding
bounds are merged (ALERGIA) into a probabilistic automaton. Labelled are values that public formats' rules generate, and
those that the base patterns find in the corpus, at most ``MAX_LABELLED`` of a kind (of smallest hash): a format that is
assigned to a secret's name somewhere is so known where it stands alone. Every maximal run of credential characters is a
candidate; it is reported if the automaton explains it better than a class bigram model of ordinary tokens (generated ones,
and at most ``MAX_LABELLED`` of the corpus) by ``THRESHOLD`` nats a character, and it overlaps no base span.

Cases: null texts are empty; an empty text has no spans and the hash of the empty string; repeated rows give equal
rows; texts of any length are scanned whole; of labelled values with equal hashes the
lesser comes first, and spans of one start come in the order of the kinds; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
KINDS = ("assign", "access", "hex", "format")

SEED, SAMPLES, ALPHA, THRESHOLD = 10, 40, 0.05, 0.5
#: Labelled values of a kind, and ordinary tokens, that are learned from the corpus, at most.
MAX_LABELLED = 200
LEAST = 16
UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Formats as (prefix, alphabet, lengths of the rest); the labelled credentials are drawn from them.
FORMATS = (
    ("AKIA", UPPER + DIGITS, (16,)),
    ("", DIGITS + "abcdef", (32, 40, 64)),
    ("ghp_", UPPER + LOWER + DIGITS, (36,)),
    ("sk_live_", UPPER + LOWER + DIGITS, (24, 32)),
    ("AIza", UPPER + LOWER + DIGITS + "_-", (35,)),
    ("xoxb-", DIGITS + "-", (24,)),
    ("eyJ", UPPER + LOWER + DIGITS + "_-.", (60, 90)),
    ("", UPPER + LOWER + DIGITS + "+/", (40, 64)),
)


def char_class(c: str) -> str:
    if c in DIGITS:
        return "0"
    if c in "abcdef":
        return "a"
    if c in LOWER:
        return "z"
    if c in UPPER:
        return "Z"
    return c


#: Characters of a class, for the likelihood of the character itself; equal on both sides.
CLASSES = "0azZ+/_.=-"


def labelled(seed: int = SEED, samples: int = SAMPLES) -> tuple[list[str], list[str]]:
    """Credentials and ordinary long tokens (words, names, paths, numbers)."""
    rng = random.Random(seed)
    good = [p + "".join(rng.choices(a, k=rng.choice(n))) for p, a, n in FORMATS for _ in range(samples)]
    word = lambda: "".join(rng.choices(LOWER, k=rng.randint(3, 10)))
    bad = []
    for _ in range(samples * len(FORMATS)):
        parts = [word() for _ in range(rng.randint(3, 6))]
        bad += [
            rng.choice(["_", "-", ".", "/", ""]).join(parts), "".join(p.title() for p in parts), "".join(parts) + rng.choice(["", "...", ".", "="]), "/".join(parts) + ".html",
            "-" * rng.randint(16, 40), "=" * rng.randint(16, 40), "." * rng.randint(16, 40), f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word()}-{word()}",
            ".".join(str(rng.randint(0, 999)) for _ in range(6)), "".join(parts).upper(), str(rng.randint(10**15, 10**19)),
        ]
    return good, [b for b in bad if len(b) >= 16]


class Automaton:
    """A probabilistic automaton from merged prefix-tree states."""

    def __init__(self, texts: list[str], alpha: float = ALPHA):
        self.go: list[dict[str, int]] = [{}]
        self.out: list[Counter] = [Counter()]
        self.end = [0]
        for t in texts:
            s = 0
            for c in map(char_class, t):
                self.out[s][c] += 1
                if c not in self.go[s]:
                    self.go[s][c] = len(self.go)
                    self.go.append({})
                    self.out.append(Counter())
                    self.end.append(0)
                s = self.go[s][c]
            self.end[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, s: int) -> int:
        return self.end[s] + sum(self.out[s].values())

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for c in self.out[a].keys() | self.out[b].keys():
                if self._differ(self.out[a][c], n, self.out[b][c], m):
                    return False
                if c in self.go[a] and c in self.go[b]:
                    todo.append((self.go[a][c], self.go[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            self.out[a].update(self.out[b])
            for c, t in self.go[b].items():
                if c in self.go[a]:
                    todo.append((self.go[a][c], t))
                else:
                    self.go[a][c] = t

    def _merge_all(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.go[0])]
        while blue:
            s, c = blue.pop(0)
            b = self.go[s][c]
            if b in red:
                continue
            for r in red:
                if self._compatible(r, b):
                    self.go[s][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            known = set(red)
            blue = [(r, c) for r in red for c, t in sorted(self.go[r].items()) if t not in known]
        keep = {r: i for i, r in enumerate(red)}
        size = len(CLASSES) + 1
        self.table = []
        for r in red:
            n = self._total(r)
            row = {c: (math.log((self.out[r][c] + 0.1) / (n + 0.1 * size)), keep[t]) for c, t in self.go[r].items()}
            self.table.append((row, math.log(0.1 / (n + 0.1 * size)), math.log((self.end[r] + 0.1) / (n + 0.1 * size))))

    def log_likelihood(self, classes: str) -> float:
        s, total = 0, 0.0
        for c in classes:
            row, none, _ = self.table[s]
            p, s = row.get(c, (none, s))
            total += p
        return total + self.table[s][2]


@functools.lru_cache(maxsize=4)
def model(seed: int = SEED, samples: int = SAMPLES, found: tuple[str, ...] = (), ordinary: tuple[str, ...] = ()) -> tuple[Automaton, dict]:
    good, bad = labelled(seed, samples)
    good, bad = [*good, *found], [*bad, *ordinary]
    pairs: dict[str, Counter] = defaultdict(Counter)
    for t in bad:
        c = "^" + "".join(map(char_class, t)) + "$"
        for a, b in zip(c, c[1:], strict=False):
            pairs[a][b] += 1
    size = len(CLASSES) + 1
    plain = {a: {b: math.log((pairs[a][b] + 0.1) / (sum(pairs[a].values()) + 0.1 * size)) for b in CLASSES + "$"} for a in "^" + CLASSES}
    return Automaton(good), plain


def format_score(token: str, automaton: Automaton, plain: dict) -> float:
    """Nats a character by which the automaton explains ``token`` better than the plain model."""
    c = "".join(map(char_class, token))
    other = sum(plain[a][b] for a, b in zip("^" + c, c + "$", strict=True))
    return (automaton.log_likelihood(c) - other) / len(c)


def scan(text: str, automaton: Automaton, plain: dict, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as listed."""
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
    for at, run in runs:
        spans += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= 16]
        spans += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(run)]
    base = sorted((s, e) for _, s, e in spans)
    k = 0
    for at, run in runs:
        token = run.rstrip(".=-")
        begin, end = at, at + len(token)
        while k < len(base) and base[k][1] <= begin:
            k += 1
        if len(token) >= 16 and not any(s < end and e > begin for s, e in base[k : k + 4]) and format_score(token, automaton, plain) >= threshold:
            spans.append(("format", begin, end))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def corpus_labels(docs: DataFrame, most: int = MAX_LABELLED) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Values of base spans and ordinary tokens of all documents, at most ``most`` of each kind, by smallest hash."""
    kinds = {"assign": (ASSIGN.pattern, 2, "(?i)"), "access": (ACCESS.pattern, 0, ""), "hex": (HEX.pattern, 0, ""), "token": (RUN.pattern, 0, "")}
    all_of = lambda k: F.transform(F.regexp_extract_all("text", F.lit(kinds[k][2] + kinds[k][0]), F.lit(kinds[k][1])), lambda v: F.struct(F.lit(k).alias("kind"), F.regexp_replace(v, "[.=-]+$", "").alias("v")))
    some = docs.where(F.col("text").rlike(RUN.pattern)).select(F.inline(F.concat(*map(all_of, kinds)))).where(F.length("v") >= LEAST)
    base = F.col("v").rlike(f"{ACCESS.pattern}|{HEX.pattern}|(?i)(?:password|passwd|secret|token|api_?key)=")
    some = some.where((F.col("kind") != "token") | ~base).groupBy("kind", "v").agg(F.count("*").alias("n"))
    # a token that some label names is no ordinary one
    some = common.materialize(some, "tokens")
    named = some.where("kind <> 'token'").select("v").distinct()
    pick = lambda d: [r.v for r in d.orderBy(F.xxhash64("v"), "v").limit(most).select("v").collect()]
    found = [v for k in ("assign", "access", "hex") for v in pick(some.where(F.col("kind") == k))]
    ordinary = pick(some.where("kind = 'token'").join(named, "v", "left_anti"))
    common.discard(some)
    return tuple(found), tuple(t for t in ordinary if all(c in "0123456789+/_.=-" or c.isascii() and c.isalpha() for c in t))


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, counts a kind, the base spans and all spans as ``kind:start:end`` joined by commas."""
    automaton, plain = model(SEED, SAMPLES, *corpus_labels(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scan(t or "", automaton, plain, threshold) for t in b["text"]]
            out = {"doc_id": b["doc_id"]}
            for k in KINDS:
                out[f"n_{k}"] = [sum(x[0] == k for x in f) for f in found]
            out["base"] = [",".join(f"{k}:{s}:{e}" for k, s, e in f if k != "format") for f in found]
            out["spans"] = [",".join(f"{k}:{s}:{e}" for k, s, e in f) for f in found]
            yield pd.DataFrame(out)

    ids = docs.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {ids}, {kinds}, base string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(common.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_format")
