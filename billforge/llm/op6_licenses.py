"""License scans by patience alignment against templates.

Words are runs of letters and digits, lower-cased. Places where a text may hold a template follow from the
template's words of KEY letters or more (all its words, if it has none): each occurrence votes for a start, and close
starts are one window. A window and the template are aligned on the words unique to both, along their longest
increasing subsequence, and recursively in the gaps. Coverage is the share of template words aligned; spans of
COVERAGE or more are reported. Only texts with one of the ``gate`` words are aligned: words that make up more of every template
than may be missing, so that no other text can reach the coverage; the JVM tells them apart.

Cases: null and empty texts hold no license; repeated rows give equal rows; overlapping finds of one template keep
the best, then the first; texts of any length are scanned whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COVERAGE, KEY = 0.9, 7
WORD = re.compile(r"[^\W_]+")

# fixed values: public license statements
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def patience(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned places of two word lists, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        where = {w: y for y, w in enumerate(b[k:m], k) if cb[w] == 1}
        pairs = [(x, where[w]) for x, w in enumerate(a[i:j], i) if ca[w] == 1 and w in where]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, y) in enumerate(pairs):
            p = bisect_left(tails, y)
            back.append(ends[p - 1] if p else -1)
            if p == len(tails):
                tails.append(y)
                ends.append(n)
            else:
                tails[p], ends[p] = y, n
        n = ends[-1] if ends else -1
        chain = []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        out += chain
        x0, y0 = i, k
        for x, y in [*chain[::-1], (j, m)] if chain else []:
            if x > x0 and y > y0:
                todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.words = {n: WORD.findall(t.lower()) for n, t in templates.items()}
        self.words = {n: w for n, w in self.words.items() if w}
        self.keys: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for n, w in self.words.items():
            long = [x for x in w if len(x) >= KEY] or w
            for i, x in enumerate(w):
                if x in long:
                    self.keys[x].append((n, i))
        self.gate = self._gate()

    def _gate(self) -> list[str]:
        """Words of which each template holds more than it may lack, found greedily: the one that helps most first, longer ones before shorter."""
        need = {n: int((1 - self.coverage) * len(w) + 1e-9) + 1 for n, w in self.words.items()}
        left, out = {n: Counter(w) for n, w in self.words.items()}, []
        while any(v > 0 for v in need.values()):
            gain: Counter = Counter()
            for n, c in left.items():
                for w, k in c.items():
                    gain[w] += min(k, max(need[n], 0)) * (len(w) >= KEY or all(len(x) < KEY for x in c))
            best = max(gain, key=lambda w: (gain[w], len(w), w))
            out.append(best)
            for n, c in left.items():
                need[n] -= c.pop(best, 0)
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage) in code points."""
        found = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        starts: dict[str, list[int]] = defaultdict(list)
        for p, (w, _, _) in enumerate(found):
            for n, off in self.keys.get(w, ()):
                starts[n].append(p - off)
        out = []
        for n, at in starts.items():
            t = self.words[n]
            slack = max(2, len(t) // 4)
            at.sort()
            hits, first, last = [], at[0], at[0]
            for s in [*at[1:], None]:
                if s is not None and s - last <= slack and s - first <= len(t):
                    last = s
                    continue
                lo, hi = max(0, first - slack), min(len(found), last + len(t) + slack)
                pairs = patience(t, [w for w, _, _ in found[lo:hi]])
                if pairs and len(pairs) >= self.coverage * len(t):
                    hits.append((len(pairs) / len(t), found[lo + pairs[0][1]][1], found[lo + pairs[-1][1]][2]))
                first = last = s if s is not None else 0
            taken: list[tuple[int, int]] = []
            for c, s, e in sorted(hits, key=lambda x: (-x[0], x[1])):
                if all(e <= a or s >= b for a, b in taken):
                    taken.append((s, e))
                    out.append((n, s, e, c))
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, n_licenses, licenses, spans`` for every row."""
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scanner.scan(t or "") for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_licenses": [len(f) for f in found], "licenses": [sorted({x[0] for x in f}) for f in found],
                "spans": [[{"license": n, "start": s, "end": e, "coverage": round(c, 6)} for n, s, e, c in f] for f in found],
            })

    ids = docs.schema["doc_id"].dataType.simpleString()
    # a text without a gate word goes to Python as null
    gated = F.when(F.lower("text").rlike("|".join(map(re.escape, scanner.gate))), F.col("text")).alias("text") if scanner.gate else F.lit(None).cast("string").alias("text")
    return docs.select("doc_id", gated).mapInPandas(run, f"doc_id {ids}, n_licenses long, licenses array<string>, spans array<struct<license:string,start:int,end:int,coverage:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.read_table(spark, sf_dir, "documents"))
