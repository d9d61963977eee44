import random
import re
from collections import Counter

import numpy as np

from bazaar.llm.divergence import accumulate, divergence_audit

from .data import odd_rows, prose, row, table

LOWER = {i: i + 32 for i in range(65, 91)}
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, top=50):
    docs = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        v, counts = len(kept), {}
        for d in docs:
            if d[0] == lang:
                counts.setdefault(d[1], Counter()).update(t for t in d[2] if held[t] >= min_docs)
        def shares(c):
            n = sum(c.values())
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * v) for t in kept}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in p:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(found)]
    return sorted(out)


def audit(spark, rows, **how):
    return sorted(tuple(r) for r in divergence_audit(table(spark, rows), **how).collect())


def some_rows(rng, n, sources):
    return [row(i, prose(rng, rng.randint(0, 30), lang).upper() if i % 5 == 0 else prose(rng, rng.randint(0, 30), lang),
                lang, rng.choice(sources)) for i, lang in ((i, rng.choice(["en", "fr", "de"])) for i in range(n))]


def test_against_brute_force(spark):
    rng = random.Random(13)
    rows = some_rows(rng, 200, ["a", "b", "é", "z", None, "only"]) + odd_rows()
    rows += [row(500 + i, "", "en", f"empty{i}") for i in range(3)] + [row(600, "alone", "it", "a"), row(601, None, "it", "b")]
    got = audit(spark, rows, min_docs=4)
    assert got == brute(rows, 4) and {r[2] for r in got} == {"pair", "term"}
    assert audit(spark, rows, min_docs=4, top=3) == brute(rows, 4, 3)
    assert audit(spark, rows, min_docs=10_000) == brute(rows, 10_000)  # no kept terms: every pair is 0


def test_many_sources_and_tiles(spark, monkeypatch):
    monkeypatch.setattr("bazaar.llm.divergence.PEERS", 3)
    monkeypatch.setattr("bazaar.llm.divergence.POSTINGS", 20)
    rng = random.Random(14)
    rows = some_rows(rng, 300, [f"s{i}" for i in range(14)])
    assert audit(spark, rows, min_docs=3) == brute(rows, 3)


def test_one_accumulator_against_dense_rows():
    rng = np.random.default_rng(5)
    n, v = 6, 40
    counts = rng.poisson(.6, (n, v))
    base = rng.integers(10, 30, n)
    p = np.where(counts > 0, base[:, None] + counts * rng.integers(1, 40, (n, 1)), base[:, None])
    group, term = np.nonzero(counts)
    got = accumulate(term, group, p[group, term], base, np.arange(n), np.arange(n))
    for g in range(n):
        for h in range(n):
            if g != h:
                assert np.abs(p[g] - p[h]).sum() == v * abs(base[g] - base[h]) + got[g, h]


def test_empty_table(spark):
    out = divergence_audit(table(spark, []))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0
