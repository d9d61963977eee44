import random

import numpy as np

from bazaar.llm._graph import connected_components
from bazaar.llm.near_dedup import circulant_signature, near_duplicates, pi

from .data import odd_rows, prose, row, table

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size=5):
    w = (text or "").translate(LOWER).split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, percent=85):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 999))
    return " ".join(w)


def test_against_brute_force_with_small_blocks(spark):
    rng = random.Random(7)
    rows = [row(i, prose(rng, rng.randint(0, 60))) for i in range(40)]
    base = prose(rng, 160)
    rows += [row(100 + i, changed(rng, base, rng.randint(0, 6))) for i in range(90)]
    other = prose(rng, 200)
    rows += [row(300 + i, other) for i in range(30)] + [row(400 + i, changed(rng, other, i)) for i in range(6)]
    rows += [row(500, "a b c"), row(501, "A  b\tc"), row(502, "a b d")] + odd_rows()
    rng.shuffle(rows)
    for block in (256, 8):
        got = near_duplicates(table(spark, rows), block=block).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0


def test_pi_is_a_permutation_and_signatures_estimate_similarity():
    x = np.arange(1 << 18, dtype=np.uint32)
    assert len(np.unique(pi(x))) == len(x)
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = np.sort(u[:1000]), np.sort(u[500:])  # similarity 1/3
    s = circulant_signature(np.concatenate([a, b]), np.array([0, 1000, 2000]), 1024)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < .06


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, None)]
    rng.shuffle(links)
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links, "a bigint, b bigint").repartition(5), "a", "b").collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
