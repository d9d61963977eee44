import random

import pytest

from bazaar.llm.suffix_dedup import repeated_passages

from .data import odd_rows, prose, row, table

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, size=50):
    """Words inside any run of ``size`` words that another document has."""
    w = [(r[0], (r[1] or "").translate(LOWER).split()) for r in rows if r[0] is not None]
    held = {}
    for i, t in w:
        for s in range(len(t) - size + 1):
            held.setdefault(tuple(t[s:s + size]), set()).add(i)
    out = {}
    for i, t in w:
        out.setdefault(i, set())
        for s in range(len(t) - size + 1):
            if len(held[tuple(t[s:s + size])]) > 1:
                out[i] |= set(range(s, s + size))
    return {i: x for i, x in out.items() if x}


def made():
    rng = random.Random(6)
    passage = [prose(rng, n) for n in (49, 50, 55, 80, 300)]
    rows = [row(i, prose(rng, rng.randint(0, 150))) for i in range(60)]
    for i in range(60, 100):
        rows.append(row(i, prose(rng, rng.randint(0, 90)) + " " + passage[i % 5].upper() + "\n" + prose(rng, 30)))
    rows += [row(200 + i, passage[3]) for i in range(5)] + [row(300, passage[1] + " " + passage[1])]
    twin = prose(rng, 120)
    return [*rows, row(400, twin), row(401, twin.upper()), *odd_rows()]


def check(got, want):
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        words = {p for s in r.spans for p in range(s.start, s.end)}
        assert words == want[r.doc_id] and r.n_repeated == len(words)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_against_brute_force(spark):
    rows = made()
    check(repeated_passages(table(spark, rows)).collect(), brute(rows))


@pytest.mark.parametrize("hot", [0, 2, 5_000])
def test_many_partitions_and_hot_grams(spark, hot):
    rows = made()
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        check(repeated_passages(table(spark, rows), hot=hot).collect(), brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("hot", [0, 100, 5_000])
def test_pairs_that_share_ten_words_before_a_footer_of_many(spark, hot):
    rng = random.Random(7)
    footer = prose(rng, 40)
    rows = [row(1000 + i, prose(rng, 60) + " " + footer + " " + prose(rng, 20)) for i in range(300)]
    for i in range(30):
        both = prose(rng, 10)
        rows += [row(2 * i + j, prose(rng, 30) + " " + both + " " + footer + " " + prose(rng, 30)) for j in (0, 1)]
    want = brute(rows)
    assert set(range(60)) <= set(want)
    check(repeated_passages(table(spark, rows), hot=hot).collect(), want)


def test_a_middle_match_beside_longer_ones_on_either_side(spark):
    # entry's best neighbour to the right, to the left, and a third document with some of both
    rng = random.Random(8)
    gram, left, right = prose(rng, 20), prose(rng, 30), prose(rng, 30)
    lw, rw = left.split(), right.split()
    other = lambda n: prose(rng, n)
    rows = [row(1, other(9) + " " + left + " " + gram + " " + right + " " + other(9)),
            row(2, other(40) + " " + gram + " " + " ".join(rw[:25]) + " " + other(9)),
            row(3, other(9) + " " + left + " " + gram + " " + other(40)),
            row(4, other(9) + " " + " ".join(lw[15:]) + " " + gram + " " + " ".join(rw[:20]) + " " + other(9))]
    check(repeated_passages(table(spark, rows)).collect(), brute(rows))


def test_empty_table(spark):
    assert repeated_passages(table(spark, [])).count() == 0
    assert repeated_passages(table(spark, odd_rows())).count() == 0
