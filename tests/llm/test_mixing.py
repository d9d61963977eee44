import random

import pytest

from bazaar.llm.mixing import flight, land, mix_sources

from .data import odd_rows, prose, row, table


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """By repeated resharing: cap what is above, share the excess by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    total, out, free = float(sum(sizes.values())), {}, list(names)
    while free:
        left = total - sum(out.values())
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: w[s] * unit for s in free}
        out |= {s: most * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return out


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 700):
        size = [float(rng.randint(1, 400)) for _ in range(n)]
        p = [rng.choice([0.0, 1.0, .37, rng.random()]) for _ in range(n)]
        out = flight(p, size, rng)
        assert sum(0 < x < 1 for x in out) <= 2
        assert sum(out) == pytest.approx(sum(p)) and all(0 <= x <= 1 for x in out)
        assert sum(x * s for x, s in zip(out, size)) == pytest.approx(sum(x * s for x, s in zip(p, size)))
        assert all(x in (0.0, 1.0) for x in land(out, size))


def test_flight_is_unbiased():
    n, runs = 12, 3000
    size, total = [float(1 + i % 5) for i in range(n)], [0.0] * n
    for k in range(runs):
        for i, x in enumerate(flight([.3] * n, size, random.Random(k))):
            total[i] += x / runs
    assert all(abs(t - .3) < .05 for t in total)


def test_landing_makes_up_a_long_document():
    """One long document left open is made up by several exchanges of short ones."""
    rng = random.Random(3)
    size = [float(rng.randint(20, 60)) for _ in range(400)] + [1500.0]
    p = [float(i % 2) for i in range(400)] + [.5]
    out = land(p, size)
    assert all(x in (0.0, 1.0) for x in out) and abs(sum(out) - sum(p)) <= 1
    assert sum(x * s for x, s in zip(out, size)) == pytest.approx(sum(x * s for x, s in zip(p, size)), abs=1)


def test_targets_limits_and_reruns(spark):
    rng = random.Random(2)
    rows = [row(i, prose(rng, rng.randint(1, 300)), source=rng.choice("aaaaaaaaaabcde")) for i in range(900)]
    rows += [row(2000 + i, prose(rng, 5), source="tiny") for i in range(3)] + odd_rows(3000)
    rows += [row(4000, None, source="empty")]
    got = [tuple(r) for r in mix_sources(table(spark, rows), block=128).collect()]
    again = [tuple(r) for r in mix_sources(table(spark, rows[::-1]).repartition(7), block=128).collect()]
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    size_of = {r[0]: len((r[1] or "").split()) for r in rows}
    source_of = {r[0]: r[3] for r in rows}
    totals, taken = {}, {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + len((r[1] or "").split())
    want = targets(totals)
    for doc, size, source_size, target, words, copies in got:
        if doc is not None and doc != 3007:
            assert size == size_of[doc]
        s = source_of[doc]
        assert source_size == totals[s] and target == pytest.approx(want[s])
        assert words == size * copies and 0 <= copies <= 3
        taken[s] = taken.get(s, 0) + words
    for s in "abcde":
        assert taken[s] == pytest.approx(want[s], rel=.01)
    assert want["tiny"] == 3 * totals["tiny"] == taken["tiny"]


def test_empty_table(spark):
    assert mix_sources(table(spark, [])).count() == 0
    assert [r.taken for r in mix_sources(table(spark, [row(1, None), row(2, "")])).collect()] == [0, 0]
