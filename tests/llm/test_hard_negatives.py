import math
import random

import numpy as np
import pytest

from bazaar.llm.hard_negatives import four_russians, hard_negatives, pack_planes, subset_tables


def brute(rows, every=50, low=50, high=95):
    """rows: (vec_id, vector, label) -> sorted digest rows."""
    ok = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for at, (i, v, label) in enumerate(ok):
        if i % every:
            continue
        told = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for k, (j, w, m) in enumerate(ok)
                      if k != at and len(w) == len(v))
        for s, p, _ in [t for t in told if t[2] == label][:5]:
            fit = [t for t in told if t[2] != label and low * -s <= 100 * -t[0] <= high * -s]
            out += [(i, p, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fit[:3])]
    return sorted(out)


def table(spark, rows):
    """Extra columns have the operator's own names."""
    full = [(*r, "x", 3, 2.5) for r in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<float>, label int, uid string, planes int, "
                                       "score double").repartition(3)


def mined(spark, rows, **how):
    out = hard_negatives(table(spark, rows), **how)
    return sorted(tuple(r)[:6] for r in out.collect())


def test_scores_are_inner_products():
    rng = np.random.default_rng(4)
    for dims, top in ((1, 1), (8, 200), (13, 5000), (64, 300), (40, 1 << 28)):
        a, v = rng.integers(-top, top, (5, dims)), rng.integers(-top, top, (30, dims))
        v[0] = -top
        bits = int(max(v.max(), -v.min() - 1)).bit_length() + 1
        kind = np.int64 if top > 5000 else np.int32
        assert (four_russians(subset_tables(a, kind), pack_planes(v, bits)) == v @ a.T).all()


def random_rows(rng, n, dims=12, labels=4, hot=0.4):
    near = [[rng.gauss(0, .3) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = 0 if rng.random() < hot else rng.randrange(labels)
        v = [x + rng.gauss(0, .3) for x in near[label]]
        out.append((i, [round(x, 2) for x in v] if rng.random() < .5 else v, label))
    return out


@pytest.mark.parametrize("blocks", [(512, 8192), (2, 7)])
def test_against_brute_force(spark, blocks):
    rng = random.Random(12)
    rows = random_rows(rng, 230)
    rows += [(1000 + 50 * i, rows[3][1], 1) for i in range(3)] + [(2000 + i, rows[3][1], 2) for i in range(9)]
    want = brute([(i, [float(np.float32(x)) for x in v], m) for i, v, m in rows], every=10)
    assert len(want) > 100
    assert mined(spark, rows, every=10, anchor_block=blocks[0], row_block=blocks[1]) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 0.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [nan, 1.0], 1), (40, [inf, 1.0], 2),
           (50, [1.0, 2.0], None), (60, [], 1), (70, [], 1), (71, [], 2), (80, [0.0, 0.0], 3), (90, [0.0, 0.0], 3),
           (91, [0.0, 0.0], 4), (100, [0.5, 0.25, 1.0], 1), (101, [0.5, 0.25, 1.0], 1), (102, [0.4, 0.2, 0.7], 2),
           (110, [1.0, 1.0], 5), (110, [1.0, 1.0], 5), (111, [0.8, 0.8], 6), (111, [0.8, 0.8], 6), (112, [0.9, -0.1], 7),
           (120, [-1.0, -3.0], 8), (121, [0.1, 0.1], 8), (122, [0.2, 0.1], 9), (130, [1e30, 1.0], 1), (0, [0.6, 0.7], 5)]
    # float32 components: the fixture's values go through the same rounding
    want = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in odd
                  if i != 130], every=10)
    assert mined(spark, odd, every=10) == want and any(r[0] == 110 and r[1] == 110 for r in want)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [(51, [1.0], 1), (52, [1.0], 1), (53, [1.0], 2)]) == []
