"""LOWESS against a plain sequential implementation on small fixtures."""

import numpy as np
import pytest

from bazaar.operators.smoothing import lowess


def brute_lowess(x, y, frac, it=3):
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    n = len(x)
    k = int(frac * n + 1e-10)
    fit, rw = np.zeros(n), np.ones(n)
    for _ in range(it + 1):
        left = 0
        for i in range(n):
            while left + k < n and x[i] > (x[left] + x[left + k]) / 2.0:
                left += 1
            h = max(x[i] - x[left], x[left + k - 1] - x[i])
            xs, ys = x[left:left + k], y[left:left + k]
            d = np.abs(xs - x[i]) / h if h > 0 else np.zeros(k)
            w = np.where(d < 1, (1 - d ** 3) ** 3, 0.0) * rw[left:left + k]
            if w.sum() <= 0 or (w != 0).sum() == 1:
                fit[i] = y[i]
                continue
            w = w / w.sum()
            xb = (w * xs).sum()
            s = (w * (xs - xb) ** 2).sum()
            if s <= 1e-14 * h * h:  # all weight at one x: the mean
                fit[i] = (w * ys).sum()
                continue
            fit[i] = (w * (1 + (x[i] - xb) * (xs - xb) / s) * ys).sum()
        res = np.abs(y - fit)
        m = np.median(res)
        sr = np.where(res > 0, 1.0, 0.0) if m == 0 else np.minimum(res / (6 * m), 1.0)
        rw = (1 - sr ** 2) ** 2
    return sorted(zip(x, y, fit))


@pytest.mark.parametrize("n,frac,seed", [(40, 0.3, 1), (150, 0.1, 2), (61, 0.6, 3)])
def test_lowess_matches_brute_force(spark, n, frac, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 50, n), 0)  # many ties in x
    y = np.cos(x / 7) + rng.normal(0, 0.2, n)
    y[3] += 4.0  # an outlier for the robustness rounds
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = sorted((r.x, r.y, r.fit) for r in lowess(df, "x", "y", frac).collect())
    exp = brute_lowess(x, y, frac)
    assert len(got) == len(exp)
    assert max(abs(g[2] - e[2]) for g, e in zip(got, exp)) < 1e-9


def test_lowess_per_series_and_nulls(spark):
    rows = [(s, float(i), float((i * 7) % 5) + s) for s in (0, 1) for i in range(30)] + [(0, None, 1.0), (1, 2.0, None)]
    df = spark.createDataFrame(rows, "s int, x double, y double")
    got = lowess(df, "x", "y", 0.5, by=["s"])
    assert got.count() == 60
    for s in (0, 1):
        xs = np.array([r[1] for r in rows if r[0] == s and r[1] is not None and r[2] is not None])
        ys = np.array([r[2] for r in rows if r[0] == s and r[1] is not None and r[2] is not None])
        exp = brute_lowess(xs, ys, 0.5)
        g = sorted((r.x, r.y, r.fit) for r in got.where(f"s = {s}").collect())
        assert max(abs(a[2] - b[2]) for a, b in zip(g, exp)) < 1e-9


def test_lowess_5000_points(spark):
    rng = np.random.default_rng(5)
    n = 5000
    x = np.round(np.concatenate([rng.uniform(0, 900, n // 2), rng.normal(450, 5, n - n // 2)]), 1)
    y = np.sin(x / 60) + rng.normal(0, 0.3, n)
    y[::97] += 5.0
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    got = sorted((r.x, r.y, r.fit) for r in lowess(df, "x", "y", 0.2).collect())
    exp = brute_lowess(x, y, 0.2)
    assert max(abs(g[2] - e[2]) for g, e in zip(got, exp)) < 1e-9


def test_series_beyond_one_buffer_select_their_medians(spark, monkeypatch):
    monkeypatch.setattr("bazaar.operators.selection.BUFFERED", 0)
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 90, 700), rng.normal(0, 1, 700)
    y[::50] += 9.0
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    got = sorted((r.x, r.y, r.fit) for r in lowess(df, "x", "y", 0.3).collect())
    assert max(abs(g[2] - e[2]) for g, e in zip(got, brute_lowess(x, y, 0.3))) < 1e-9


def test_gaps_in_x_over_many_blocks(spark):
    # window starts jump at a gap: one block's windows end in many blocks, and chunks of midpoints are skipped
    rng = np.random.default_rng(9)
    x = np.round(np.concatenate([rng.uniform(0, 1, 3000), rng.uniform(500, 501, 3500), [9e4, 9e4 + 1, 9e5]]), 4)
    y = np.sin(x * 9) + rng.normal(0, 0.1, len(x))
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    got = sorted((r.x, r.y, r.fit) for r in lowess(df, "x", "y", 0.3).collect())
    assert max(abs(g[2] - e[2]) for g, e in zip(got, brute_lowess(x, y, 0.3))) < 1e-9


def test_hot_x_values_and_large_offsets(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.full(120, 1e6 + 3.0), 1e6 + np.round(rng.uniform(0, 9, 150), 0)])
    y = rng.normal(0, 1, len(x))
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    got = sorted((r.x, r.y, r.fit) for r in lowess(df, "x", "y", 0.5).collect())
    exp = brute_lowess(x, y, 0.5)
    assert max(abs(g[2] - e[2]) for g, e in zip(got, exp)) < 1e-9


def test_few_points_and_empty(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (2.0, 5.0)], [(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)]):
        got = lowess(spark.createDataFrame(rows, "x double, y double"), "x", "y", 0.5).collect()
        assert len(got) == len(rows) and all(np.isfinite(r.fit) for r in got)
