"""Selected order statistics against sorts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaar.operators import cleaning, sales, selection
from bazaar.operators.selection import selected_quantiles, tile_cuts, tile_number


def rows_of(rng):
    out = [("hot", round(rng.gauss(50, 9), 3)) for _ in range(30_000)] + [("hot", 55.5)] * 9_000
    out += [("far", rng.choice([1.0, 2.0, 1e9]) * rng.random()) for _ in range(2_000)]
    out += [("few", x) for x in (0.0, 10.0)] + [("one", 4.0), ("none", None), (None, 3.0), (None, 9.0), (None, 4.0)]
    return out


def quantile(xs, q):
    h = (len(xs) - 1) * q
    lo = int(h)
    return xs[lo] + (h - lo) * (xs[min(lo + 1, len(xs) - 1)] - xs[lo])


def test_quantiles_of_groups(spark):
    rows = rows_of(random.Random(1))
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for largest in (None, 50_000):  # selected, and from one bounded buffer
        got = {r.g: (r.a, r.b) for r in selected_quantiles(df, "v", ["g"], {"a": 0.5, "b": 0.93}, 6, largest).collect()}
        for g in {r[0] for r in rows}:
            xs = sorted(v for h, v in rows if h == g and v is not None)
            assert (g in got) == bool(xs)
            if xs:
                assert got[g] == pytest.approx((quantile(xs, .5), quantile(xs, .93)), rel=1e-12)


@pytest.mark.parametrize("passes", [1, 2])
def test_fences_of_several_passes(spark, passes):
    rows = rows_of(random.Random(2))
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = {}
    for g in {r[0] for r in rows}:
        xs = sorted(v for h, v in rows if h == g and v is not None)
        for _ in range(passes):
            if xs:
                q1, q3 = quantile(xs, .25), quantile(xs, .75)
                xs = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
        want[g] = xs
    got = {}
    for r in cleaning.remove_outliers_iqr(df, "v", ["g"], 1.5, passes).collect():
        got.setdefault(r.g, []).append(r.v)
    assert {g: sorted(v) for g, v in got.items()} == {g: x for g, x in want.items() if x and g is not None}
    boxes = {r.g: tuple(r)[1:] for r in cleaning.iqr_box_summary(df, "v", ["g"], 1.5, passes).collect()}
    for g, xs in want.items():
        if xs:
            assert boxes[g] == pytest.approx((xs[0], quantile(xs, .25), quantile(xs, .5), quantile(xs, .75), xs[-1],
                                              len(xs)), rel=1e-12)


@pytest.mark.parametrize("sample,fetch", [(10_000, 50_000), (1_000, 1_500)])
def test_tiles_of_any_size(spark, monkeypatch, sample, fetch):
    monkeypatch.setattr(selection, "SAMPLE", sample)
    monkeypatch.setattr(selection, "FETCH", fetch)
    df = spark.range(0, 20_000, 1, 5).select(
        F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 1000).alias("a"),
        F.when(F.col("id") % 50 > 0, F.col("id") % 11).alias("b"), (F.col("id") % 4 == 0).alias("some"))
    orders = {"a": (F.struct(-F.col("a"), F.col("k")), F.lit(True)),
              "b": (F.struct(F.col("b").isNull(), F.col("b"), F.col("k")), F.col("some"))}
    cuts = tile_cuts(df, 5, orders, F.col("k"), {"a": 20_000, "b": 5_000})
    out = df.select("*", tile_number(df, orders["a"], cuts["a"]).alias("ta"), tile_number(df, orders["b"], cuts["b"]).alias("tb"))
    out = out.withColumn("wa", F.ntile(5).over(Window.orderBy(F.desc("a"), "k")))
    out = out.withColumn("wb", F.ntile(5).over(Window.partitionBy("some").orderBy(F.asc_nulls_last("b"), "k")))
    assert out.where("ta != wa OR (some AND tb != wb)").count() == 0


@pytest.mark.parametrize("n", [0, 3, 7])
def test_fewer_rows_than_tiles(spark, n):
    df = spark.range(n)
    order = {"t": (F.struct(F.col("id")), F.lit(True))}
    cuts = tile_cuts(df, 5, order, F.col("id"), {"t": n})["t"]
    got = [r.t for r in df.select("id", tile_number(df, order["t"], cuts).alias("t")).orderBy("id").collect()]
    assert got == [r.t for r in df.select("id", F.ntile(5).over(Window.orderBy("id")).alias("t")).orderBy("id").collect()]


def test_numbers_of_a_hot_category_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sales, "NUMBERS", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = spark.createDataFrame([("hot", 5.0, 5000), ("hot", None, 7), ("hot", 1.0, 900), ("b", 2.0, 3)],
                                       "category string, weight double, items bigint")
        got = sales.numbered_weights(counts).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot = sorted((r.category_row_n, r.weight) for r in got if r.category == "hot")
    assert hot == list(zip(range(1, 5908), [None] * 7 + [1.0] * 900 + [5.0] * 5000))
    assert {r.category_count for r in got if r.category == "hot"} == {5907} and len(got) == 5910
    assert len({r.part for r in got if r.weight == 5.0}) > 4
