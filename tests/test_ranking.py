"""Distributed numbering, tiles and quantiles against Spark's own window functions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaar.operators.ranking import global_ntile, global_row_number, group_quantiles, row_quantiles


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 7, 23, 1003])
def test_ntile_small_and_remainders(spark, n):
    x = spark.range(n).withColumn("v", (F.col("id") * 37) % 11)
    got = {r.id: r.t for r in global_ntile(x, 5, [F.desc("v")], "t", tiebreak=["id"]).collect()}
    exp = {r.id: r.t for r in x.withColumn("t", F.ntile(5).over(Window.orderBy(F.desc("v"), "id"))).collect()}
    assert got == exp


@pytest.mark.parametrize("parts", [1, 13])
def test_row_number_partitioned_invariant_to_input_partitioning(spark, parts):
    x = spark.range(2000).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 7) % 50).alias("v"))
    x = x.repartition(parts)
    got = {r.id: r.rn for r in global_row_number(x, [F.asc("v")], ["g"], out="rn", tiebreak=["id"]).collect()}
    exp = {r.id: r.rn for r in x.withColumn("rn", F.row_number().over(
        Window.partitionBy("g").orderBy("v", "id"))).collect()}
    assert got == exp


def test_hot_group_is_spread(spark):
    # one group holds 90% of rows: the numbering still splits it over partitions
    x = spark.range(4000).select("id", F.when(F.col("id") < 3600, 0).otherwise(F.col("id") % 5 + 1).alias("g"))
    n = global_row_number(x, [F.asc("id")], ["g"], out="rn")
    per_part = n.where("g = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_part) > 1
    assert n.where("g = 0").agg(F.max("rn")).first()[0] == 3600


def test_quantiles_match_percentile(spark):
    x = spark.range(1000).select((F.col("id") % 4).alias("g"), ((F.col("id") * 13) % 97).cast("double").alias("v"))
    x = x.union(spark.createDataFrame([(9, None), (9, 2.0)], "g long, v double"))
    got = {r.g: (r.q1, r.median, r.q3, r.min, r.max, r.n) for r in group_quantiles(
        x, "v", ["g"], [0.25, 0.5, 0.75], names=["q1", "median", "q3"], with_min_max_count=True).collect()}
    exp = {r.g: (*r.p, r.mn, r.mx, r.n) for r in x.groupBy("g").agg(
        F.percentile("v", [0.25, 0.5, 0.75]).alias("p"), F.min("v").alias("mn"), F.max("v").alias("mx"),
        F.count("v").alias("n")).collect()}
    assert got.keys() == exp.keys()
    for g in got:
        assert got[g] == pytest.approx(exp[g], abs=1e-12)


def test_row_quantiles_match_percentile(spark):
    x = spark.range(999).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 29) % 83).cast("double").alias("v"))
    got = {r.g: (r.a, r.b) for r in row_quantiles(x, "v", ["g"], [0.5, 0.9], ["a", "b"], tiebreak=["id"]).collect()}
    exp = {r.g: tuple(r.p) for r in x.groupBy("g").agg(F.percentile("v", [0.5, 0.9]).alias("p")).collect()}
    assert got.keys() == exp.keys()
    for g in got:
        assert got[g] == pytest.approx(exp[g], abs=1e-12)


def test_quantiles_of_one_hot_value(spark):
    # a third of the rows share one value: the histogram holds it as one row
    x = spark.range(3000).select((F.col("id") % 2).alias("g"),
                                 F.when(F.col("id") < 1000, 7.0).otherwise(F.col("id") % 50).cast("double").alias("v"))
    got = {r.g: (r.q1, r.q2) for r in group_quantiles(x, "v", ["g"], [0.1, 0.6], ["q1", "q2"]).collect()}
    exp = {r.g: tuple(r.p) for r in x.groupBy("g").agg(F.percentile("v", [0.1, 0.6]).alias("p")).collect()}
    assert got.keys() == exp.keys()
    assert all(got[g] == pytest.approx(exp[g], abs=1e-12) for g in exp)
