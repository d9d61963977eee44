"""Plan properties of the registered queries, over the final plans of all the
jobs they run (eager checkpoint jobs included)."""

import pytest
from pyspark.sql import functions as F

from bazaar.operators import cleaning, ranking
from bazaar.operators.ranking import global_ntile
from bazaar.plans.catalog import QUERIES
from tools.executed_plans import count, executed, nodes, scans, windows_over_one_partition

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def ran(spark, events):
    """Executed plans of a query, run once."""
    seen = {}

    def plans(name):
        if name not in seen:
            seen[name] = executed(spark, events, lambda: QUERIES[name](spark, SF_SMALL).write.format("noop")
                                  .mode("overwrite").save())
        return seen[name]
    return plans


def explained(df):
    """The formatted explain text (full filter lists, one node per section)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["ranked_categories", "rfm_buckets", "ordered_categories", "remove_outliers_iqr",
                                  "explicit_order", "seller_shipping_times", "forecasted_sales", "clv"])
def test_no_python(ran, name):
    assert ran(name) and not any(word in n["nodeName"] for p in ran(name) for n in nodes(p)
                                 for word in ("Python", "Pandas", "Arrow"))


def test_eager_jobs_are_seen(ran):
    # LOWESS numbers its points: a range-partitioned checkpoint among its jobs
    assert len(ran("lowess")) > 4 and count(ran("lowess"), "rangepartitioning") >= 1


def test_tiles_fences_and_numbers_sort_nothing(ran):
    for name, most in (("rfm_buckets", 3), ("remove_outliers_iqr", 4), ("ordered_categories", 1),
                       ("remove_outliers_sigma", 4)):
        assert count(ran(name), "rangepartitioning") == 0 and len(ran(name)) <= most, (name, len(ran(name)))


@pytest.mark.parametrize("name", ["rfm_buckets", "lowess"])
def test_no_window_over_one_partition(ran, name):
    assert windows_over_one_partition(ran(name)) == 0


def test_the_check_sees_a_naive_ntile(spark, events):
    from pyspark.sql import Window
    x = spark.range(100).withColumn("t", F.ntile(5).over(Window.orderBy("id")))
    plans = executed(spark, events, lambda: x.write.format("noop").mode("overwrite").save())
    assert windows_over_one_partition(plans) == 1


@pytest.mark.parametrize("name,tables", [
    ("forecasted_sales", ("orders", "lineitem")), ("order_stage_times", ("events",)),
    ("seller_review_scores_and_sales", ("lineitem", "orders")), ("seller_shipping_times", ("lineitem", "orders")),
    ("remove_outliers_iqr", ("lineitem", "orders")), ("rfm_buckets", ("lineitem",))])
def test_big_tables_are_read_once(ran, name, tables):
    for t in tables:
        assert scans(ran(name), t) == 1, t


def test_boxes_read_the_items_twice(ran):
    # once to rank the categories, once for their weights
    assert scans(ran("explicit_order"), "lineitem") == 2


def test_sellers_shuffle_the_items_once(ran):
    big = [n for p in ran("seller_review_scores_and_sales") for n in nodes(p)
           if n["nodeName"] == "Exchange" and "l_orderkey" in n["simpleString"]]
    assert len(big) <= 1


def test_status_and_date_filters_reach_the_scan(spark):
    def text(name):
        return explained(QUERIES[name](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in text("ranked_categories")
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00)" in text("daily_sales_per_category")
    assert "LessThan(o_orderdate,2001-08-01T00:00)" in text("daily_sales_per_category")
    assert "GreaterThanOrEqual(o_orderdate,1997-06-01T00:00)" in text("daily_avg_shipping_time")


def test_projection_is_pruned(spark):
    # a two-column use of lineitem reads only those columns
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_tax:double>" in \
        explained(QUERIES["order_product_and_shipping_costs"](spark, SF_SMALL))


def test_global_ntile_has_no_single_partition_exchange(spark):
    x = spark.range(5000).withColumn("v", F.col("id") % 17)
    assert "SinglePartition" not in explained(global_ntile(x, 5, [F.desc("v")], "t", tiebreak=["id"]))


@pytest.mark.parametrize("most", [100_000, 0])  # broadcast bounds, salted join
@pytest.mark.parametrize("drop", [cleaning.remove_outliers_sigma, cleaning.remove_outliers_iqr])
def test_a_hot_group_stays_spread(spark, monkeypatch, most, drop):
    x = spark.range(0, 8000, 1, 8).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        ((F.col("id") * 7919) % 1000).alias("v"), "id")
    want = {r.id for r in drop(x, "v", ["g"]).collect()}
    monkeypatch.setattr(ranking, "MAX_BROADCAST_GROUPS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = drop(x, "v", ["g"]).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.id for r in got} == want and len(got) == len(want)
    sizes = [sum(r.part == p for r in got) for p in {r.part for r in got}]
    assert max(sizes) < .4 * len(got)
