"""The bucketed, month-partitioned layout: same results, no exchange by order, pruned months."""

import tempfile

import pytest
from pyspark.sql import functions as F

from bazaar.plans.catalog import ANALYSES, QUERIES
from bazaar.plans.params import TEST
from bazaar.sources import LaidOut, read_table, write_layout
from bazaar.sources.layout import MARK, MONTH, month_bounds
from bazaar.sources.sinks import write_dataset
from bazaar.sources.tables import TABLE_SCHEMAS, table_path
from tools.executed_plans import executed, nodes
from tools.oracle_check import bag

from .conftest import SF_SMALL
from .test_plans import explained


@pytest.fixture(scope="module")
def laid(spark):
    return LaidOut(spark, write_layout(spark, SF_SMALL, tempfile.mkdtemp(prefix="bazaar-layout-"), 4))


def rows(df):
    return bag(df.columns, [tuple(r) for r in df.collect()], 6)


@pytest.mark.parametrize("name", list(TABLE_SCHEMAS))
def test_tables_hold_the_same_rows(spark, laid, name):
    want = read_table(spark, SF_SMALL, name)
    assert rows(laid.table(name).drop(MONTH)) == rows(want)


@pytest.mark.parametrize("name", [
    "order_price_stats", "order_product_and_shipping_costs", "ranked_categories", "seller_review_scores_and_sales",
    "monthly_sales_selected_categories", "daily_sales_per_category", "daily_avg_shipping_time", "rfm_buckets", "clv"])
def test_analyses_equal_their_queries(spark, laid, name):
    want, got = QUERIES[name](spark, SF_SMALL), ANALYSES[name](laid, TEST)
    assert got.columns == want.columns and rows(got) == rows(want)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt_by_order(spark, events, run):
    """Hash exchanges by order key alone, or by order and seller."""
    plans = executed(spark, events, lambda: run().write.format("noop").mode("overwrite").save())
    return [n["simpleString"] for p in plans for n in nodes(p) if n["nodeName"] == "Exchange"
            and any(k in n["simpleString"] for k in ("orderkey", "order_id"))]


@pytest.mark.parametrize("name", ["order_price_stats", "order_product_and_shipping_costs", "ranked_categories",
                                  "seller_review_scores_and_sales"])
def test_items_and_orders_meet_without_an_exchange(spark, events, laid, no_broadcast, name):
    assert dealt_by_order(spark, events, lambda: QUERIES[name](spark, SF_SMALL))  # the check sees a plain join's
    assert dealt_by_order(spark, events, lambda: ANALYSES[name](laid, TEST)) == []


@pytest.mark.parametrize("name", ["monthly_sales_selected_categories", "daily_sales_per_category",
                                  "daily_avg_shipping_time"])
def test_months_are_pruned(laid, name):
    text = explained(ANALYSES[name](laid, TEST))
    assert f"PartitionFilters: [isnotnull({MONTH}" in text and f"({MONTH}#" in text and ">= " in text


def test_only_the_folders_of_a_range_are_read(laid):
    files = laid.orders_between("1996-02-10", "1996-04-01").inputFiles()
    assert files and {f.split(f"{MONTH}=")[1][:6] for f in files} <= {"199602", "199603"}


def test_month_bounds():
    assert month_bounds("1996-02-10", "1996-04-01") == (199602, 199603)
    assert month_bounds("1996-12-31 23:59:59", "1997-01-01 00:00:01") == (199612, 199701)
    assert month_bounds(None, "1996-01-01") == (None, 199512) and month_bounds("1996-01-01", None) == (199601, None)


def test_missing_times_empty_tables_and_another_session(spark):
    base, out = (tempfile.mkdtemp(prefix="bazaar-layout-") for _ in range(2))
    for name in TABLE_SCHEMAS:
        df = read_table(spark, SF_SMALL, name)
        if name == "orders":
            late = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))
            df = df.withColumn("o_orderdate", late).withColumn("o_orderkey", F.nullif(F.col("o_orderkey") % 50, F.lit(7)))
        write_dataset(df.limit(0) if name == "lineitem" else df, table_path(base, name))
    write_layout(spark, base, out, 3)
    other = spark.newSession()
    for _ in range(2):  # registering again changes nothing
        t = LaidOut(other, out)
        assert rows(t.table("orders").drop(MONTH)) == rows(read_table(spark, base, "orders"))
    assert t.table("lineitem").count() == 0
    got = t.orders_between("1990-01-01", None)
    assert got.count() == t.orders.where("order_purchase_timestamp IS NOT NULL").count() > 0


def test_an_unfinished_layout_is_refused(spark):
    out = tempfile.mkdtemp(prefix="bazaar-layout-")
    write_dataset(spark.createDataFrame([], "buckets int"), table_path(out, MARK))
    with pytest.raises(ValueError, match="not written to its end"):
        LaidOut(spark, out)
