"""The analyses run unchanged on tables of the original e-commerce schema."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from bazaar.operators.logistics import daily_avg_shipping_time
from bazaar.operators.sellers import seller_shipping_times
from bazaar.plans.catalog import ANALYSES, analyses
from bazaar.plans.params import REFERENCE, TEST
from bazaar.sources.commerce import TS_COLUMNS, CommerceTables
from bazaar.sources.roles import Roles

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def commerce_dir(spark):
    """The test roles written out under the original table names; purchase
    times stored as text, to exercise the parsing."""
    r = Roles(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="bazaar-commerce-")
    late = F.col("order_purchase_timestamp") + F.expr("INTERVAL 5 DAYS")
    orders = (r.orders.withColumn("order_approved_at", F.col("order_purchase_timestamp") + F.expr("INTERVAL 1 HOUR"))
              .withColumn("order_delivered_carrier_date", late).withColumn("order_delivered_customer_date", late)
              .withColumn("order_estimated_delivery_date", late)
              .withColumn("order_purchase_timestamp", F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")))
    tables = {"orders": orders, "order_items": r.order_items, "customers": r.customers, "products": r.products,
              "product_category_name_translation": r.translation, "order_reviews": r.order_reviews,
              "order_payments": r.order_payments, "geolocation": r.geolocation, "leads": r.leads,
              "closed_deals": r.deals}
    for name, df in tables.items():
        df.write.parquet(os.path.join(d, name))
    return d


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["ranked_categories", "categories_by_median", "rfm_buckets", "clv",
                                  "avg_clv_per_zip", "lead_conversion", "monthly_sales_selected_categories"])
def test_same_answers_as_the_role_views(spark, commerce_dir, name):
    got = ANALYSES[name](CommerceTables(spark, commerce_dir), TEST)
    exp = ANALYSES[name](Roles(spark, SF_SMALL), TEST)
    assert _rows(got) == _rows(exp)


def test_every_analysis_runs_with_reference_parameters(spark, commerce_dir):
    for name, build in analyses(CommerceTables(spark, commerce_dir), REFERENCE).items():
        build().write.format("noop").mode("overwrite").save()


ORDERS = ("order_id string, customer_id string, order_status string, order_purchase_timestamp {t}, order_approved_at {t}, "
          "order_delivered_carrier_date {t}, order_delivered_customer_date {t}, order_estimated_delivery_date {t}")


def _three_orders(spark, kind, cast):
    """Bought on one day: delivered after 10 days (two sellers), 2 days (one seller), 20 days (no items)."""
    d = tempfile.mkdtemp(prefix="bazaar-three-")
    rows = [(i, "c", "delivered", "2018-01-01 00:00:00", None, None, f"2018-01-{1 + n:02d} 00:00:00", None)
            for i, n in (("a", 10), ("b", 2), ("c", 20))]
    orders = spark.createDataFrame(rows, ORDERS.format(t="string"))
    for c in TS_COLUMNS:
        orders = orders.withColumn(c, F.col(c).cast(cast))
    orders.write.parquet(os.path.join(d, "orders"))
    spark.createDataFrame([("a", 1, "p", "s1", 1.0, 0.0), ("a", 2, "p", "s2", 1.0, 0.0), ("b", 1, "p", "s1", 1.0, 0.0)],
                          "order_id string, order_item_id int, product_id string, seller_id string, price double, "
                          "freight_value double").write.parquet(os.path.join(d, "order_items"))
    return CommerceTables(spark, d)


@pytest.mark.parametrize("cast", ["string", "timestamp_ntz"])
def test_daily_shipping_time_counts_every_order_once(spark, cast):
    t = _three_orders(spark, cast, cast)
    got = daily_avg_shipping_time(t.deliveries, "2017-06-01", "2018-06-30").collect()
    assert [round(r.avg_delivery_time, 4) for r in got] == [10.6667]
    assert len(str(got[0].avg_delivery_time)) > 10  # not rounded
    assert sorted(r.delivery_time for r in seller_shipping_times(t.shipments).collect()) == [2.0, 10.0, 10.0]


def test_range_filter_reaches_the_scan(spark):
    t = _three_orders(spark, "timestamp_ntz", "timestamp_ntz")
    df = daily_avg_shipping_time(t.deliveries, "2017-06-01", "2018-06-30")
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(order_purchase_timestamp,2017-06-01T00:00)" in text


def test_wrong_tables_fail_and_bad_times_are_counted(spark):
    d = tempfile.mkdtemp(prefix="bazaar-wrong-")
    spark.createDataFrame([("a",)], "order_id string").write.parquet(os.path.join(d, "orders"))
    spark.createDataFrame([("a", True)], "order_id string, review_score boolean").write.parquet(
        os.path.join(d, "order_reviews"))
    t = CommerceTables(spark, d)
    with pytest.raises(ValueError, match="customer_id is missing"):
        t.orders
    with pytest.raises(ValueError, match="review_score is boolean"):
        t.order_reviews
    three = _three_orders(spark, "string", "string")
    three.table("orders").withColumn("order_approved_at", F.lit("soon")).write.parquet(os.path.join(d, "bad", "orders"))
    row = CommerceTables(spark, os.path.join(d, "bad")).unparsed_times().first()
    assert row.orders == 3 and row.order_approved_at == 3 and row.order_purchase_timestamp == 0
