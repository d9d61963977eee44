"""Edge cases on literal frames (FIXTURES.md §4)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaar.operators import cleaning as CL
from bazaar.operators import customers as C
from bazaar.operators import forecast as FC
from bazaar.operators import logistics as L
from bazaar.operators import orders as O
from bazaar.operators import sales as S
from bazaar.operators import sellers as SL
from bazaar.operators import shaping as SH
from bazaar.functions.timeutil import in_half_open

T = dt.datetime
ORDERS = ("order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz, "
          "order_delivered_customer_date timestamp_ntz")
CUSTOMERS = "customer_id long, customer_unique_id long, customer_city string, customer_zip_code_prefix int"
ITEMS = "order_id long, order_item_id int, product_id long, seller_id long, price decimal(18,2), freight_value decimal(18,2)"


@pytest.fixture()
def two_level(spark):
    orders = spark.createDataFrame([
        (1, 10, "delivered", T(2018, 1, 1), T(2018, 1, 5)),
        (2, 11, "delivered", T(2018, 3, 1), None),
        (3, 12, "delivered", T(2018, 2, 1), T(2018, 2, 3)),
    ], ORDERS)
    customers = spark.createDataFrame([(10, 100, "são paulo", 1), (11, 100, "são paulo", 2),
                                       (12, 200, "d'oeste", 3)], CUSTOMERS)
    items = spark.createDataFrame([(1, 1, 5, 9, Decimal("10.00"), Decimal("1.00")),
                                   (2, 1, 5, 9, Decimal("30.00"), Decimal("1.00")),
                                   (3, 1, 6, 9, Decimal("5.00"), Decimal("0.50"))], ITEMS)
    return orders, customers, items


def test_two_level_identity_rfm(spark, two_level):
    orders, customers, items = two_level
    s = {r.customer_unique_id: r for r in C.rfm_scores(orders, items, customers).collect()}
    assert s[100].total_orders == 2 and float(s[100].total_spent) == 40.0
    assert s[100].last_purchase == T(2018, 3, 1)
    assert s[100].recency == 1 and s[200].recency == 2


def test_payment_fanout_counts_order_once(spark, two_level):
    orders, customers, _ = two_level
    pays = spark.createDataFrame([(1, Decimal("5.00")), (1, Decimal("6.00")), (1, Decimal("7.00")),
                                  (3, Decimal("2.00"))], "order_id long, payment_value decimal(18,2)")
    got = {r.customer_unique_id: r for r in C.clv(customers, orders, pays).collect()}
    assert got[100].PF == 1 and got[100].AOV == 18.0 and got[100].ACL == 1.0
    assert got[100].zip_code_prefix == 1


def test_null_delivery_is_ignored(spark, two_level):
    orders, _, _ = two_level
    got = {r.purchase_date: r.avg_delivery_time
           for r in L.daily_avg_shipping_time(orders, "2018-01-01", "2018-12-31").collect()}
    assert got[dt.date(2018, 1, 1)] == 4.0 and got[dt.date(2018, 3, 1)] is None


def test_unicode_upper_and_quote_in_city(spark, two_level):
    orders, customers, _ = two_level
    got = {r.customer_city: r.city for r in O.orders_per_city(orders, customers, k=10).collect()}
    assert got == {"são paulo": "SÃO PAULO", "d'oeste": "D'OESTE"}
    one = spark.createDataFrame([("d'oeste",)], "customer_city string")
    st = orders.withColumn("order_approved_at", F.col("order_purchase_timestamp"))
    for c in ("order_delivered_carrier_date", "order_estimated_delivery_date"):
        st = st.withColumn(c, F.col("order_delivered_customer_date"))
    assert [r.city for r in L.order_stage_times(st, customers, one).collect()] == ["D'OESTE"]


def _ranked(spark, sales):
    rows = [(f"c{i}", Decimal(s)) for i, s in enumerate(sales)]
    df = spark.createDataFrame(rows, "category string, sales decimal(18,2)")
    from pyspark.sql import Window
    return df.withColumn("rank", F.rank().over(Window.orderBy(F.desc("sales"))).cast("bigint"))


def test_ties_at_the_cut_are_kept(spark):
    sales = [str(1000 - i) for i in range(17)] + ["500", "500", "400", "300"]
    got = S.category_sales_summary(_ranked(spark, sales), k=18).collect()
    names = [r.category for r in got]
    assert len(names) == 20 and names.count("Other categories") == 1
    assert [r.sales for r in got if r.category == "Other categories"] == [700.0]


def test_few_categories_other_is_null(spark):
    got = S.category_sales_summary(_ranked(spark, ["3", "2", "1"]), k=18).collect()
    assert len(got) == 4 and [r.sales for r in got if r.category == "Other categories"] == [None]


WEIGHTS = [("odd", 1.0), ("odd", 2.0), ("odd", 3.0), ("even", 1.0), ("even", 2.0), ("even", 3.0), ("even", 4.0),
           ("nulls", None), ("nulls", None), ("some", None), ("some", 5.0), ("some", 7.0), ("one", 9.0),
           (None, 1.0), (None, 2.0)]


def test_median_with_null_positions(spark):
    df = spark.createDataFrame(WEIGHTS, "category string, weight double")
    got = {r.category: r.median_weight for r in S.categories_by_median(df).collect()}
    assert got == {"odd": 2.0, "even": 2.5, "nulls": None, "some": 5.0, "one": 9.0, None: 1.5}


def test_sigma_keeps_nulls_and_single_rows(spark):
    df = spark.createDataFrame(WEIGHTS + [("odd", 2.0)] * 30 + [("odd", 1000.0)], "category string, weight double")
    kept = CL.remove_outliers_sigma(df, "weight", ["category"]).collect()
    assert not any(r.weight == 1000.0 for r in kept)
    assert sum(1 for r in kept if r.category == "nulls") == 2
    assert sum(1 for r in kept if r.category == "one") == 1
    assert sum(1 for r in kept if r.category is None) == 2


def test_iqr_drops_nulls_and_null_group(spark):
    df = spark.createDataFrame(WEIGHTS + [("odd", 100.0)], "category string, weight double")
    kept = CL.remove_outliers_iqr(df, "weight", ["category"]).collect()
    assert all(r.weight is not None and r.category is not None for r in kept)
    assert not any(r.weight == 100.0 for r in kept)
    box = {r.category: r for r in SH.box_summary(df, "weight", ["category"]).collect()}
    assert box["even"].median == 2.5 and box["even"].q1 == 1.75 and box["one"].n == 1


def test_one_point_regression_is_null(spark):
    daily = spark.createDataFrame([(dt.date(2000, 12, 5), 0, "a", 10.0)], "date date, day bigint, category string, sales double")
    coefs = FC.lm_per_category(daily).collect()
    assert coefs[0].slope is None and coefs[0].intercept is None
    f = FC.forecasted_sales(daily, "2000-12-05", "2001-12")
    assert [r.moving_avg_sales for r in f.collect()] == [None]


def test_moving_average_over_rows_not_days(spark):
    days = [1, 2, 5, 6, 30]  # gaps are not filled
    daily = spark.createDataFrame([(dt.date(2000, 12, d), d - 1, "a", float(d)) for d in days],
                                  "date date, day bigint, category string, sales double")
    got = {r.day_of_month: r.moving_avg_sales
           for r in FC.forecasted_sales(daily, "2000-12-01", "2001-12").collect()}
    # sales lie on the line day + 1, so the forecast of a day is its value a year on: 365 more
    exp = {1: (1 + 2 + 5) / 3, 2: (1 + 2 + 5 + 6) / 4, 5: 44 / 5, 6: (2 + 5 + 6 + 30) / 4, 30: 41 / 3}
    assert got.keys() == exp.keys()
    assert all(got[d] == pytest.approx(v + 365) for d, v in exp.items())


def test_end_day_is_exclusive(spark):
    df = spark.createDataFrame([(T(2018, 6, 29, 23),), (T(2018, 6, 30),), (T(2018, 6, 30, 12),)], "ts timestamp_ntz")
    assert df.where(in_half_open(F.col("ts"), "2018-06-01", "2018-06-30")).count() == 1


def test_geolocation_fanout_modes(spark):
    clv = spark.createDataFrame([(1, 7, 1, 10.0, 1.0), (2, 7, 1, 20.0, 1.0), (3, 8, 1, 5.0, 1.0)],
                                "customer_unique_id long, zip_code_prefix int, PF long, AOV double, ACL double")
    geo = spark.createDataFrame([(7, -3.0, 4.0), (7, -3.0, 2.0), (7, -1.0, 0.0)],
                                "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double")
    fan = C.avg_clv_per_zip(clv, geo).collect()
    assert len(fan) == 1 and fan[0].customer_count == 6 and fan[0].avg_CLV == 15.0
    assert (fan[0].latitude, fan[0].longitude) == (-3.0, 2.0)
    assert C.avg_clv_per_zip(clv, geo, dedupe=True).first().customer_count == 2


def test_seller_buckets_list_empty_buckets(spark):
    items = spark.createDataFrame([(o, 1, 1, s, Decimal("1.00"), Decimal("0.10"))
                                   for s, n in ((1, 3), (2, 12), (3, 1)) for o in range(n)], ITEMS)
    got = {r.bucket: r.seller_count for r in SL.sellers_per_bucket(items, (1, 10, 100)).collect()}
    assert got == {"1-9": 2, "10-99": 1, "100+": 0}


def test_empty_inputs(spark, two_level):
    orders, customers, items = two_level
    e_orders, e_items = orders.limit(0), items.limit(0)
    assert O.orders_per_day(e_orders).count() == 0
    assert O.order_price_stats(e_orders, e_items).first().min_order_price is None
    assert C.rfm_buckets(e_orders, e_items, customers, "2019-01-01").count() == 0
    assert SH.histogram(e_orders, "order_id", 0, 10, 5).count() == 0
    assert CL.remove_outliers_iqr(e_items, "price", ["seller_id"]).count() == 0


# recency tile -> segment of each frequency + monetary sum from 2 to 10
RFM_GRID = {
    1: ["Champions"] * 3 + ["Potential Loyalists"] * 2 + ["Recent Users"] * 2 + ["Price Sensitive"] * 2,
    2: ["Loyal Customers"] * 3 + ["Potential Loyalists"] * 4 + ["Promising"] * 2,
    3: ["Loyal Customers"] * 3 + ["Needs Attention"] * 2 + ["About to Sleep"] * 4,
    4: ["Can't Lose Them"] + ["Hibernating"] * 4 + ["Lost"] * 4,
    5: ["Can't Lose Them"] + ["Hibernating"] * 4 + ["Lost"] * 4,
}


def test_all_45_rfm_cells(spark):
    from bazaar.operators.customers import rfm_segment
    cells = [(r, min(5, s - 1), s - min(5, s - 1)) for r in RFM_GRID for s in range(2, 11)]
    got = spark.createDataFrame(cells, "recency int, frequency int, monetary int").withColumn("seg", rfm_segment()).collect()
    assert len(got) == 45
    assert {(r.recency, r.frequency + r.monetary): r.seg for r in got} == {
        (r, s): RFM_GRID[r][s - 2] for r in RFM_GRID for s in range(2, 11)}


def test_weekday_rows_are_in_order(spark):
    from bazaar.plans.catalog import QUERIES

    from .conftest import SF_SMALL
    got = [r.day_of_week_int for r in QUERIES["orders_by_weekday_hour"](spark, SF_SMALL).collect()]
    assert got == sorted(got) and len(got) == 7


def test_operators_do_not_round(spark):
    from bazaar.operators.customers import avg_clv_per_zip, clv
    from bazaar.operators.logistics import daily_avg_shipping_time
    from bazaar.operators.sellers import seller_review_scores_and_sales
    from bazaar.sources.roles import Roles

    from .conftest import SF_SMALL
    t = Roles(spark, SF_SMALL)
    rows = [r.avg_CLV for r in avg_clv_per_zip(clv(t.customers, t.orders, t.order_payments), t.geolocation).collect()]
    rows += [r.avg_delivery_time for r in daily_avg_shipping_time(t.deliveries, "1997-06-01", "1998-07-01").collect()
             if r.avg_delivery_time is not None]
    scores = [r.avg_review_score for r in seller_review_scores_and_sales(t.order_items, t.order_reviews).collect()]
    assert any(x != round(x, 2) for x in rows) and any(x != round(x, 4) for x in scores)
