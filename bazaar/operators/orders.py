"""Order volume, calendar heatmap, city ranking and basket costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions.numeric import r2
from bazaar.functions.timeutil import weekday_abbrev, weekday_sun0

TS = "order_purchase_timestamp"


def orders_per_day(orders: DataFrame, ts: str = TS) -> DataFrame:
    """Number of orders per calendar day -> (day, order_count)."""
    return orders.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("order_count"))


def order_day_hour(orders: DataFrame, ts: str = TS) -> DataFrame:
    """One row per order -> (day_of_week_name, day_of_week_int [Sun=0], hour)."""
    c = F.col(ts)
    return orders.select(weekday_abbrev(c).alias("day_of_week_name"),
                         weekday_sun0(c).cast("bigint").alias("day_of_week_int"),
                         F.hour(c).cast("bigint").alias("hour"))


HOURS = [str(h) for h in range(24)]


def orders_by_weekday_hour(orders: DataFrame, ts: str = TS) -> DataFrame:
    """7 x 24 order-count matrix; one row per weekday seen, from Sunday
    on, columns "0".."23".

    Pivot with an explicit value list: the counts are pre-aggregated on
    (weekday, hour) map-side, so only <= 168 rows per partition are shuffled.
    """
    dh = order_day_hour(orders, ts).withColumn("hour", F.col("hour").cast("string"))
    wide = (dh.groupBy("day_of_week_int", "day_of_week_name")
            .pivot("hour", HOURS).agg(F.count(F.lit(1))))
    return (wide.na.fill(0, subset=HOURS)
            .select("day_of_week_name", "day_of_week_int", *[F.col(h).cast("bigint").alias(h) for h in HOURS])
            .orderBy("day_of_week_int"))


def orders_per_city(orders: DataFrame, customers: DataFrame | None = None, k: int = 10,
                    city: str = "customer_city", key: str = "order_id") -> DataFrame:
    """Top-k cities by order count -> (customer_city, city, city_order_count).

    With ``customers`` the orders are joined on customer_id; without, ``orders``
    must carry the city column. Ties on the count are broken by city name so
    the cut at k is deterministic. ``orderBy().limit()`` plans as a
    TakeOrderedAndProject: each partition keeps its own top k, one task merges
    at most k x partitions rows.
    """
    src = orders.join(customers, "customer_id") if customers is not None else orders
    counts = src.groupBy(F.col(city).alias("customer_city")).agg(F.count(key).alias("city_order_count"))
    return (counts.select("customer_city", F.upper(F.col("customer_city").cast("string")).alias("city"),
                          "city_order_count")
            .orderBy(F.desc("city_order_count"), F.asc_nulls_first("customer_city")).limit(k))


def orders_per_city_reversed(top: DataFrame) -> DataFrame:
    """The O04 rows in ascending order of count."""
    return top.orderBy(F.asc("city_order_count"), F.desc_nulls_last("customer_city"))


def top_cities(top: DataFrame) -> DataFrame:
    """The city keys of O04, as a DataFrame for semi-joins."""
    return top.select("customer_city")


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """(order_id, order_price = sum(price + freight_value)) per order, exact decimal."""
    return (orders.select("order_id").join(items, "order_id")
            .groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("order_price")))


def order_price_stats(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Min / mean (2 dp) / max of the order total. Two-level aggregate:
    per-order sums (shuffle on order_id), then one global partial+final aggregate."""
    t = order_totals(orders, items)
    return t.agg(F.min("order_price").cast("double").alias("min_order_price"),
                 r2(F.avg("order_price")).alias("avg_order_price"),
                 F.max("order_price").cast("double").alias("max_order_price"))


def order_product_and_shipping_costs(orders: DataFrame, items: DataFrame,
                                     status: str | None = "delivered") -> DataFrame:
    """Per order of the given status, sum(price) and sum(freight_value)."""
    o = orders if status is None else orders.where(F.col("order_status") == status)
    return (o.select("order_id").join(items, "order_id").groupBy("order_id")
            .agg(F.sum("price").cast("double").alias("product_cost"),
                 F.sum("freight_value").cast("double").alias("shipping_cost")))
