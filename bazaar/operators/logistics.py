"""Delivery stage times per city and daily shipping time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions.timeutil import US_PER_DAY, in_half_open, micros_between

TS = "order_purchase_timestamp"

# (output column, from timestamp, to timestamp): the order stages, in order
STAGES = [
    ("approved", TS, "order_approved_at"),
    ("delivered_to_carrier", "order_approved_at", "order_delivered_carrier_date"),
    ("delivered_to_customer", "order_delivered_carrier_date", "order_delivered_customer_date"),
    ("estimated_delivery", "order_delivered_customer_date", "order_estimated_delivery_date"),
]


def mean_days(start: str, end: str):
    """Mean of (end - start) in fractional days over rows where both are set."""
    return F.avg(micros_between(F.col(start), F.col(end))) / F.lit(float(US_PER_DAY))


def order_stage_times(orders: DataFrame, customers: DataFrame | None = None, cities: DataFrame | None = None,
                      top_k: int | None = None, key: str = "order_id") -> DataFrame:
    """Per city, mean days of each order stage; rows ordered by the sum of
    the first three stages, longest first (NULL last).
    -> (city, approved, delivered_to_carrier, delivered_to_customer, estimated_delivery)

    ``top_k`` keeps the cities with the most rows that have a ``key`` (as O04),
    counted in the same aggregation: one pass. ``cities`` restricts the
    cities to a given list instead, through a left-semi join.
    """
    src = orders
    if customers is not None:
        src = src.join(customers.select("customer_id", "customer_city"), "customer_id")
    if cities is not None:
        src = src.join(cities.select("customer_city"), "customer_city", "left_semi")
    g = src.groupBy("customer_city").agg(F.count(key).alias("_n"), *[mean_days(a, b).alias(n) for n, a, b in STAGES])
    if top_k is not None:
        g = g.orderBy(F.desc("_n"), F.asc_nulls_first("customer_city")).limit(top_k)
    total = F.col("approved") + F.col("delivered_to_carrier") + F.col("delivered_to_customer")
    return (g.orderBy(total.desc_nulls_last(), F.asc_nulls_first("customer_city"))
            .select(F.upper(F.col("customer_city").cast("string")).alias("city"),
                    *[n for n, _, _ in STAGES]))


def daily_avg_shipping_time(orders: DataFrame, start: str | None, end: str | None,
                            delivered: str = "order_delivered_customer_date") -> DataFrame:
    """Per purchase day in [start, end), mean days from purchase to delivery
    (undelivered orders ignored; a day with none gives NULL).
    -> (purchase_date, avg_delivery_time)"""
    return (orders.where(in_half_open(F.col(TS), start, end))
            .groupBy(F.to_date(TS).alias("purchase_date"))
            .agg(mean_days(TS, delivered).alias("avg_delivery_time")))


def overall_mean_line(daily: DataFrame, value: str = "avg_delivery_time") -> DataFrame:
    """Each row plus the mean of the daily values (days weigh equally),
    as a scalar subquery computed once."""
    mean = daily.select(F.avg(value)).scalar()
    return daily.withColumn("overall_mean", mean)
