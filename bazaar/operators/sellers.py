"""Seller performance: score vs sales, order-volume buckets, shipping times.

The reference calls these three queries but does not contain their SQL; the
contracts below are ours, built from the columns its charts read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions.firsts import mark_first
from bazaar.functions.timeutil import days_between
from bazaar.session import reliable_checkpoint

TS = "order_purchase_timestamp"


def seller_review_scores_and_sales(items: DataFrame, reviews: DataFrame, min_orders: int = 0) -> DataFrame:
    """Per seller, total sales, mean review score of its orders and number
    of orders. Reviews are first reduced to one mean per order, so there is no
    items x reviews fan-out.
    -> (seller_id, total_sales, avg_review_score, num_orders)"""
    rv = reviews.groupBy("order_id").agg(F.avg("review_score").alias("order_score"))
    # the first item of each (order, seller) stands for the pair; sales need no sum per pair
    so = (mark_first(items.select("order_id", "seller_id", "price"), "order_id", "seller_id", "first")
          .join(rv, "order_id", "left"))
    g = (so.groupBy("seller_id")
         .agg(F.sum("price").cast("double").alias("total_sales"),
              F.avg(F.when(F.col("first"), F.col("order_score"))).alias("avg_review_score"),
              F.count_if("first").alias("num_orders")))
    return g.where(F.col("num_orders") >= min_orders) if min_orders else g


def bucket_labels(edges: Sequence[int]) -> list[tuple[str, int]]:
    """[(label, lowest count)] for half-open count ranges [e_i, e_{i+1}), last open."""
    e = list(edges)
    out = [(f"{a}-{b - 1}", a) for a, b in zip(e, e[1:])]
    return out + [(f"{e[-1]}+", e[-1])]


def _bucket_of(n, edges: Sequence[int]):
    expr = None
    for label, lo in reversed(bucket_labels(edges)):
        expr = F.when(n >= lo, label) if expr is None else expr.when(n >= lo, label)
    return expr


def seller_order_counts(items: DataFrame, edges: Sequence[int]) -> DataFrame:
    """(seller_id, n_orders, bucket): distinct orders per seller and its bucket."""
    n = items.select("seller_id", "order_id").distinct().groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n_orders"))
    return n.withColumn("bucket", _bucket_of(F.col("n_orders"), edges))


def sellers_per_bucket(items: DataFrame, edges: Sequence[int] = (1, 10, 100, 1000)) -> DataFrame:
    """Number of sellers per order-count bucket, every bucket listed (0 if
    empty). -> (bucket, bucket_lo, seller_count)"""
    counts = seller_order_counts(items, edges).groupBy("bucket").agg(F.count(F.lit(1)).alias("seller_count"))
    spark = items.sparkSession
    labels = spark.createDataFrame(bucket_labels(edges), "bucket string, bucket_lo bigint")
    return (labels.join(counts, "bucket", "left")
            .select("bucket", "bucket_lo", F.coalesce("seller_count", F.lit(0)).cast("bigint").alias("seller_count")))


def seller_shipping_times(shipments: DataFrame, edges: Sequence[int] = (1, 10, 100, 1000),
                          delivered: str = "order_delivered_customer_date") -> DataFrame:
    """One row per (seller, order) shipment with the seller's bucket and the
    days from purchase to delivery. -> (seller_id, order_id, bucket, delivery_time)

    ``shipments`` has one row per (seller, order) of the items; ``has_order``
    is false where the order is unknown: such rows count for the bucket only.
    They are checkpointed, so counts and rows come from one pass over the items."""
    shipments = reliable_checkpoint(shipments.select("seller_id", "order_id", "has_order", TS, delivered))
    n = shipments.groupBy("seller_id").agg(F.count(F.lit(1)).alias("n_orders"))
    sb = n.select("seller_id", _bucket_of(F.col("n_orders"), edges).alias("bucket"))
    days = days_between(TS, delivered)
    return (shipments.where("has_order").join(sb, "seller_id")
            .select("seller_id", "order_id", "bucket", days.alias("delivery_time")))
