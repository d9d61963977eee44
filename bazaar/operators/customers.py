"""RFM segments, customer lifetime value and its per-area mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions.timeutil import days_between, ts_lit
from bazaar.operators.selection import counted_checkpoint, tile_cuts, tile_number

TS = "order_purchase_timestamp"
CUID = "customer_unique_id"

# RFM segment rules, in the reference's order. Each rule is
# (segment, recency tiles, lowest and highest frequency + monetary tile sum).
RFM_RULES = [
    ("Champions", (1,), 1, 4),
    ("Can't Lose Them", (4, 5), 1, 2),
    ("Hibernating", (4, 5), 3, 6),
    ("Lost", (4, 5), 7, 10),
    ("Loyal Customers", (2, 3), 1, 4),
    ("Needs Attention", (3,), 5, 6),
    ("Recent Users", (1,), 7, 8),
    ("Potential Loyalists", (1,), 5, 6),
    ("Potential Loyalists", (2,), 5, 8),
    ("Price Sensitive", (1,), 9, 10),
    ("Promising", (2,), 9, 10),
    ("About to Sleep", (3,), 7, 10),
]


def rfm_segment(recency: str = "recency", frequency: str = "frequency", monetary: str = "monetary"):
    """The segment of a customer from its three quintiles (1 = best)."""
    s = F.col(frequency) + F.col(monetary)
    expr = None
    for name, rs, lo, hi in RFM_RULES:
        cond = F.col(recency).isin(list(rs)) & s.between(lo, hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def rfm_scores(orders: DataFrame, items: DataFrame, customers: DataFrame,
               status: str | None = "delivered", tiles: int = 5) -> DataFrame:
    """Per person: last purchase, order count, spend and their quintiles.

    Recency and frequency are tiled over all customers with an order of
    ``status``; monetary over those with items, and customers without items
    are left out (as the reference's join did). Ties are broken by the person
    key. The last (value, key) of each tile is found by selection
    (``tile_cuts``), and a row's tile by comparing it with these few rows:
    nothing is sorted, numbered or joined per score.
    """
    o = orders if status is None else orders.where(F.col("order_status") == status)
    o = o.select("order_id", "customer_id", TS).join(customers.select("customer_id", CUID), "customer_id")
    paid = items.groupBy("order_id").agg(F.sum("price").alias("paid"), F.lit(True).alias("_sold"))
    # one pass: all three scores come from one row per person
    rf, n = counted_checkpoint(o.join(paid, "order_id", "left").groupBy(CUID).agg(
        F.max(TS).alias("last_purchase"), F.count("order_id").alias("total_orders"),
        F.sum("paid").alias("total_spent"), F.coalesce(F.max("_sold"), F.lit(False)).alias("_sold")),
        every=F.count(F.lit(1)), sold=F.count_if("_sold"))
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("last_purchase"))

    def highest_first(value, where=F.lit(True)):
        return F.struct(value.isNull().alias("none"), (-value).alias("value"), F.col(CUID).alias("key")), where

    scores = {"recency": highest_first(since), "frequency": highest_first(F.col("total_orders")),
              "monetary": highest_first(F.col("total_spent"), F.col("_sold"))}
    sizes = {"recency": n["every"], "frequency": n["every"], "monetary": n["sold"]}
    cuts = tile_cuts(rf, tiles, scores, F.col(CUID), sizes)
    return rf.where("_sold").select(CUID, "last_purchase", "total_orders", "total_spent",
                                    *[tile_number(rf, scores[s], cuts[s]).alias(s) for s in scores])


def rfm_buckets(orders: DataFrame, items: DataFrame, customers: DataFrame, as_of,
                status: str | None = "delivered") -> DataFrame:
    """Per RFM segment, mean days from last purchase to ``as_of`` (a
    'YYYY-MM-DD' string or a TIMESTAMP_NTZ column), mean spend per order and
    number of customers.
    -> (RFM_Bucket, avg_days_since_purchase, avg_sales_per_customer, customer_count)"""
    s = rfm_scores(orders, items, customers, status)
    now = ts_lit(as_of) if isinstance(as_of, str) else as_of
    days = days_between("last_purchase", now)
    return (s.withColumn("RFM_Bucket", rfm_segment())
            .groupBy("RFM_Bucket")
            .agg(F.avg(days).alias("avg_days_since_purchase"),
                 F.avg(F.col("total_spent").cast("double") / F.col("total_orders"))
                 .alias("avg_sales_per_customer"),
                 F.count(F.lit(1)).alias("customer_count")))


def clv(customers: DataFrame, orders: DataFrame, payments: DataFrame, digits: int | None = None) -> DataFrame:
    """Per person PF (orders with a payment), AOV (payments / PF), ACL
    (active weeks; 1 below 7 days) and the area of the latest order.
    -> (customer_unique_id, zip_code_prefix, PF, AOV, ACL)

    Payments are summed per order before the join (an order with n payments
    must count once in PF, and the join then stays 1:1), so no COUNT DISTINCT.
    """
    pay = payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    j = (customers.select("customer_id", CUID, "customer_zip_code_prefix")
         .join(orders.select("order_id", "customer_id", TS), "customer_id").join(pay, "order_id"))
    g = j.groupBy(CUID).agg(
        F.max_by("customer_zip_code_prefix", F.struct(TS, "order_id")).alias("zip_code_prefix"),
        F.count(F.lit(1)).alias("PF"), F.sum("paid").alias("total_payment"),
        F.min(TS).alias("first_order"), F.max(TS).alias("last_order"))
    span = days_between("first_order", "last_order")
    aov = F.col("total_payment").cast("double") / F.col("PF")
    acl = F.when(span < 7, F.lit(1.0)).otherwise(span / 7)
    if digits is not None:
        aov, acl = F.round(aov, digits), F.round(acl, digits)
    return g.select(CUID, "zip_code_prefix", "PF", aov.alias("AOV"), acl.alias("ACL"))


def avg_clv_per_zip(clv_df: DataFrame, geolocation: DataFrame, dedupe: bool = False,
                    digits: int | None = None) -> DataFrame:
    """Per area, mean CLV (PF x AOV x ACL), customers and one location.
    -> (zip_prefix, avg_CLV, customer_count, latitude, longitude)

    Both sides are reduced to one row per area before the join. The reference
    joined customers to every geolocation row of their area, which multiplies
    ``customer_count`` by the area's geolocation rows and leaves the mean
    unchanged: that is the default; ``dedupe=True`` counts each customer once.
    The location is the smallest (lat, lng) of the area; areas without
    geolocation drop out.
    """
    per_zip = (clv_df.groupBy(F.col("zip_code_prefix").alias("zip_prefix"))
               .agg(F.sum((F.col("PF") * F.col("AOV")) * F.col("ACL")).alias("clv_sum"),
                    F.count(CUID).alias("n")))
    geo = (geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias("zip_prefix"))
           .agg(F.count(F.lit(1)).alias("g"),
                F.min(F.struct(F.col("geolocation_lat").alias("lat"), F.col("geolocation_lng").alias("lng")))
                .alias("loc")))
    j = per_zip.join(geo, "zip_prefix")
    avg = F.try_divide(F.col("clv_sum"), F.col("n"))
    if digits is not None:
        avg = F.round(avg, digits)
    count = F.col("n") if dedupe else F.col("n") * F.col("g")
    return j.select("zip_prefix", avg.alias("avg_CLV"), count.alias("customer_count"),
                    F.col("loc.lat").alias("latitude"), F.col("loc.lng").alias("longitude"))
