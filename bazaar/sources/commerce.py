"""Tables of the original e-commerce schema, read from Parquet.

``CommerceTables`` offers the same roles as ``Roles`` (which maps the test
tables), so every analysis of ``bazaar.plans.catalog`` runs unchanged on an
export of the original database: ``analyses(CommerceTables(spark, dir), REFERENCE)``.
Every table is checked for its required columns and their types. Timestamps
stored as text are parsed (NULL when they do not parse; ``unparsed_times`` counts
those), money is DECIMAL(18,2), weights and coordinates DOUBLE.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.numeric import MONEY
from bazaar.sources.roles import TableSet

# Required columns of each table with their declared types ("time": TIMESTAMP_NTZ,
# TIMESTAMP, DATE or text that is parsed; "key": any type; "number": numeric or text of numbers).
SCHEMAS = {
    "orders": {"order_id": "key", "customer_id": "key", "order_status": "string", "order_purchase_timestamp": "time",
               "order_approved_at": "time", "order_delivered_carrier_date": "time",
               "order_delivered_customer_date": "time", "order_estimated_delivery_date": "time"},
    "order_items": {"order_id": "key", "order_item_id": "key", "product_id": "key", "seller_id": "key",
                    "price": "number", "freight_value": "number"},
    "customers": {"customer_id": "key", "customer_unique_id": "key", "customer_city": "key",
                  "customer_zip_code_prefix": "key"},
    "products": {"product_id": "key", "product_category_name": "string", "product_weight_g": "number"},
    "product_category_name_translation": {"product_category_name": "string",
                                          "product_category_name_english": "string"},
    "order_reviews": {"order_id": "key", "review_score": "number"},
    "order_payments": {"order_id": "key", "payment_value": "number"},
    "geolocation": {"geolocation_zip_code_prefix": "key", "geolocation_lat": "number", "geolocation_lng": "number"},
}
_ALLOWED = {"string": (T.StringType,), "time": (T.StringType, T.TimestampNTZType, T.TimestampType, T.DateType),
            "number": (T.NumericType, T.StringType), "key": (T.DataType,)}

TS_COLUMNS = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
              "order_delivered_customer_date", "order_estimated_delivery_date")


def _ts(df: DataFrame, c: str):
    """Declared times as they are, so that range filters reach the scan; only text is parsed."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(c)
    if isinstance(kind, T.StringType):
        return F.col(c).try_cast("timestamp_ntz").alias(c)
    return F.col(c).cast("timestamp_ntz").alias(c)


def check_columns(df: DataFrame, table: str, wanted: dict[str, str]) -> DataFrame:
    """``df`` if it has every required column with a fitting type, else ValueError."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{c} is missing" for c in wanted if c not in have]
    wrong += [f"{c} is {have[c].simpleString()}, not a {k}" for c, k in wanted.items()
              if c in have and not isinstance(have[c], _ALLOWED[k])]
    if wrong:
        raise ValueError(f"table {table}: " + "; ".join(wrong))
    return df


class CommerceTables(TableSet):
    """Roles over Parquet tables named as in the original schema (one folder each).

    ``leads`` and ``deals`` name the qualified-lead table (key + origin) and
    the closed-deal table (key), which the reference used without their SQL."""

    stage_key = "order_id"

    def __init__(self, spark: SparkSession, base_dir: str, leads: str = "leads", deals: str = "closed_deals",
                 lead_key: str = "lead_id"):
        self.spark, self.base_dir = spark, base_dir
        self.leads_table, self.deals_table, self.lead_key = leads, deals, lead_key

    def table(self, name: str) -> DataFrame:
        wanted = SCHEMAS.get(name) or (
            {self.lead_key: "key", "origin": "string"} if name == self.leads_table else {self.lead_key: "key"})
        return check_columns(self.spark.read.parquet(os.path.join(self.base_dir, name)), name, wanted)

    def unparsed_times(self) -> DataFrame:
        """-> one row: for each text time column of ``orders``, the values that are set but do not parse."""
        o = self.table("orders")
        text = [c for c in TS_COLUMNS if isinstance(o.schema[c].dataType, T.StringType)]
        bad = lambda c: F.col(c).isNotNull() & F.col(c).try_cast("timestamp_ntz").isNull()
        return o.agg(F.count(F.lit(1)).alias("orders"), *[F.count_if(bad(c)).alias(c) for c in text])

    @cached_property
    def orders(self) -> DataFrame:
        o = self.table("orders")
        return o.select("order_id", "customer_id", "order_status", *[_ts(o, c) for c in TS_COLUMNS])

    def delivered_orders(self) -> DataFrame:
        return self.orders.where(F.col("order_status") == "delivered")

    @cached_property
    def order_items(self) -> DataFrame:
        i = self.table("order_items")
        return i.select("order_id", "order_item_id", "product_id", "seller_id",
                        F.col("price").cast(MONEY).alias("price"),
                        F.col("freight_value").cast(MONEY).alias("freight_value"))

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customers").select("customer_id", "customer_unique_id", "customer_city",
                                              "customer_zip_code_prefix")

    @cached_property
    def products(self) -> DataFrame:
        p = self.table("products")
        return p.select("product_id", "product_category_name",
                        F.col("product_weight_g").cast("double").alias("product_weight_g"))

    @cached_property
    def translation(self) -> DataFrame:
        return self.table("product_category_name_translation").select(
            "product_category_name", "product_category_name_english")

    @cached_property
    def order_reviews(self) -> DataFrame:
        r = self.table("order_reviews")
        return r.select("order_id", F.col("review_score").cast("int").alias("review_score"))

    @cached_property
    def order_payments(self) -> DataFrame:
        p = self.table("order_payments")
        return p.select("order_id", F.col("payment_value").cast(MONEY).alias("payment_value"))

    @cached_property
    def geolocation(self) -> DataFrame:
        g = self.table("geolocation")
        return g.select("geolocation_zip_code_prefix",
                        F.col("geolocation_lat").cast("double").alias("geolocation_lat"),
                        F.col("geolocation_lng").cast("double").alias("geolocation_lng"))

    @cached_property
    def order_times(self) -> DataFrame:
        return self.orders

    @cached_property
    def stages(self) -> DataFrame:
        """Orders with their customer's city (O16 input)."""
        return self.orders.join(self.customers.select("customer_id", "customer_city"), "customer_id")

    @cached_property
    def shipments(self) -> DataFrame:
        """One row per (order, seller): purchase and delivery time (O24 input)."""
        pairs = self.order_items.select("order_id", "seller_id").distinct()
        times = self.orders.select("order_id", "order_purchase_timestamp", "order_delivered_customer_date",
                                   F.lit(True).alias("known"))
        return pairs.join(times, "order_id", "left").withColumn("has_order", F.col("known").isNotNull()).drop("known")

    @cached_property
    def deliveries(self) -> DataFrame:
        """One row per order: purchase and delivery time (O17 input)."""
        return self.orders.select("order_id", "order_purchase_timestamp", "order_delivered_customer_date")

    @cached_property
    def leads(self) -> DataFrame:
        return self.table(self.leads_table).select(F.col(self.lead_key).alias("lead_id"), "origin")

    @cached_property
    def deals(self) -> DataFrame:
        return self.table(self.deals_table).select(F.col(self.lead_key).alias("lead_id")).distinct()
