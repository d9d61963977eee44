"""Role views: the reference's e-commerce schema expressed over the test tables.

The operators speak the e-commerce vocabulary (orders, order items, customers,
products, reviews, payments, geolocation, sellers, leads). ``Roles`` maps each
role onto the base tables with plain projections, joins and aggregates, so
Catalyst prunes columns and pushes filters through them into the scans.
The mapping itself is fixed by FIXTURES.md §2.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.functions.firsts import first_rows
from bazaar.functions.numeric import MONEY
from bazaar.session import reliable_checkpoint
from bazaar.sources.tables import read_table


class TableSet:
    """What the analyses ask of a set of tables besides its roles."""

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """An input that several analyses share; here each builds its own."""
        return build()

    def orders_between(self, lo: str | None, hi: str | None) -> DataFrame:
        """At least the orders bought in [lo, hi); operators apply the range itself."""
        return self.orders

    def deliveries_between(self, lo: str | None, hi: str | None) -> DataFrame:
        """At least the deliveries of orders bought in [lo, hi)."""
        return self.deliveries


class Shared(TableSet):
    """The roles of another set of tables, for a job that runs many analyses: each
    shared input is built on first use and written to the checkpoint folder."""

    def __init__(self, tables: TableSet):
        self._of = tables
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str):
        return getattr(self._of, name)

    def orders_between(self, lo: str | None, hi: str | None) -> DataFrame:
        return self._of.orders_between(lo, hi)

    def deliveries_between(self, lo: str | None, hi: str | None) -> DataFrame:
        return self._of.deliveries_between(lo, hi)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._built:
            self._built[name] = reliable_checkpoint(build())
        return self._built[name]


class Roles(TableSet):
    """Lazily built role DataFrames over one directory of base tables."""

    #: the key counted per city when ranking the cities of ``stages``
    stage_key = "user_id"

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.base_dir, name)
        return self._tables[name]

    def months(self, orders: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
        """The months of [lo, hi), where the layout of the table has months."""
        return orders

    @cached_property
    def orders(self) -> DataFrame:
        return self.orders_between(None, None)

    def orders_between(self, lo: str | None, hi: str | None) -> DataFrame:
        o = self.months(self.table("orders"), lo, hi)
        status = (F.when(o.o_orderstatus == "F", "delivered")
                  .when(o.o_orderstatus == "O", "shipped").otherwise("processing"))
        return o.select(o.o_orderkey.alias("order_id"), o.o_custkey.alias("customer_id"),
                        status.alias("order_status"),
                        o.o_orderdate.alias("order_purchase_timestamp"))

    def delivered_orders(self) -> DataFrame:
        """Orders with status 'delivered', filtered on the raw status code so the
        predicate reaches the Parquet scan as ``o_orderstatus = 'F'``."""
        o = self.table("orders").where(F.col("o_orderstatus") == "F")
        return o.select(o.o_orderkey.alias("order_id"), o.o_custkey.alias("customer_id"),
                        F.lit("delivered").alias("order_status"),
                        o.o_orderdate.alias("order_purchase_timestamp"))

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.table("lineitem")
        price = li.l_extendedprice.cast(MONEY)
        return li.select(li.l_orderkey.alias("order_id"), li.l_linenumber.alias("order_item_id"),
                         li.l_partkey.alias("product_id"), li.l_suppkey.alias("seller_id"),
                         price.alias("price"),
                         (price * li.l_tax.cast("decimal(4,2)")).alias("freight_value"))

    @cached_property
    def customers(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .select(c.c_custkey.alias("customer_id"), c.c_custkey.alias("customer_unique_id"),
                        n.n_name.alias("customer_city"),
                        c.c_nationkey.alias("customer_zip_code_prefix")))

    @cached_property
    def products(self) -> DataFrame:
        p = self.table("part")
        return p.select(p.p_partkey.alias("product_id"), p.p_brand.alias("product_category_name"),
                        p.p_size.cast("double").alias("product_weight_g"))

    @cached_property
    def translation(self) -> DataFrame:
        p = self.table("part")
        return (p.select(p.p_brand.alias("product_category_name")).distinct()
                .withColumn("product_category_name_english",
                            F.lower(F.replace("product_category_name", F.lit("#"), F.lit("_")))))

    @cached_property
    def order_reviews(self) -> DataFrame:
        o = self.table("orders")
        return o.select(o.o_orderkey.alias("order_id"),
                        F.substring(o.o_orderpriority, 1, 1).cast("int").alias("review_score"))

    @cached_property
    def order_payments(self) -> DataFrame:
        o = self.table("orders")
        return o.select(o.o_orderkey.alias("order_id"), o.o_totalprice.cast(MONEY).alias("payment_value"))

    @cached_property
    def geolocation(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(s.s_nationkey.alias("geolocation_zip_code_prefix"),
                        ((s.s_nationkey % 5) * 10 - 20).cast("double").alias("geolocation_lat"),
                        (s.s_nationkey * 2 - 60 + s.s_suppkey % 3).cast("double").alias("geolocation_lng"))

    @cached_property
    def order_times(self) -> DataFrame:
        e = self.table("events")
        return e.select(e.event_id.alias("order_id"), e.ts.alias("order_purchase_timestamp"))

    @cached_property
    def stages(self) -> DataFrame:
        e = self.table("events")

        def first(kind: str):
            return F.min(F.when(e.event_type == kind, e.ts))

        return (e.groupBy(e.user_id, F.to_date(e.ts).alias("day"),
                          (e.user_id % 15).cast("int").alias("customer_city"))
                .agg(first("signup").alias("order_purchase_timestamp"),
                     first("view").alias("order_approved_at"),
                     first("click").alias("order_delivered_carrier_date"),
                     first("purchase").alias("order_delivered_customer_date"),
                     F.max(F.when(e.event_type == "error", e.ts)).alias("order_estimated_delivery_date")))

    @cached_property
    def shipments(self) -> DataFrame:
        li, o = self.table("lineitem"), self.table("orders")
        pairs = first_rows(li.select(li.l_orderkey.alias("order_id"), li.l_suppkey.alias("seller_id"),
                                     li.l_shipdate.alias("order_delivered_customer_date")),
                           "order_id", "seller_id", F.desc_nulls_last("order_delivered_customer_date"))
        # an order is one row, unless its rows name several times
        times = first_rows(o.select(o.o_orderkey.alias("known"), o.o_orderdate.alias("order_purchase_timestamp")),
                           "known", "order_purchase_timestamp")
        return (pairs.join(times, F.col("order_id") == F.col("known"), "left")
                .select("order_id", "seller_id", "order_purchase_timestamp",
                        F.col("known").isNotNull().alias("has_order"), "order_delivered_customer_date"))

    @cached_property
    def deliveries(self) -> DataFrame:
        """One row per order: purchase and delivery time (NULL without lines)."""
        return self.deliveries_between(None, None)

    def deliveries_between(self, lo: str | None, hi: str | None) -> DataFrame:
        li, o = self.table("lineitem"), self.months(self.table("orders"), lo, hi)
        shipped = li.groupBy(li.l_orderkey).agg(F.max(li.l_shipdate).alias("shipped"))
        return (o.join(shipped, o.o_orderkey == shipped.l_orderkey, "left")
                .select(o.o_orderkey.alias("order_id"), o.o_orderdate.alias("order_purchase_timestamp"),
                        shipped.shipped.alias("order_delivered_customer_date")))

    @cached_property
    def leads(self) -> DataFrame:
        c = self.table("customer")
        return c.select(c.c_custkey.alias("lead_id"), c.c_mktsegment.alias("origin"))

    @cached_property
    def deals(self) -> DataFrame:
        o = self.table("orders")
        return (o.where((o.o_orderstatus == "F") & (o.o_orderpriority == "1-URGENT")
                        & (o.o_totalprice > 300000))
                .select(o.o_custkey.alias("lead_id")).distinct())
