"""A layout of the base tables that spares repeated analyses their largest exchange.

``write_layout`` writes orders and items as Parquet tables bucketed and sorted by
order key, so that joins and groupings by order (O06, O07, O08, O22) need no
exchange of either, and orders also by calendar month, so that a date range
(O12, O13, O17) reads the folders of its months only. The other tables are
written as they are. ``LaidOut`` offers the same roles over it as ``Roles``.

Buckets and partition columns are properties of a table, not of its files:
``LaidOut`` registers the two tables in the session (in its catalog, under names
made from the folder) and reads them from there.
"""

from __future__ import annotations

import datetime as _dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.sources.roles import Roles
from bazaar.sources.sinks import write_dataset
from bazaar.sources.tables import TABLE_SCHEMAS, read_table, table_path

#: bucketed tables: the order key, and the time whose months are folders (or None)
BUCKETED = {"orders": ("o_orderkey", "o_orderdate"), "lineitem": ("l_orderkey", None)}
MONTH = "order_month"
MARK = "_layout"  # written last: number of buckets


def month_of(ts: str) -> Column:
    """The calendar month as yyyymm (NULL for NULL)."""
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def month_bounds(lo: str | None, hi: str | None) -> tuple[int | None, int | None]:
    """First and last month that hold a time of [lo, hi)."""
    first = _dt.datetime.fromisoformat(lo) if lo is not None else None
    last = _dt.datetime.fromisoformat(hi) - _dt.timedelta(microseconds=1) if hi is not None else None
    return tuple(None if d is None else d.year * 100 + d.month for d in (first, last))


def _name(out_dir: str, table: str) -> str:
    return f"bazaar_{hashlib.sha1(out_dir.rstrip('/').encode()).hexdigest()[:12]}_{table}"


def write_layout(spark: SparkSession, base_dir: str, out_dir: str, buckets: int = 8) -> str:
    """Write the base tables under ``out_dir`` in the layout; returns ``out_dir``.

    Choose ``buckets`` so that a bucket of the items is a few hundred MB: a join
    runs one task per bucket. Rows are dealt out by the same hash that makes the
    buckets, so each bucket (of each month) is one file, written by one task.
    Rows without an order key share one bucket; rows without a time lie in a
    folder of their own, which no range reads. Empty tables stay empty tables.
    An earlier layout in ``out_dir`` is replaced; until the last write has ended
    the folder has no mark and ``LaidOut`` refuses it.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    write_dataset(spark.createDataFrame([], "buckets int"), table_path(out_dir, MARK))
    for name in TABLE_SCHEMAS:
        df = read_table(spark, base_dir, name)
        if name not in BUCKETED:
            write_dataset(df, table_path(out_dir, name))
            continue
        key, ts = BUCKETED[name]
        writer = (df.withColumn(MONTH, month_of(ts)) if ts else df).repartition(buckets, key).write
        writer = writer.format("parquet").mode("overwrite").option("path", table_path(out_dir, name))
        writer = writer.partitionBy(MONTH) if ts else writer
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(_name(out_dir, name))
    write_dataset(spark.createDataFrame([(buckets,)], "buckets int"), table_path(out_dir, MARK))
    return out_dir


def _registered(spark: SparkSession, out_dir: str, name: str, buckets: int) -> DataFrame:
    """The bucketed table, registered anew (its files and other layouts are left alone)."""
    key, ts = BUCKETED[name]
    table = _name(out_dir, name)
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in TABLE_SCHEMAS[name]] + ([f"{MONTH} int"] if ts else [])
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({', '.join(columns)}) USING parquet"
              + (f" PARTITIONED BY ({MONTH})" if ts else "")
              + f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{table_path(out_dir, name)}'")
    if ts:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


class LaidOut(Roles):
    """The roles over a folder that ``write_layout`` wrote."""

    def __init__(self, spark: SparkSession, base_dir: str):
        super().__init__(spark, base_dir)
        mark = spark.read.schema(T.StructType([T.StructField("buckets", T.IntegerType())])).parquet(
            table_path(base_dir, MARK)).first()
        if mark is None:
            raise ValueError(f"{base_dir}: the layout was not written to its end")
        self._tables = {name: _registered(spark, base_dir, name, mark.buckets) for name in BUCKETED}

    def months(self, orders: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
        first, last = month_bounds(lo, hi)
        if first is not None:
            orders = orders.where(F.col(MONTH) >= first)
        return orders if last is None else orders.where(F.col(MONTH) <= last)
