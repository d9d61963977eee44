"""Reshaping and summaries behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.ranking import group_quantiles


def unpivot_series(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "series",
                   value: str = "value") -> DataFrame:
    """Wide -> long (id..., var, value); one output row per input row and value column."""
    return df.unpivot(list(ids), list(values), var, value)


def matrix_vs_mean(matrix: DataFrame, row: str = "day_of_week_name", hours: Sequence[str] | None = None) -> DataFrame:
    """The weekday x hour matrix (O03) as cells, each flagged when above the
    mean of all cells. -> (day_of_week_name, hour, order_count, above_mean)"""
    hours = list(hours or [str(h) for h in range(24)])
    cells = (unpivot_series(matrix.select(row, *[F.col(f"`{h}`").cast("bigint").alias(h) for h in hours]),
                            [row], hours, "hour", "order_count")
             .withColumn("hour", F.col("hour").cast("bigint")))
    mean = cells.select(F.avg("order_count")).scalar()
    return cells.withColumn("above_mean", F.col("order_count") > mean)


def histogram(df: DataFrame, col: str, lo: float, hi: float, n_bins: int) -> DataFrame:
    """Fixed-width histogram; bin 0 counts values below ``lo``, bin
    n_bins + 1 values at or above ``hi`` (NULLs are not counted).
    -> (bin, bin_lo, bin_hi, count), non-empty bins only."""
    x = F.col(col).cast("double")
    lo_, hi_, n = float(lo), float(hi), int(n_bins)
    b = (F.when(x < lo_, 0).when(x >= hi_, n + 1)
         .otherwise(F.floor(F.lit(float(n)) * (x - lo_) / F.lit(hi_ - lo_)) + 1)).cast("bigint")
    width = (hi_ - lo_) / n
    g = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edge_lo = F.when(F.col("bin") == 0, F.lit(None)).otherwise(F.lit(lo_) + (F.col("bin") - 1) * F.lit(width))
    edge_hi = F.when(F.col("bin") == n + 1, F.lit(None)).otherwise(F.lit(lo_) + F.col("bin") * F.lit(width))
    return g.select("bin", edge_lo.cast("double").alias("bin_lo"), edge_hi.cast("double").alias("bin_hi"), "count")


def box_summary(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """The five numbers of a box plot per group (exact, linear quantiles)
    and the group size. -> (by..., min, q1, median, q3, max, n)"""
    q = group_quantiles(df, col, by, [0.25, 0.5, 0.75], names=["q1", "median", "q3"], with_min_max_count=True)
    d = lambda c: F.col(c).cast("double").alias(c)
    return q.select(*by, d("min"), d("q1"), d("median"), d("q3"), d("max"), F.col("n").cast("bigint").alias("n"))


def category_share(summary: DataFrame, value: str = "sales", key: str = "category") -> DataFrame:
    """Each row's share of the total (treemap area). -> (category, sales, share)"""
    total = summary.select(F.sum(value)).scalar()
    return summary.select(key, value, F.try_divide(F.col(value), total).alias("share"))


def parse_dates(df: DataFrame, col: str, fmt: str = "yyyy-MM", out: str = "period_start") -> DataFrame:
    """Text -> date with ``fmt`` (NULL when it does not parse), plus its
    month label."""
    d = F.to_date(F.try_to_timestamp(F.col(col), F.lit(fmt)))
    return df.withColumn(out, d).withColumn("month", F.date_format(d, "yyyy-MM"))


def explicit_order(df: DataFrame, col: str, order_df: DataFrame, order_col: str,
                   order_by: Sequence = (), position: str = "position") -> DataFrame:
    """Rows of ``df`` in the order given by ``order_df`` (e.g. categories by
    median). The order table is numbered with a window over its own rows,
    which are few (one per category or bucket), then joined on the key."""
    keys = list(order_by) or [F.asc_nulls_first(order_col)]
    pos = order_df.select(F.col(order_col).alias(col), F.row_number().over(
        Window.orderBy(*keys, F.asc_nulls_first(order_col))).cast("bigint").alias(position))
    return df.join(pos, col).orderBy(position)
