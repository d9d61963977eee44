"""Per-category linear trend and year-over-year forecast."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.timeutil import days_between_dates


def lm_per_category(daily: DataFrame, x: str = "day", y: str = "sales", by: str = "category",
                    digits: int | None = None) -> DataFrame:
    """Least-squares slope and intercept of y on x per series -> (category, slope, intercept).
    NULL for a series with one point (zero denominator). Algebraic aggregates:
    partial per partition, merged once per series. ``digits`` rounds the output."""
    slope, icpt = F.regr_slope(y, x), F.regr_intercept(y, x)
    if digits is not None:
        slope, icpt = F.round(slope, digits), F.round(icpt, digits)
    return daily.groupBy(F.col(by).alias("category")).agg(slope.alias("slope"), icpt.alias("intercept"))


def _month_bounds(month: str) -> tuple[dt.date, dt.date]:
    y, m = (int(v) for v in month.split("-"))
    first = dt.date(y, m, 1)
    nxt = dt.date(y + (m == 12), m % 12 + 1, 1)
    return first, nxt - dt.timedelta(days=1)


def forecasted_sales(daily: DataFrame, start: str, month: str) -> DataFrame:
    """Forecast for each day of ``month`` = sales on the same day a year
    earlier x predicted(day + shift) / predicted(day), then a centred 5-row
    moving average per category (rows, not days: gaps are not filled).
    -> (day_of_month, category, moving_avg_sales)

    All date arithmetic on the parameters is folded on the driver. The trend
    of each category is a window over its daily rows (at most one per day of
    the range), so the sales are scanned and aggregated once.
    """
    first, last = _month_bounds(month)
    shift = (last - _month_bounds(f"{last.year - 1}-{last.month:02d}")[1]).days
    lo = days_between_dates(start, first.isoformat())
    hi = days_between_dates(start, last.isoformat())
    whole = Window.partitionBy("category")
    f = (daily.withColumn("slope", F.regr_slope("sales", "day").over(whole))
         .withColumn("intercept", F.regr_intercept("sales", "day").over(whole))
         .where((F.col("day") + shift >= lo) & (F.col("day") + shift <= hi))
         .select(F.add_months("date", 12).alias("date"), "category",
                 (F.try_divide(F.col("intercept") + F.col("slope") * (F.col("day") + shift),
                               F.col("intercept") + F.col("slope") * F.col("day")) * F.col("sales"))
                 .alias("forecasted_sales")))
    w = Window.partitionBy("category").orderBy("date").rowsBetween(-2, 2)
    return f.select(F.dayofmonth("date").cast("bigint").alias("day_of_month"), "category",
                    F.avg("forecasted_sales").over(w).alias("moving_avg_sales"))


def regression_line(coefs: DataFrame, n_days: int) -> DataFrame:
    """Intercept + slope * day for day 0 .. n_days-1 per series.
    Generated per coefficient row (no join): n_days rows for each category."""
    return (coefs.select("category", "slope", "intercept",
                         F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("day"))
            .select("category", F.col("day").cast("bigint").alias("day"),
                    (F.col("intercept") + F.col("slope") * F.col("day")).alias("predicted")))


def series_split(df: DataFrame, values: Sequence[str], col: str = "category") -> DataFrame:
    """The rows of the given series only."""
    return df.where(F.col(col).isin(list(values)))
