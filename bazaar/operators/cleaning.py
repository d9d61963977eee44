"""Scaling, truncation and per-group outlier removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.ranking import join_groups, positions_quantiles, value_positions
from bazaar.operators.selection import Fences, counted_checkpoint
from bazaar.session import reliable_checkpoint


def min_max_scale(df: DataFrame, col: str, out: str | None = None, by: Sequence[str] = (),
                  digits: int = 3) -> DataFrame:
    """(x - min) / (max - min), rounded half-even on the binary value to
    ``digits`` (as numpy/pandas round); NULL when max = min. Without ``by`` the
    bounds come from one scalar subquery."""
    out = out or f"scaled_{col}"
    if by:
        b, seen = counted_checkpoint(df.groupBy(*by).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx")),
                                     n=F.count(F.lit(1)))
        j = join_groups(df, b, list(by), seen["n"], "left")
        val = F.try_divide(F.col(col) - F.col("_mn"), F.col("_mx") - F.col("_mn"))
        return j.withColumn(out, _round_even(val, digits)).drop("_mn", "_mx")
    # one scalar subquery returning both bounds
    b = df.agg(F.struct(F.min(col).alias("mn"), (F.max(col) - F.min(col)).alias("rng")).alias("b")).scalar()
    return df.withColumn(out, _round_even(F.try_divide(F.col(col) - b.getField("mn"), b.getField("rng")), digits))


def _round_even(c, digits: int):
    scale = float(10 ** digits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)


def truncate_int(df: DataFrame, col: str) -> DataFrame:
    """The value as a whole number, truncated toward zero."""
    return df.withColumn(col, F.col(col).cast("double").cast("bigint"))


def remove_outliers_sigma(df: DataFrame, col: str, by: Sequence[str], n_std: float = 3.0,
                          counts: DataFrame | None = None, count: str = "items") -> DataFrame:
    """Drop rows outside mean +- n_std * sample std of their group.
    NULL values, one-row groups and NULL groups are kept (no bounds apply).

    ``counts`` is a histogram (by..., col, ``count`` of rows) of the same rows where
    the caller has one; without it, it is taken from ``df``. Only the histogram
    is written; the filter, a value range per group, runs on ``df`` itself."""
    by = list(by)
    if counts is None:
        counts = reliable_checkpoint(df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(
            F.count(F.lit(1)).alias("_rows")))
        count = "_rows"
    bounds, n = _sigma_bounds(counts, col, count, by, n_std)
    j = join_groups(df, bounds, by, n, "left", null_safe=False)
    x = F.col(col)
    return j.where(F.coalesce(~((x < F.col("_lo")) | (x > F.col("_hi"))), F.lit(True))).drop("_lo", "_hi")


def _sigma_bounds(hist: DataFrame, col: str, count: str, by: list[str], n_std: float) -> tuple[DataFrame, int]:
    """(by..., _lo, _hi), checkpointed, and the number of groups: mean and deviation merged from counts."""
    h = hist.where(F.col(col).isNotNull())
    c, x = F.col(count), F.col(col).cast("double")
    mean, seen = counted_checkpoint(h.groupBy(*by).agg((F.sum(c * x) / F.sum(c)).alias("_mu"), F.sum(c).alias("_c")),
                                    n=F.count(F.lit(1)))
    off = x - F.col("_mu")
    spread = (join_groups(h, mean, by, seen["n"]).groupBy(*by)
              .agg(F.max("_mu").alias("_mu"), F.try_divide(F.sum(c * off * off), F.max("_c") - 1).alias("_var")))
    none = F.lit(False)
    for b in by:
        none = none | F.col(b).isNull()
    half = F.when(none | F.col("_var").isNull(), F.lit(float("inf"))).otherwise(F.lit(n_std) * F.sqrt("_var"))
    return reliable_checkpoint(spread.select(*by, (F.col("_mu") - half).alias("_lo"),
                                             (F.col("_mu") + half).alias("_hi"))), seen["n"]


def sigma_box_summary(hist: DataFrame, col: str, count: str, by: Sequence[str], n_std: float = 3.0) -> DataFrame:
    """D05 + D07 in one: the box-plot numbers of the rows ``remove_outliers_sigma``
    keeps, from a histogram (by..., col, count of rows): mean and deviation come
    from the same counts, and the kept rows are a value range of their group.
    -> (by..., min, q1, median, q3, max, n)"""
    by = list(by)
    bounds, n_groups = _sigma_bounds(hist, col, count, by, n_std)
    return _box(value_positions(hist, col, by, count), col, by, bounds, n_groups)


def _box(pos: DataFrame, col: str, by: list[str], bounds: DataFrame | None, n_groups: int) -> DataFrame:
    b = positions_quantiles(pos, col, by, [0.25, 0.5, 0.75], ["q1", "median", "q3"], bounds, True, n_groups)
    d = lambda c: F.col(c).cast("double").alias(c)
    return b.select(*by, d("min"), d("q1"), d("median"), d("q3"), d("max"), F.col("n").cast("bigint").alias("n"))


def remove_outliers_iqr(df: DataFrame, col: str, by: Sequence[str], k: float = 1.5, passes: int = 1) -> DataFrame:
    """Keep rows with Q1 - k*IQR <= x <= Q3 + k*IQR in their group. NULL
    values and NULL groups are dropped. Each pass recomputes the fences on
    the rows the previous pass kept (the reference applied it twice).

    The quartiles of all passes come from one selection (``Fences``): ``df`` is
    read for a sketch, for counts and for the filter, and neither its rows nor
    their distinct values are sorted or written."""
    by = list(by)
    if passes <= 0:
        return df
    f = Fences(df, col, by, k, passes)
    j = join_groups(df, f.bounds, by, f.n_groups, null_safe=False)
    return j.where((F.col(col) >= F.col("_lo")) & (F.col(col) <= F.col("_hi"))).select(*df.columns)


def iqr_box_summary(df: DataFrame, col: str, by: Sequence[str], k: float = 1.5, passes: int = 1) -> DataFrame:
    """D06 + D07 in one: the box-plot numbers of the rows ``remove_outliers_iqr``
    keeps, selected by the same pass as the fences.
    -> (by..., min, q1, median, q3, max, n)"""
    q = Fences(df, col, by, k, passes, {"q1": 0.25, "median": 0.5, "q3": 0.75}).bounds
    d = lambda c: F.col(c).cast("double").alias(c)
    return q.select(*by, d("min"), d("q1"), d("median"), d("q3"), d("max"), F.col("n").cast("bigint").alias("n"))
