"""First rows of keys within rows that lie together by another key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_first(df: DataFrame, key: str, by: str, out: str, *then: Column) -> DataFrame:
    """``df`` with a boolean column ``out``: true on one row of each (key, by), the first
    in order of ``then``. NULL is a value of its own.

    Rows are dealt out and sorted by ``key``, as a join by ``key`` wants them too, and
    read in order: a task holds a sort that can spill, and no map of all (key, by)."""
    w = Window.partitionBy(key).orderBy(by, *then)
    again = F.lag(by).over(w).eqNullSafe(F.col(by)) & (F.row_number().over(w) > 1)
    return df.withColumn(out, ~again)


def first_rows(df: DataFrame, key: str, by: str, *then: Column) -> DataFrame:
    """One row of each (key, by): the first in order of ``then``."""
    return mark_first(df, key, by, "__first", *then).where("__first").drop("__first")
