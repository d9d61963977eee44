"""Review score distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_score_count(reviews: DataFrame, score: str = "review_score") -> DataFrame:
    """Number of reviews per score -> (review_score, count)."""
    return reviews.groupBy(F.col(score).alias("review_score")).agg(F.count(F.lit(1)).alias("count"))
