"""Map marker attributes, density grid and hover labels over per-area CLV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marker popup text of the reference's map.
POPUP_FORMAT = "<b>Zip Code Prefix:</b> %d<br><b>Average CLV:</b> %d<br><b>Customers:</b> %d"
HOVER_FORMAT = "Zip code: %s<br>Average CLV: %.2f<br>Customers: %s<br> Latitude: %.4f <br> Longitude: %.4f"


def geo_markers(per_zip: DataFrame) -> DataFrame:
    """Circle radius 0.1*sqrt(customers), fill opacity 0.1 + 0.1*sqrt(clv / max clv),
    popup text with integer parts. The max is a scalar subquery (one value)."""
    top = per_zip.select(F.max("avg_CLV")).scalar()
    return per_zip.select(
        "zip_prefix", "latitude", "longitude",
        (F.lit(0.1) * F.sqrt("customer_count")).alias("radius"),
        (F.lit(0.1) + F.lit(0.1) * F.sqrt(F.try_divide(F.col("avg_CLV"), top))).alias("opacity"),
        F.format_string(POPUP_FORMAT, F.col("zip_prefix").cast("bigint"), F.col("avg_CLV").cast("bigint"),
                        F.col("customer_count").cast("bigint")).alias("popup"))


def geo_density(per_zip: DataFrame, weight: str = "customer_count", cell_deg: float = 1.0) -> DataFrame:
    """Sum of ``weight`` per lat/lng grid cell of ``cell_deg`` degrees.
    -> (cell_lat, cell_lng, weight)"""
    c = F.lit(float(cell_deg))
    return (per_zip.groupBy((F.floor(F.col("latitude") / c) * c).alias("cell_lat"),
                            (F.floor(F.col("longitude") / c) * c).alias("cell_lng"))
            .agg(F.sum(weight).cast("double").alias("weight")))


def hover_label(per_zip: DataFrame, value: str = "avg_CLV") -> DataFrame:
    """One hover text per area (NULL parts give a NULL label)."""
    return per_zip.select("zip_prefix", F.format_string(
        HOVER_FORMAT, F.col("zip_prefix").cast("string"), F.col(value), F.col("customer_count").cast("string"),
        F.col("latitude"), F.col("longitude")).alias("label"))
