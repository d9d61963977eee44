"""Parameters of the analyses: one set for the test tables, one with the
reference analysis's own values for tables of the original e-commerce schema."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    selected: tuple[str, ...]          # categories of the monthly / daily / forecast series
    sales_start: str                   # first day of the sales series
    sales_end: str                     # end of the daily series (exclusive)
    forecast_month: str                # month to forecast from the same month a year earlier
    top_k_categories: int
    top_k_cities: int
    ship_start: str                    # delivery-time range, end exclusive
    ship_end: str
    rfm_as_of: str | None              # "now" of the RFM recency; None = day after the last purchase
    seller_edges: tuple[int, ...]      # lowest order count of each seller bucket
    product_cost_bins: tuple[float, float, int]
    shipping_cost_bins: tuple[float, float, int]
    regression_days: int | None        # days of the regression lines; None = length of the sales range
    grid_deg: float = 1.0              # map density cell size in degrees
    delivery_trend_frac: float = 0.3
    seller_trend_frac: float = 0.1


# Parameters that suit the test tables (FIXTURES.md §2).
TEST = Params(
    selected=("brand_1", "brand_2", "brand_3", "brand_4", "brand_5"),
    sales_start="1995-01-01", sales_end="2001-08-01", forecast_month="2001-12",
    top_k_categories=18, top_k_cities=10, ship_start="1997-06-01", ship_end="1998-07-01",
    rfm_as_of="2002-01-01", seller_edges=(1, 500, 560, 590, 620),
    product_cost_bins=(0, 500000, 1000), shipping_cost_bins=(0, 40000, 800), regression_days=None)

# The reference analysis's own parameters (its seller bucket
# edges are not in the reference; these four are our choice). Its histogram
# views were 0-500 with 1000 bins and 0-80 with 800 bins.
REFERENCE = Params(
    selected=("health_beauty", "auto", "toys", "electronics", "fashion_shoes"),
    sales_start="2017-01-01", sales_end="2018-08-29", forecast_month="2018-12",
    top_k_categories=18, top_k_cities=10, ship_start="2017-06-01", ship_end="2018-06-30",
    rfm_as_of=None, seller_edges=(1, 10, 100, 1000),
    product_cost_bins=(0, 500, 1000), shipping_cost_bins=(0, 80, 800), regression_days=604)
