"""The analyses as named queries over a set of tables and parameters.

Each analysis is a function ``(tables, params) -> DataFrame`` where ``tables``
offers the e-commerce roles (``Roles`` over the test tables, or
``CommerceTables`` over tables of the original schema) and ``params`` is a
``Params``. ``QUERIES`` binds them to the test tables and parameters for the
driver: every callable there takes (spark, base_dir).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.functions.timeutil import days_between_dates
from bazaar.operators import cleaning as CL
from bazaar.operators import customers as C
from bazaar.operators import forecast as FC
from bazaar.operators import geo as G
from bazaar.operators import leads as LD
from bazaar.operators import logistics as L
from bazaar.operators import orders as O
from bazaar.operators import reviews as RV
from bazaar.operators import sales as S
from bazaar.operators import sellers as SL
from bazaar.operators import shaping as SH
from bazaar.operators import smoothing as SM
from bazaar.plans.params import TEST, Params
from bazaar.session import reliable_checkpoint
from bazaar.sources.roles import Roles

ANALYSES: dict[str, Callable] = {}


def register(name: str, rounded: tuple[str, ...] = (), digits: int = 4):
    """Register an analysis. Operators return unrounded values; ``rounded``
    columns are rounded in the registered query's last select only, so other
    analyses build on the exact ones."""
    def deco(fn):
        def last(t, P):
            df = fn(t, P)
            return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in rounded else F.col(c)
                               for c in df.columns])
        last.__name__, last.__doc__ = fn.__name__, fn.__doc__
        ANALYSES[name] = last if rounded else fn
        return fn
    return deco


def analyses(tables, params: Params) -> dict[str, Callable[[], DataFrame]]:
    """Every analysis over ``tables`` with ``params``, as zero-argument callables
    (some take eager checkpoint steps when built)."""
    return {name: (lambda fn=fn: fn(tables, params)) for name, fn in ANALYSES.items()}


# ---------------------------------------------------------------- orders
@register("orders_per_day")
def q_orders_per_day(t, P):
    return O.orders_per_day(t.orders)


@register("order_day_hour")
def q_order_day_hour(t, P):
    return O.order_day_hour(t.order_times)


@register("orders_by_weekday_hour")
def q_orders_by_weekday_hour(t, P):
    return O.orders_by_weekday_hour(t.order_times)


def _city_top(t, P):
    return O.orders_per_city(t.orders, t.customers, k=P.top_k_cities)


@register("orders_per_city")
def q_orders_per_city(t, P):
    return _city_top(t, P)


@register("orders_per_city_reversed")
def q_orders_per_city_reversed(t, P):
    return O.orders_per_city_reversed(_city_top(t, P))


@register("top_cities")
def q_top_cities(t, P):
    return O.top_cities(_city_top(t, P))


@register("order_price_stats")
def q_order_price_stats(t, P):
    return O.order_price_stats(t.orders, t.order_items)


def _costs(t):
    return t.once("order_costs", lambda: O.order_product_and_shipping_costs(
        t.delivered_orders(), t.order_items, status=None))


@register("order_product_and_shipping_costs")
def q_order_costs(t, P):
    return _costs(t)


# ---------------------------------------------------------------- sales
def _ranked(t, exact: bool = False):
    ranked = t.once("ranked_categories", lambda: S.ranked_categories(
        t.order_items, t.delivered_orders(), t.products, t.translation, status=None, exact=True))
    return ranked if exact else ranked.withColumn("sales", F.col("sales").cast("double"))


def _summary(t, P):
    return S.category_sales_summary(_ranked(t, exact=True), k=P.top_k_categories)


def _top(t, P):
    return S.top_categories(_ranked(t, exact=True), k=P.top_k_categories)


@register("ranked_categories")
def q_ranked_categories(t, P):
    return _ranked(t)


@register("category_sales_summary")
def q_category_sales_summary(t, P):
    return _summary(t, P)


@register("top_categories")
def q_top_categories(t, P):
    return _top(t, P)


@register("ordered_categories")
def q_ordered_categories(t, P):
    return S.ordered_categories(t.products, t.order_items, t.translation, _top(t, P))


def _top_weights(t, P):
    return S.sold_item_weights(t.products, t.order_items, t.translation, _top(t, P))


@register("categories_by_median", ("median_weight",))
def q_categories_by_median(t, P):
    return S.categories_by_median(_top_weights(t, P))


@register("monthly_sales_selected_categories")
def q_monthly_sales(t, P):
    return S.monthly_sales_selected_categories(t.orders_between(P.sales_start, None), t.order_items, t.products, t.translation,
                                               list(P.selected), start=P.sales_start)


def _daily(t, P):
    return t.once("daily_sales", lambda: S.daily_sales_per_category(
        t.orders_between(P.sales_start, P.sales_end), t.order_items, t.products, t.translation,
        list(P.selected), P.sales_start, P.sales_end))


@register("daily_sales_per_category")
def q_daily_sales(t, P):
    return _daily(t, P)


# ---------------------------------------------------------------- forecast
@register("lm_per_category", ("slope", "intercept"))
def q_lm_per_category(t, P):
    return FC.lm_per_category(_daily(t, P))


def _forecast(t, P):
    return FC.forecasted_sales(_daily(t, P), P.sales_start, P.forecast_month)


@register("forecasted_sales", ("moving_avg_sales",))
def q_forecasted_sales(t, P):
    return _forecast(t, P)


@register("regression_line", ("predicted",))
def q_regression_line(t, P):
    days = P.regression_days or days_between_dates(P.sales_start, P.sales_end)
    return FC.regression_line(FC.lm_per_category(_daily(t, P)), days)


@register("series_split", ("moving_avg_sales",))
def q_series_split(t, P):
    return FC.series_split(_forecast(t, P), list(P.selected[:2]))


# ---------------------------------------------------------------- logistics, reviews
@register("order_stage_times", tuple(n for n, _, _ in L.STAGES))
def q_order_stage_times(t, P):
    return L.order_stage_times(t.stages, top_k=P.top_k_cities, key=t.stage_key)


def _daily_ship(t, P):
    return t.once("daily_shipping", lambda: L.daily_avg_shipping_time(
        t.deliveries_between(P.ship_start, P.ship_end), P.ship_start, P.ship_end))


@register("daily_avg_shipping_time", ("avg_delivery_time",))
def q_daily_avg_shipping_time(t, P):
    return _daily_ship(t, P)


@register("overall_mean_line", ("avg_delivery_time", "overall_mean"))
def q_overall_mean_line(t, P):
    return L.overall_mean_line(_daily_ship(t, P))


@register("review_score_count")
def q_review_score_count(t, P):
    return RV.review_score_count(t.order_reviews)


# ---------------------------------------------------------------- customers, geo
@register("rfm_buckets", ("avg_days_since_purchase", "avg_sales_per_customer"))
def q_rfm_buckets(t, P):
    o = t.delivered_orders()
    as_of = P.rfm_as_of
    if as_of is None:  # the day after the last purchase, as one scalar
        as_of = F.date_add(F.to_date(o.select(F.max("order_purchase_timestamp")).scalar()), 1).cast("timestamp_ntz")
    return C.rfm_buckets(o, t.order_items, t.customers, as_of, status=None)


@register("clv")
def q_clv(t, P):
    return C.clv(t.customers, t.orders, t.order_payments)


def _per_zip(t, P):
    return t.once("clv_per_zip", lambda: C.avg_clv_per_zip(
        C.clv(t.customers, t.orders, t.order_payments), t.geolocation))


@register("avg_clv_per_zip", ("avg_CLV",), 2)
def q_avg_clv_per_zip(t, P):
    return _per_zip(t, P)


@register("geo_markers", ("radius", "opacity"))
def q_geo_markers(t, P):
    return G.geo_markers(_per_zip(t, P))


@register("geo_density", ("weight",))
def q_geo_density(t, P):
    return G.geo_density(_per_zip(t, P), "customer_count", P.grid_deg)


@register("geo_density_clv", ("weight",), 2)
def q_geo_density_clv(t, P):
    return G.geo_density(_per_zip(t, P), "avg_CLV", P.grid_deg)


@register("hover_label")
def q_hover_label(t, P):
    return G.hover_label(_per_zip(t, P))


# ---------------------------------------------------------------- sellers, leads
@register("seller_review_scores_and_sales", ("avg_review_score",))
def q_seller_scores(t, P):
    return t.once("seller_scores", lambda: SL.seller_review_scores_and_sales(t.order_items, t.order_reviews))


@register("sellers_per_bucket")
def q_sellers_per_bucket(t, P):
    return SL.sellers_per_bucket(t.order_items, P.seller_edges)


def _ship_times(t, P):
    return SL.seller_shipping_times(t.shipments, P.seller_edges)


@register("seller_shipping_times")
def q_seller_shipping_times(t, P):
    return _ship_times(t, P)


@register("lead_conversion", ("conversion_rate",))
def q_lead_conversion(t, P):
    return LD.lead_conversion(t.leads, t.deals)


# ---------------------------------------------------------------- figure data
@register("matrix_vs_mean")
def q_matrix_vs_mean(t, P):
    return SH.matrix_vs_mean(O.orders_by_weekday_hour(t.order_times))


@register("histogram", ("bin_lo", "bin_hi"))
def q_histogram(t, P):
    return SH.histogram(_costs(t), "product_cost", *P.product_cost_bins)


@register("histogram_shipping_cost", ("bin_lo", "bin_hi"))
def q_histogram_shipping(t, P):
    return SH.histogram(_costs(t), "shipping_cost", *P.shipping_cost_bins)


@register("min_max_scale")
def q_min_max_scale(t, P):
    return CL.min_max_scale(_summary(t, P), "sales", digits=3)


@register("truncate_int")
def q_truncate_int(t, P):
    return CL.truncate_int(_summary(t, P), "sales")


@register("category_share", ("share",))
def q_category_share(t, P):
    return SH.category_share(_summary(t, P))


@register("remove_outliers_sigma")
def q_remove_outliers_sigma(t, P):
    """One histogram of the sold items feeds the row numbers and the bounds."""
    w = reliable_checkpoint(S.category_weights(t.products, t.order_items, t.translation, _top(t, P)))
    return CL.remove_outliers_sigma(S.numbered_weights(w), "weight", ["category"], 3.0, counts=w)


@register("remove_outliers_iqr")
def q_remove_outliers_iqr(t, P):
    return CL.remove_outliers_iqr(_ship_times(t, P), "delivery_time", ["bucket"], 1.5, passes=2)


_BOX = ("min", "q1", "median", "q3", "max")


@register("box_summary", _BOX)
def q_box_summary(t, P):
    """Delivery-time boxes per seller bucket after the two-pass IQR filter."""
    return CL.iqr_box_summary(_ship_times(t, P), "delivery_time", ["bucket"], 1.5, passes=2)


@register("explicit_order", _BOX)
def q_explicit_order(t, P):
    """Weight boxes per top category (sigma-filtered) in median order. One
    (category, weight, count) histogram of the sold items feeds the bounds, the
    boxes and the medians; it is small and checkpointed."""
    w = reliable_checkpoint(S.category_weights(t.products, t.order_items, t.translation, _top(t, P)))
    boxes = CL.sigma_box_summary(w, "weight", "items", ["category"], 3.0)
    return SH.explicit_order(boxes, "category", S.categories_by_median(w, count="items"), "category",
                             order_by=[F.asc_nulls_first("median_weight")])


@register("unpivot_series", ("days",))
def q_unpivot_series(t, P):
    return SH.unpivot_series(q_order_stage_times(t, P), ["city"], [n for n, _, _ in L.STAGES], "stage", "days")


@register("parse_dates")
def q_parse_dates(t, P):
    return SH.parse_dates(q_monthly_sales(t, P), "year_month", "yyyy-MM")


@register("lowess", ("avg_delivery_time", "trend"))
def q_lowess(t, P):
    """Delivery-time trend over the daily means; x = day number."""
    epoch = F.lit("1970-01-01").cast("date")
    daily = _daily_ship(t, P).withColumn("x", F.datediff("purchase_date", epoch))
    fit = SM.lowess(daily, "x", "avg_delivery_time", frac=P.delivery_trend_frac)
    return fit.select(F.date_add(epoch, F.col("x").cast("int")).alias("purchase_date"),
                      "avg_delivery_time", F.col("fit").alias("trend"))


@register("lowess_seller_scores", ("avg_review_score", "trend"))
def q_lowess_sellers(t, P):
    """Review score vs total sales trend per seller."""
    fit = SM.lowess(q_seller_scores(t, P), "total_sales", "avg_review_score", frac=P.seller_trend_frac)
    return fit.select("total_sales", "avg_review_score", F.col("fit").alias("trend"))


# ---------------------------------------------------------------- driver binding
def _bind(fn):
    def run(spark: SparkSession, base_dir: str) -> DataFrame:
        return fn(Roles(spark, base_dir), TEST)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _bind(fn) for name, fn in ANALYSES.items()}
