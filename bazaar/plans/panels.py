"""The batch job that writes every figure dataset, grouped by dashboard panel.

The reference grouped its figures in six panels and served them from a web
dashboard. Here each figure's data is a tidy Parquet dataset written by the
executors; a dashboard (out of scope) only reads them.

    python -m bazaar.plans.panels --base-dir /root/testdata/sf0.1 --out /shared/panels
    python -m bazaar.plans.panels --schema commerce --base-dir /data/shop --out /shared/panels
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from bazaar.plans import catalog as Q
from bazaar.plans.params import REFERENCE, TEST, Params
from bazaar.sources.layout import LaidOut
from bazaar.sources.roles import Roles, Shared
from bazaar.sources.sinks import write_dataset

# panel -> figure dataset -> registered query (several figures appear in two panels)
PANELS: dict[str, dict[str, str]] = {
    "order_analysis": {"orders_per_day": "orders_per_day", "weekday_hour": "matrix_vs_mean",
                       "product_cost_histogram": "histogram",
                       "shipping_cost_histogram": "histogram_shipping_cost", "monthly_sales": "parse_dates",
                       "stage_times": "unpivot_series", "clv_map": "geo_markers",
                       "customer_density": "geo_density", "clv_density": "geo_density_clv",
                       "clv_labels": "hover_label"},
    "top_orders": {"category_treemap": "min_max_scale", "category_share": "category_share",
                   "weight_boxes": "explicit_order"},
    "predictions": {"regression_lines": "regression_line", "forecast": "forecasted_sales",
                    "rfm": "rfm_buckets"},
    "delivery": {"daily_delivery": "overall_mean_line", "delivery_trend": "lowess",
                 "review_scores": "review_score_count", "seller_delivery_boxes": "box_summary",
                 "seller_buckets": "sellers_per_bucket"},
    "reviews": {"review_scores": "review_score_count", "seller_scores": "seller_review_scores_and_sales",
                "seller_score_trend": "lowess_seller_scores"},
    "order_origin": {"lead_conversion": "lead_conversion"},
}


def _tables(spark: SparkSession, base_dir: str, schema: str):
    if schema == "layout":
        return LaidOut(spark, base_dir), TEST
    if schema == "commerce":
        from bazaar.sources.commerce import CommerceTables
        return CommerceTables(spark, base_dir), REFERENCE
    return Roles(spark, base_dir), TEST


def write_panels(spark: SparkSession, base_dir: str, out_dir: str, schema: str = "test",
                 params: Params | None = None) -> dict[str, str]:
    """Write every figure dataset under ``out_dir/<panel>/<figure>``; returns the paths.
    ``schema`` 'test' reads the test tables through the role views, 'commerce'
    tables of the original schema (with the reference's parameters unless
    ``params`` is given), 'layout' a folder of ``write_layout``. Each dataset is
    built and written in turn; inputs that several share (``TableSet.once``) are
    built once, and a dataset of two panels is copied."""
    tables, default = _tables(spark, base_dir, schema)
    params = params or default
    tables = Shared(tables)
    paths, done = {}, {}
    for panel, figs in PANELS.items():
        for fig, q in figs.items():
            name = f"{panel}/{fig}"
            df = spark.read.parquet(done[q]) if q in done else Q.ANALYSES[q](tables, params)
            paths[name] = done[q] = write_dataset(df, os.path.join(out_dir, name))
    return paths


def main(argv=None) -> None:
    from bazaar.session import get_session

    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--base-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--schema", choices=["test", "commerce", "layout"], default="test")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = get_session(a.master)
    for name, path in write_panels(spark, a.base_dir, a.out, a.schema).items():
        print(name, path)


if __name__ == "__main__":
    main()
