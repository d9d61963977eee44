"""Category sales ranking, "other" fold, weight medians, selected-category series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.timeutil import day_number, in_half_open, month_label

TS = "order_purchase_timestamp"
CAT_EN = "product_category_name_english"


def product_categories(products: DataFrame, translation: DataFrame,
                       categories: Sequence[str] | None = None) -> DataFrame:
    """(product_id, category, weight) with the English category name; optionally
    only the given categories (a literal IN list, pushed to the dimension scan)."""
    t = translation
    if categories is not None:
        t = t.where(F.col(CAT_EN).isin(list(categories)))
    return (products.join(t, "product_category_name")
            .select("product_id", F.col(CAT_EN).alias("category"), F.col("product_weight_g").alias("weight")))


def ranked_categories(items: DataFrame, orders: DataFrame, products: DataFrame, translation: DataFrame,
                      status: str | None = "delivered", exact: bool = False) -> DataFrame:
    """Sales per category of orders with ``status`` and RANK() by sales desc
    -> (category, sales, rank).

    Sales are first reduced to one row per product (partial aggregation before
    the shuffle), so the product/category joins see products, not items.
    RANK runs over the category-level result, whose size is the number of
    categories; ties in the exact decimal sums keep equal ranks. ``exact``
    keeps ``sales`` as the DECIMAL sum (for further exact sums, as in O09).
    """
    o = orders if status is None else orders.where(F.col("order_status") == status)
    per_product = (items.select("order_id", "product_id", "price").join(o.select("order_id"), "order_id")
                   .groupBy("product_id").agg(F.sum("price").alias("sales")))
    per_cat = (per_product.join(product_categories(products, translation), "product_id")
               .groupBy("category").agg(F.sum("sales").alias("sales")))
    sales = F.col("sales") if exact else F.col("sales").cast("double")
    return per_cat.select("category", sales.alias("sales"),
                          F.rank().over(Window.orderBy(F.desc("sales"))).cast("bigint").alias("rank"))


def category_sales_summary(ranked: DataFrame, k: int = 18, other_label: str = "Other categories") -> DataFrame:
    """The top-k categories by rank (ties kept) plus one row summing the
    rest; that row's sales is NULL when nothing is left (a global SUM over no rows)."""
    top = ranked.where(F.col("rank") <= k).select("category", "sales")
    rest = ranked.where(F.col("rank") > k).agg(F.sum("sales").alias("sales"))
    out = top.unionByName(rest.select(F.lit(other_label).alias("category"), "sales"))
    return out.select("category", F.col("sales").cast("double").alias("sales"))


def top_categories(ranked: DataFrame, k: int = 18) -> DataFrame:
    """The categories with rank <= k, as a DataFrame for semi-joins."""
    return ranked.where(F.col("rank") <= k).select("category")


def sold_item_weights(products: DataFrame, items: DataFrame, translation: DataFrame,
                      categories: DataFrame) -> DataFrame:
    """One row per sold item of the given categories: (weight, category, item keys)."""
    pc = product_categories(products, translation).join(categories, "category", "left_semi")
    return items.select("order_id", "order_item_id", "product_id", "seller_id").join(pc, "product_id")


def category_weights(products: DataFrame, items: DataFrame, translation: DataFrame,
                     categories: DataFrame) -> DataFrame:
    """Sold items of the given categories as counts: (category, weight, items)."""
    w = sold_item_weights(products, items, translation, categories)
    return w.groupBy("category", "weight").agg(F.count(F.lit(1)).alias("items"))


#: Consecutive row numbers generated at a time.
NUMBERS = 1 << 16


def numbered_weights(counts: DataFrame) -> DataFrame:
    """O10 from ``category_weights``: a row per item with its weight, ROW_NUMBER within the
    category by weight (NULL first) and the category's item count.

    Items of equal weight are interchangeable, so numbers are not given to
    items by sorting them: a weight's items hold the numbers after those of
    the smaller weights, and running counts over a category's distinct
    weights (which the product dimension bounds) say which. The numbers are
    then generated, in runs of ``NUMBERS`` dealt over all tasks, so a category
    or weight that holds a third of all items is no task of its own.
    """
    w = Window.partitionBy("category")
    upto = F.sum("items").over(w.orderBy(F.asc_nulls_first("weight")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("weight", "category", (upto - F.col("items") + 1).alias("first"), upto.alias("last"),
                           F.sum("items").over(w).alias("category_count"))
    runs = placed.withColumn("first", F.explode(F.sequence("first", "last", F.lit(NUMBERS).cast("bigint"))))
    runs = runs.withColumn("last", F.least(F.col("first") + NUMBERS - 1, "last")).repartition("category", "first")
    return runs.select("weight", "category", F.explode(F.sequence("first", "last")).alias("category_row_n"),
                       F.col("category_count").cast("bigint").alias("category_count"))


def ordered_categories(products: DataFrame, items: DataFrame, translation: DataFrame,
                       categories: DataFrame) -> DataFrame:
    """``numbered_weights`` of the sold items: one pass of counts, one of numbering."""
    return numbered_weights(category_weights(products, items, translation, categories))


def categories_by_median(weights: DataFrame, weight: str = "weight", category: str = "category",
                         count: str | None = None) -> DataFrame:
    """Categories ordered by the median weight of their items, where NULL
    weights take part in the positions (sorted first) like the row-number form.

    Exact and cheap: items are reduced to a (category, weight) -> count
    histogram first; running counts over the distinct weights locate the one
    or two middle positions. The window runs per category over its distinct
    weights, which the product dimension bounds (not the item count). ``count``
    names a column with the number of items that a row stands for.
    -> (category, median_weight)
    """
    h = weights.groupBy(F.col(category).alias("category"), F.col(weight).alias("w")).agg(
        (F.count(F.lit(1)) if count is None else F.sum(count)).alias("c"))
    wc = Window.partitionBy("category").orderBy(F.asc_nulls_first("w")).rowsBetween(Window.unboundedPreceding, 0)
    h = (h.withColumn("hi", F.sum("c").over(wc)).withColumn("lo", F.col("hi") - F.col("c") + 1)
         .withColumn("n", F.sum("c").over(Window.partitionBy("category"))))
    m1, m2 = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    g = (h.where(((F.col("lo") <= m1) & (m1 <= F.col("hi"))) | ((F.col("lo") <= m2) & (m2 <= F.col("hi"))))
         .groupBy("category")
         .agg(F.max(F.when((F.col("lo") <= m1) & (m1 <= F.col("hi")), F.col("w"))).alias("v1"),
              F.max(F.when((F.col("lo") <= m2) & (m2 <= F.col("hi")), F.col("w"))).alias("v2")))
    med = (F.coalesce("v1", "v2") + F.coalesce("v2", "v1")) / 2
    return g.select("category", med.alias("median_weight")).orderBy(F.asc_nulls_first("median_weight"), "category")


def _category_sales_rows(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                         categories: Sequence[str], start: str | None, end: str | None) -> DataFrame:
    pc = product_categories(products, translation, categories).select("product_id", "category")
    o = orders.where(in_half_open(F.col(TS), start, end)).select("order_id", TS)
    return items.select("order_id", "product_id", "price").join(pc, "product_id").join(o, "order_id")


def monthly_sales_selected_categories(orders: DataFrame, items: DataFrame, products: DataFrame,
                                      translation: DataFrame, categories: Sequence[str],
                                      start: str | None = None) -> DataFrame:
    """Month x selected category sales (NULL where a category sold nothing
    that month) from ``start`` on -> (year_month, <one column per category>)."""
    rows = _category_sales_rows(orders, items, products, translation, categories, start, None)
    wide = (rows.groupBy(month_label(F.col(TS)).alias("year_month"))
            .pivot("category", list(categories)).agg(F.sum("price")))
    return wide.select("year_month", *[F.col(f"`{c}`").cast("double").alias(c) for c in categories])


def daily_sales_per_category(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                             categories: Sequence[str], start: str, end: str) -> DataFrame:
    """Daily sales per selected category over [start, end) ->
    (date, day [days since start], category, sales)."""
    rows = _category_sales_rows(orders, items, products, translation, categories, start, end)
    return (rows.groupBy(F.to_date(TS).alias("date"), "category").agg(F.sum("price").alias("sales"))
            .select("date", day_number(F.col("date"), start).cast("bigint").alias("day"), "category",
                    F.col("sales").cast("double").alias("sales")))
