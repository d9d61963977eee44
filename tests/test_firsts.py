"""Pairs of order and seller without a map of all pairs in a task (shipments, seller scores)."""

import datetime as dt

import pytest

from bazaar.operators.sellers import seller_review_scores_and_sales
from bazaar.plans.catalog import QUERIES
from bazaar.sources.roles import Roles
from tools.executed_plans import executed, nodes

from .conftest import SF_SMALL

D = [dt.datetime(2020, 1, d) for d in range(1, 10)]


class Small(Roles):
    def __init__(self, **tables):
        self._tables = tables


@pytest.mark.parametrize("name", ["seller_shipping_times", "seller_review_scores_and_sales"])
def test_no_map_of_orders_and_sellers(spark, events, name):
    plans = executed(spark, events, lambda: QUERIES[name](spark, SF_SMALL).write.format("noop").mode("overwrite").save())
    keys = [n["simpleString"].split("functions=")[0] for p in plans for n in nodes(p) if "Aggregate" in n["nodeName"]]
    assert keys and not any("order" in k and ("supp" in k or "seller" in k) for k in keys)


def test_shipments_with_repeated_and_missing_keys(spark):
    lines = [(1, 7, D[3]), (1, 7, D[5]), (1, 7, D[5]), (1, 8, None), (1, 8, None), (1, None, D[2]), (1, None, D[1]),
             (None, 7, D[4]), (None, 7, None), (2, 7, D[6]), (3, 9, D[7])]
    orders = [(1, D[0]), (1, D[0]), (1, D[1]), (2, None), (None, D[0])]
    t = Small(lineitem=spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz"),
              orders=spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz"))
    latest, known = {}, {}
    for o, s, d in lines:
        latest[o, s] = max(filter(None, (latest.get((o, s)), d)), default=None)
    for o, d in orders:
        known.setdefault(o, set()).add(d)
    want = [(o, s, d, o in known and o is not None, last) for (o, s), last in latest.items()
            for d in (known.get(o, [None]) if o is not None else [None])]
    assert sorted(map(tuple, t.shipments.collect()), key=repr) == sorted(want, key=repr)


def test_scores_with_repeated_and_missing_keys(spark):
    items = spark.createDataFrame(
        [(1, 7, 1.0), (1, 7, 2.0), (1, 8, None), (2, 7, 4.0), (3, 7, 8.0), (None, 7, 16.0), (None, 7, 32.0),
         (2, None, 64.0), (2, None, 64.0)], "order_id long, seller_id long, price double").selectExpr(
        "order_id", "seller_id", "CAST(price AS decimal(18,2)) AS price")
    reviews = spark.createDataFrame([(1, 5), (1, 4), (2, 1), (3, None), (None, 3)], "order_id long, review_score int")
    got = {tuple(r) for r in seller_review_scores_and_sales(items, reviews).collect()}
    assert got == {(7, 63.0, 2.75, 4), (8, None, 4.5, 1), (None, 128.0, 1.0, 1)}
