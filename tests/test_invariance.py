"""
property test of the distributed NTILE."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaar.operators import customers as C
from bazaar.operators import sales as S
from bazaar.operators.ranking import global_ntile
from bazaar.sources.roles import Roles

from .conftest import SF_SMALL


def _rows(df):
    """Sorted rows; sums of doubles depend on their order in the last bits."""
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 13])
def test_rfm_invariant(spark, parts):
    r = Roles(spark, SF_SMALL)
    base = _rows(C.rfm_buckets(r.delivered_orders(), r.order_items, r.customers, "2002-01-01", status=None))
    o, i, c = (df.repartition(parts) for df in (r.delivered_orders(), r.order_items, r.customers))
    assert _rows(C.rfm_buckets(o, i, c, "2002-01-01", status=None)) == base


@pytest.mark.parametrize("parts", [1, 13])
def test_ordered_categories_invariant(spark, parts):
    r = Roles(spark, SF_SMALL)
    top = S.top_categories(S.ranked_categories(r.order_items, r.delivered_orders(), r.products, r.translation,
                                               status=None, exact=True))
    base = _rows(S.ordered_categories(r.products, r.order_items, r.translation, top))
    got = _rows(S.ordered_categories(r.products.repartition(parts), r.order_items.repartition(parts),
                                     r.translation, top))
    assert got == base


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(min_value=0, max_value=6), min_size=0, max_size=60),
       tiles=st.integers(min_value=1, max_value=7))
def test_ntile_property(spark, values, tiles):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    got = {r.id: r.t for r in global_ntile(df, tiles, [F.desc("v")], "t", tiebreak=["id"]).collect()}
    exp = {r.id: r.t for r in df.withColumn("t", F.ntile(tiles).over(Window.orderBy(F.desc("v"), "id"))).collect()}
    assert got == exp


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]),
                               st.one_of(st.none(), st.integers(min_value=-3, max_value=3))),
                     min_size=1, max_size=80),
       probs=st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), min_size=1, max_size=3, unique=True))
def test_group_quantiles_property(spark, rows, probs):
    from bazaar.operators.ranking import group_quantiles

    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: tuple(r[n] for n in names) + (r.min, r.max, r.n)
           for r in group_quantiles(df, "v", ["g"], probs, names, with_min_max_count=True).collect()}
    exp = {r.g: tuple(r.p) + (r.mn, r.mx, r.n)
           for r in df.where("v IS NOT NULL").groupBy("g").agg(
               F.percentile("v", probs).alias("p"), F.min("v").alias("mn"), F.max("v").alias("mx"),
               F.count("v").alias("n")).collect()}
    assert got.keys() == exp.keys()
    for g in exp:
        assert got[g] == pytest.approx(exp[g], abs=1e-12)
