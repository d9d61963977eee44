"""The panel job writes every figure dataset, and each one equals its query."""

import tempfile

import pytest

from bazaar.plans.catalog import QUERIES
from bazaar.plans.panels import PANELS, write_panels
from tools.executed_plans import executed, scans
from tools.oracle_check import bag

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def job(spark, events):
    """The written paths and the executed plans of the whole job."""
    paths = {}
    plans = executed(spark, events, lambda: paths.update(
        write_panels(spark, SF_SMALL, tempfile.mkdtemp(prefix="bazaar-panels-"))))
    return paths, plans


@pytest.fixture(scope="module")
def paths(job):
    return job[0]


def test_shared_inputs_are_built_once(job):
    # four datasets come from the values by area, which alone read the suppliers' areas
    assert scans(job[1], "supplier") == 1
    # items: costs, category sales, monthly and daily sales, RFM, deliveries, seller scores, buckets
    # and times, and the weights of the top categories
    assert scans(job[1], "lineitem") <= 10


def test_every_figure_is_written(paths):
    assert set(paths) == {f"{p}/{f}" for p, figs in PANELS.items() for f in figs}


@pytest.mark.parametrize("query", sorted({q for figs in PANELS.values() for q in figs.values()}))
def test_datasets_equal_their_queries(spark, paths, query):
    want = QUERIES[query](spark, SF_SMALL)
    expected = bag(want.columns, [tuple(r) for r in want.collect()], 6)
    assert expected
    for panel, figs in PANELS.items():
        for fig, q in figs.items():
            if q == query:
                got = spark.read.parquet(paths[f"{panel}/{fig}"])
                assert got.columns == want.columns
                assert bag(got.columns, [tuple(r) for r in got.collect()], 6) == expected
