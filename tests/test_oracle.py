"""Every registered query against its DuckDB SQL twin on the base tables."""

import pytest

import __spark_entry__ as E
from bazaar.plans.oracle import ORACLE as TWINS
from tools.oracle_check import bag, duck

from .conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_a_twin_or_is_documented():
    from bazaar.plans.catalog import QUERIES as OWN
    assert set(OWN) == set(TWINS)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert bag(df.columns, rows, 6) == bag(ocols, orows, 6)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "sales"]
    rows = df.collect()
    assert len(rows) == 19 and sum(r.category == "Other categories" for r in rows) == 1
