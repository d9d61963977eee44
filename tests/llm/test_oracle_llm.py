"""Queries with a SQL twin against DuckDB, on whole tables."""

import pytest

import __spark_entry__ as E
from bazaar.llm.oracle import ORACLE
from tools.oracle_check import bag, duck

from ..conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF_SMALL).execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names) and len(rows) == len(want)
    assert bag(df.columns, rows, 6) == bag(names, want, 6)
