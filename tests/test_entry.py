"""Driver contract and a sample of oracle comparisons at the smallest scale."""

import pytest

import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare, duck


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "ndcg_10" in df.columns


def test_every_query_has_an_oracle_or_is_listed(spark):
    qs, sql = E.queries(), E.oracle_sql()
    missing = set(E._catalog.queries()) - set(sql)  # the optional part has tests of its own
    assert missing == set(E.NO_SQL_ORACLE)
    assert set(sql) <= set(qs)


@pytest.mark.parametrize("name", ["pair_view", "bm25_topk", "dense_topk_16", "candidates", "evaluate"])
def test_oracle_small(spark, name):
    con = duck(SF_SMALL)
    info = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert info["ok"], info
