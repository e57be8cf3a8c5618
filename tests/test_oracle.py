"""Every registered query against its SQL on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from check import compare, connect
from thriftlens.plans.registry import ORACLES as SQL
from thriftlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        ok, note = compare(df, con, SQL[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_only_known_queries_lack_sql():
    assert set(QUERIES) == set(SQL)


def test_contract_has_every_query_and_its_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
