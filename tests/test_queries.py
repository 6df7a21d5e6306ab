"""Every core query against its SQL, and that those without SQL run."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tallyloom.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, catalogue.queries()[name], SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "rank" in entry.entry(spark).columns
