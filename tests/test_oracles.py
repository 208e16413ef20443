"""Every query with SQL against DuckDB; the others must at least run."""

from __future__ import annotations

from importlib import import_module

import oracle
import pytest

import __spark_entry__ as entry

MODULES = [import_module(m) for m in entry.PLANS]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    missing, extra, _ = oracle.compare(spark, data, name, QUERIES[name], SQL[name])
    assert not missing and not extra, (sum(missing.values()), list(missing)[:3], sum(extra.values()), list(extra)[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
