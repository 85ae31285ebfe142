"""Every core query against its SQL on the smallest tables, in one pass."""

import importlib

import pytest

import __spark_entry__ as entry
from compare import compare, duck

CORE = {name: fn for m in entry._MODULES for name, fn in importlib.import_module(m).QUERIES.items()}
SQL = {name: sql for m in entry._MODULES for name, sql in importlib.import_module(m).ORACLE.items()}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, con, name):
    said, _, ok = compare(spark, con, name, CORE[name], SQL.get(name), sf)
    assert ok, said


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["evidence_claim_id", "known_from", "known_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
