"""Every query with a SQL counterpart agrees with it; the contract of the entry module holds."""

import importlib.util
from pathlib import Path

import oracle
import pytest
from conftest import SMALL

from tabwright.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    assert oracle.differences(QUERIES[name](spark, SMALL), duck, SQL[name]) is None


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_module(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() == 3
    assert set(module.oracle_sql()) <= set(module.queries())
