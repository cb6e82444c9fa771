"""Every core query runs on the smallest tables; those with an SQL twin give the same rows."""

import importlib

import pytest
from sql_twins import assert_same

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CATALOGUES]
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, data, module, name):
    df = module.QUERIES[name](spark, data)
    if name in module.SQL:
        assert_same(df, module.SQL[name], data)
    else:
        assert len(df.columns) == len(set(df.columns))
        df.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
