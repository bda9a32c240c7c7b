"""Every registered query against its SQL on the smallest tables, and the entry module's shape."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from tesserae import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v) if not isinstance(v, int) or isinstance(v, bool) else repr(float(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(normal(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", list(engine.queries()))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = engine.queries()[name](spark, sf_dir)
    expected = oracle.sql(engine.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert len(entry_module.entry(spark).collect()) == 20
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
    assert os.path.exists(os.path.join(os.path.dirname(entry_module.__file__), "bench.py"))
