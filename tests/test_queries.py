"""Every query with SQL gives what DuckDB gives on the same tables, values and kinds of columns."""

import os

import duckdb
import pytest

from pactlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_llm_imports_outside():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "pactlake")
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder[len(root) :]:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "pactlake.llm" not in text.read(), f
