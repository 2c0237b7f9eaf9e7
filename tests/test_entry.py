"""The driver's entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from geomill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rounded(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(rounded, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(rounded(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0
