"""Every registered query of the raster engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from terrace.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = ("customer", "events", "embeddings")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    oracle = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
    assert sorted(con.sql(ORACLE_SQL[name]).columns) == columns
    assert plain(df.select(*columns).collect()) == plain(oracle.fetchall())


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


def test_entry_without_the_training_data_operators(monkeypatch):
    """The raster queries are there, and nothing raises, where the subpackage is gone."""
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("terrace.llm") else find(name, *a))
    assert __spark_entry__.queries().keys() == QUERIES.keys() and __spark_entry__.oracle_sql() == ORACLE_SQL


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
