"""Every registered query against its SQL twin, on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from skein import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.5f}" if isinstance(x, float) else str(x)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf, name):
    got = registry.QUERIES[name](spark, sf)
    rows = got.collect()
    if name in registry.ORACLES:
        want = con.execute(registry.ORACLES[name])
        names = [x[0] for x in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted_rows(got.columns, rows) == sorted_rows(names, want.fetchall())
    else:
        assert got.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
