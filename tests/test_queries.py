"""Every registered query with a SQL twin against DuckDB on the smallest tables."""

import duckdb
import pytest

from arborist.plans import evaluation, measures, oracle, primitives, queries, twins  # noqa: F401 - some only register queries

ALL = oracle.SQL | evaluation.SQL | twins.SQL

EMPTY: set[str] = set()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_every_twin_has_its_query():
    assert set(ALL) <= set(queries.REGISTRY)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_its_twin(spark, sf, duck, name):
    df = queries.REGISTRY[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(ALL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert got or name in EMPTY
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in result.fetchall()), key=repr)
