"""Every core query against DuckDB on the smallest tables."""

import duckdb
import pytest

from daftar import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def rows(names, held):
    return sorted((tuple(str(plain(r[names.index(n)])) for n in sorted(names)) for r in held))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    result = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_registry():
    assert queries.FLAGSHIP in queries.QUERIES
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
