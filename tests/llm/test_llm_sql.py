"""Queries with SQL give what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from strikeplane.llm import queries

TABLES = "documents embeddings conversations labels".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    answer = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r))[x] for x in columns) for r in answer.fetchall()), key=str)
    got = sorted((tuple(r[x] for x in columns) for r in df.collect()), key=str)
    close = lambda a, b: abs(a - b) <= 2e-4 * max(1, abs(a)) if isinstance(a, float) and isinstance(b, float) else a == b
    assert len(got) == len(want) > 0
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
