"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from quarry.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, data, name):
    got = QUERIES[name](spark, data)
    cols = sorted(got.columns)
    rows = Counter(tuple(r[c] for c in cols) for r in got.collect())
    if name not in ORACLES:
        assert rows
        return
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = Counter(tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall())
    assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
