"""Every query with SQL against DuckDB on the same tables; the others must run and keep their columns."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

from palimpsest.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    assert got, "no rows prove nothing"
    if name not in registry.ORACLES:
        return
    r = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr([norm(row[names.index(c)]) for c in cols]) for row in r.fetchall())
