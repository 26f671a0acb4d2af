"""Queries on planted tables whose whole job goes beyond what a cut would leave of it."""

from __future__ import annotations

import duckdb

from palimpsest.plans import registry


def held(spark, folder, name, tables):
    """The query's rows over the tables, after comparing them with its SQL's."""
    duck = duckdb.connect()
    for t, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    got = sorted(map(tuple, df.collect()))
    r = duck.execute(registry.ORACLES[name])
    at = [[x[0] for x in r.description].index(c) for c in df.columns]
    assert got == sorted(tuple(row[i] for i in at) for row in r.fetchall())
    return got


def test_every_line_is_a_source(spark, tmp_path):
    """Part 1 has small lines in closed orders only; part 2 a large one there and a small one in an open order."""
    lines = [(1, 1, 3.0), (2, 1, 48.0), (1, 1, 5.0), (1, 2, 50.0), (3, 2, 1.0), (3, 3, 50.0), (2, 4, 50.0), (9, 5, 50.0)]
    orders = [(1, "F"), (2, "F"), (3, "O")]
    assert held(spark, tmp_path, "WR-4", {"lineitem": ("l_orderkey long, l_partkey long, l_quantity double", lines), "orders": ("o_orderkey long, o_orderstatus string", orders)}) == [(1,), (4,)]


def test_all_bridges_are_returned(spark, tmp_path):
    """Forty blocks of fifty parts, alike and each joined within itself: 780 pairs, of which blocks 0 and 1 are joined already."""
    pairs = [(50 * c + 2 * i, 50 * c + 2 * i + 1) for c in range(40) for i in range(25)]
    pairs += [(47 + i, 50 + j) for i in range(3) for j in range(3) if 3 + j - i <= 5] + [(46, 50), (46, 51), (49, 53), (49, 54), (48, 53), (45, 50)]
    lines = [(o, p) for o, two in enumerate(pairs) for p in two]
    parts = [(p,) for p in range(2000)]
    got = held(spark, tmp_path, "GRA-5", {"lineitem": ("l_orderkey long, l_partkey long", lines), "part": ("p_partkey long", parts)})
    assert len({r[:2] for r in got}) == len(got) == 779 and (0, 1) not in {r[:2] for r in got}
