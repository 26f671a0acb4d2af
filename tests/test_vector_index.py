"""The vector index against a comparison with all vectors."""

from __future__ import annotations

import numpy as np
import pytest

from palimpsest.operators import retrieval, vector_index


def rows(n, places, groups, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, places))
    v = middle[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, places))
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize(("groups", "probes"), [(12, 3), (2000, 4)])
def test_exact_search_is_that_of_all(spark, groups, probes):
    """Clustered vectors and scattered ones, equal ones, zero ones, null ones and ones of another size."""
    data = rows(1500, 12, groups, 3)
    data += [(2000 + i, data[i][1]) for i in range(30)] + [(3000, [0.0] * 12), (3001, None), (3002, [1.0, 2.0]), (None, data[0][1])]
    df = spark.createDataFrame(data, "id long, vec array<double>").repartition(5)
    index = vector_index.build(df, 12, 20)
    asks = spark.createDataFrame([r for r in data if r[0] is not None and r[0] % 50 == 0] + [(9001, None)], "id long, vec array<double>")
    want = {(r["ask"], r["rank"]): (r["id"], round(r["score"], 9)) for r in retrieval.knn(asks, df, 7, 1e-9, skip_self=False).collect()}
    got = {(r["ask"], r["rank"]): (r["id"], round(r["score"], 9)) for r in vector_index.search(index, asks, 7, probes, exact=True, floor=1e-9).collect()}
    assert got.keys() == want.keys()
    for key, (id_, score) in got.items():
        assert score == pytest.approx(want[key][1], abs=1e-9) and (id_ == want[key][0] or score == pytest.approx(dict([want[key]])[want[key][0]], abs=1e-9))
    # every row is in a list
    assert spark.read.parquet(index.path).count() == len(data) - 1


def test_recall_of_few_probes(spark):
    data = rows(4000, 16, 40, 9)
    df = spark.createDataFrame(data, "id long, vec array<double>")
    index = vector_index.build(df, 16, 32)
    asks = df.filter("id % 100 = 0")
    assert vector_index.measured_recall(index, asks, df, 10, 4) >= 0.9
    assert vector_index.measured_recall(index, asks, df, 10, 32) == 1.0


def test_lists_of_many_rows_are_dealt_to_files(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 50)
    df = spark.createDataFrame([(i, [1.0, 0.01 * (i % 3)]) for i in range(400)], "id long, vec array<double>")
    index = vector_index.build(df, 2, 1)
    assert spark.read.parquet(index.path).selectExpr("input_file_name() as f").distinct().count() > 2
    none = vector_index.build(df.filter("false"), 2)
    assert vector_index.search(none, df, 3, exact=True).collect() == []
    assert vector_index.search(index, df.filter("false"), 3, exact=True).collect() == []
