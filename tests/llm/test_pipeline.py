"""The pipeline on planted rows, and its stages against what each one must do."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import common


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark with known copies, near copies, leaks and toxic texts."""
    d = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("aeiourstlnm") for _ in range(rnd.randrange(2, 8))) for _ in range(3000)]
    para = lambda n: [rnd.choice(vocab) for _ in range(n)]
    docs, labels = {}, {}
    for i in range(300):
        docs[i] = " ".join(para(rnd.randrange(60, 200)))
        labels[i] = 0
    for i in range(300, 500):
        w = para(rnd.randrange(40, 120))
        for _ in range(4):
            w[rnd.randrange(len(w))] = rnd.choice(["zyxwvq", "qqvvxx", "wwzzkk"])
        docs[i], labels[i] = " ".join(w), 1
    items = {k: " ".join(para(40)) for k in range(10)}
    copies = {600 + i: docs[i].replace(" ", "\n", 3) for i in range(20)}
    near = {}
    for i in range(20, 40):
        w = docs[i].split()
        w[len(w) // 2] = "edited"
        near[700 + i] = " ".join(w)
    leaks = {800 + k: " ".join(para(50)) + " " + t + " " + " ".join(para(50)) for k, t in items.items()}
    docs |= copies | near | leaks
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, v) for i, v in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_pipeline(spark, planted):
    d, docs = planted
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    clean = set(range(300))
    assert not got.keys() & set(range(300, 500)), "toxic documents stay"
    assert not got.keys() & set(range(800, 900)), "leaks stay"
    assert all(len(got.keys() & {i, 600 + i}) == 1 for i in range(20)), "copies"
    assert all(len(got.keys() & {i, 700 + i}) == 1 for i in range(20, 40)), "near copies"
    assert len(got.keys() & clean) + len(got.keys() & set(range(600, 620))) == 300, "clean documents went"
    for i, r in got.items():
        assert r["decoded_sha256"] == hashlib.sha256(docs[i].encode()).hexdigest()


def test_stages_keep_the_columns(spark, planted):
    d, _ = planted
    docs = common.documents(spark, d)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stage(stage(spark, docs, d), "test")
        assert out.columns == docs.columns
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True)


def test_odd_rows_pass_every_stage(spark, planted):
    d, _ = planted
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a stone line on some marine stairs", "en", "a", 1), (3, "tale " * 20_000, None, "a", 1), (4, "late trains are soon late", "en", "a", 1), (4, "late trains are soon late", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    for k in (docs, docs.filter("false")):
        out = k
        first = corpus_pipeline.STAGES[0][1](spark, k, d)
        assert first.columns == k.columns and first.filter("score <> 'x'").count() == 0
        for _, stage in corpus_pipeline.STAGES:
            out = common.stage(stage(spark, out, d), "test")
        assert (out.count() > 0) == (k.count() > 0)
