"""Plans whose rows and shuffles must grow with their tables, not with the square of a group in them."""

from __future__ import annotations

import os
import time

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import activation, graph, names, retrieval, staging
from palimpsest.plans import registry  # loads the plans in their order
from palimpsest.plans import maintenance  # isort: skip
from palimpsest.sources import tables


def ran(df):
    """The operators of df's last plan with the rows that each gave, after df.collect()."""
    found = []

    def walk(p):
        name = p.nodeName()
        metrics = p.metrics()
        found.append((name, metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0))
        if name == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif "QueryStage" in name:
            walk(p.plan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_contained_names_shuffle_no_pairs(spark, tmp_path):
    """300 texts that contain a name of 300 subjects each: pairs leave the task that finds them and go nowhere else."""
    spark.createDataFrame([(i, f"{i} the Ring is there") for i in range(300)], "id long, text string").write.parquet(f"{tmp_path}/texts")
    subjects = spark.createDataFrame([(i, "the ring") for i in range(300)] + [(0, "is there"), (7, "nowhere")], "subject long, name string")
    df = names.contained(spark.read.parquet(f"{tmp_path}/texts"), subjects)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) == 90_000
    assert not [x for x in ran(df) if "Exchange" in x[0] or "Join" in x[0]]


def test_contained_names_of_repeated_ids(spark):
    texts = spark.createDataFrame([(1, "ring"), (1, "the ring"), (None, "ring"), (None, "ring"), (2, "ring gear")], "id long, text string").repartition(3)
    subjects = spark.createDataFrame([(5, "ring"), (5, "gear"), (6, "ring")], "subject long, name string")
    assert sorted((tuple(r) for r in names.contained(texts, subjects).collect()), key=str) == [(1, 5), (1, 6), (2, 5), (2, 6), (None, 5), (None, 6)]


def test_turns_and_claims_of_one_name_make_no_pairs(spark):
    """A name that all turns and claims share, beside rarer ones, subjects of several names, equal vectors and other sizes."""
    rng = np.random.default_rng(4)
    words, vecs = ["the ring", "gear box", "hot gear", "axle nut"], rng.normal(size=(40, 6))
    said = lambda i: " ".join(["the ring", *(w for j, w in enumerate(words[1:]) if (i >> j) & 1)]) if i % 11 else "gear box"
    vec = lambda i: None if i % 29 == 0 else [1.0, 2.0] if i % 31 == 0 else vecs[i * 7 % 40].tolist()
    turns = [(i, said(i), vec(i), i % 3) for i in range(200)]
    claims = [(1000 + i, said(3 * i), vec(i * i), i % 2) for i in range(200)] + [(9000, None, vec(1), 0), (9001, "none", vec(1), 0)]
    subjects = [(1, "the ring"), (2, "the ring"), (3, "gear box"), (4, "hot gear"), (4, "axle nut"), (5, "nobody")]
    schema = "id long, text string, vec array<double>, episode long"
    for block in (8 << 20, 30):
        df = names.related_claims(spark.createDataFrame(turns, schema), spark.createDataFrame(claims, schema), spark.createDataFrame(subjects, "subject long, name string"), 0.1, block_bytes=block)
        got = {r["turn"]: (r["claim"], round(r["relatedness"], 9)) for r in df.collect()}
        assert max(n for name, n in ran(df) if "Join" in name) <= 4 * len(turns)
        want = {}
        own = lambda t: {s for s, n in subjects if t and n in t}
        for t, text, v, e in turns:
            for c, other, w, f in claims:
                if v and w and e != f and len(v) == len(w) and own(text) & own(other):
                    r = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)
                    if r >= 0.1 and (t not in want or (-r, c) < (-want[t][1], want[t][0])):
                        want[t] = (c, r)
        assert got == want


def test_related_names_shuffle_no_pairs(spark):
    """200 asks and 300 ids of two names each: sets of names are compared, and what they relate is not grouped again."""
    asks = spark.createDataFrame([(i, "small rings" if i % 2 else "Small-Ring") for i in range(200)], "ask long, name string")
    known = spark.createDataFrame([(i, n) for i in range(300) for n in ("small ring", f"gear {i % 3}")], "id long, name string")
    df = names.related(asks, known)
    got = [tuple(r) for r in df.select("ask", "id", "relation").collect()]
    assert len(got) == 60_000 and set(got) == {(a, i, "bigram" if a % 2 else "squash") for a in range(200) for i in range(300)}
    assert not [x for x in ran(df) if "Aggregate" in x[0]]
    few = names.related(asks, known, most=4).select("ask", "id").collect()
    assert {(a, i) for a in range(200) for i in range(4)} <= {tuple(r) for r in few} and len(few) < 200 * 20


def test_best_documents_are_those_of_all(spark, monkeypatch):
    """Every ask and document share a word, and many documents are equal: pairs are no rows, ties go to the smaller id."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(int(i), None if i % 50 == 0 else "all " + " ".join(rng.choice(words, 6)) if i % 3 else "all w1 w2") for i in rng.permutation(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(a, t) for a in range(40) for t in ("all", words[a % 30], words[a * 7 % 30], "none", None)], "ask long, term string")
    every = {}
    for r in retrieval.bm25(docs, asked).collect():
        every.setdefault(r["ask"], []).append((-round(r["score"], 9), r["doc_id"]))
    for scores, postings in ((1 << 22, 1 << 22), (100, 60)):
        monkeypatch.setattr(retrieval, "SCORES", scores), monkeypatch.setattr(retrieval, "POSTINGS", postings)
        df = retrieval.bm25(docs, asked, best=7)
        got = {}
        for r in df.collect():
            got.setdefault(r["ask"], []).append((-round(r["score"], 9), r["doc_id"]))
        assert {a: sorted(x) for a, x in got.items()} == {a: sorted(x)[:7] for a, x in every.items()}
        assert not [x for x in ran(df) if "Join" in x[0] or "HashAggregate" in x[0]]


def test_lists_of_edges_hold_what_can_count(spark):
    """A hub's list has as many as may be passed over and as many as count; every node is one row."""
    both = [(0, i) for i in range(1, 200)] + [(i, 0) for i in range(1, 200)]
    edges = spark.createDataFrame([(a, b, "SIMILAR", 0.5 + max(a, b) / 1000, 1.0) for a, b in both], "node long, other long, type string, strength double, confidence double")
    got = {r["node"]: r for r in activation.prepared(edges, None, activation.Budget(neighbours=5, visited=9)).collect()}
    assert len(got) == 200 and got[0]["others"] == list(range(199, 185, -1)) and got[3]["others"] == [0]


def test_staged_tables_leave_no_shuffle(spark):
    before = spark.conf.get(staging.CLEAN_UP)
    files = lambda: sum(n.startswith("shuffle_") for _, _, names_ in os.walk(spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf())[0]) for n in names_)
    was = files()
    staging.stage(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    for _ in range(50):
        if files() <= was:
            break
        time.sleep(0.2)
    assert files() <= was and spark.conf.get(staging.CLEAN_UP) == before


def test_cosines_are_counted_not_paired(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 17 == 0 else rng.normal(size=3 if i % 23 == 0 else 5).tolist() if i % 4 else [1.0, 0.0, 0.0, 0.0, 0.0], None if i % 19 == 0 else i % 3) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    for block in (32 << 20, 200):
        monkeypatch.setattr(retrieval, "ASK_BYTES", block)
        df = retrieval.cosine_quantiles(v.filter("id % 10 = 0"), v, [0.0, 0.5, 0.95])
        got = {r["same"]: (r["n"], *(round(r[f"q{i}"], 9) for i in range(3))) for r in df.collect()}
        assert max(n for name, n in ran(df) if "Map" in name or "Join" in name or "Aggregate" in name) < 3000
        cos = {}
        for a, x, la in rows[::10]:
            for b, y, lb in rows:
                if a != b:
                    c = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) if x and y and len(x) == len(y) else 0.0
                    cos.setdefault(None if la is None or lb is None else la == lb, []).append(c)
        assert got == {k: (len(x), *(round(float(np.quantile(x, p)), 9) for p in (0.0, 0.5, 0.95))) for k, x in cos.items()}


def test_similar_sets_are_counted_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = {i: {int(m) for m in rng.choice(40, rng.integers(1, 12), replace=False)} for i in range(60)}
    monkeypatch.setattr(graph, "PASS_PAIRS", 500), monkeypatch.setattr(graph, "PASS_ROWS", 50)
    df = graph.jaccard(spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "item long, member long"), 0.1)
    got = {(r["a"], r["b"]): (r["inter"], round(r["score"], 9)) for r in df.collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.1 * len(sets[a] | sets[b])}
    assert not [x for x in ran(df) if "Exchange" in x[0]]


def test_labels_move_and_edges_stay(spark, monkeypatch):
    """Rounds in several passes give what one gives; edges lie bucketed by their far end, once."""
    rng = np.random.default_rng(6)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a != b}
    both = spark.createDataFrame([x for a, b in pairs for x in ((a, b), (b, a), (a, b))], "node long, other long")
    near, label = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    label = {a: min(x) for a, x in near.items()}
    for _ in range(3):
        votes = {a: [label[b] for b in x] for a, x in near.items()}
        label = {a: min(set(x), key=lambda c, x=x: (-x.count(c), c)) for a, x in votes.items()}
    for rows in (1 << 23, 10):
        monkeypatch.setattr(graph, "PASS_ROWS", rows)
        assert dict(map(tuple, graph.label_propagation(both, 4).collect())) == label
    edges = graph.bucketed(both, "other", 10, "edges-of-a-test")
    df = edges.join(both.select(F.col("other")).distinct().hint("shuffle_hash"), "other")
    assert edges.count() == 2 * len({frozenset(p) for p in pairs}) and df.count() == edges.count()


def test_probe_counts_served_episodes(spark, tmp_path, monkeypatch):
    """The pairs of lines that serve asks are joined from the asked parts' lines, not out of all pairs of parts."""
    lines = [(o, p) for o, parts in enumerate([(100, 7), (100, 100, 8), (200, 100), (5, 6), (300, 9)]) for p in parts]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "") for i in (0, 100, 200, 300, 5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spark.createDataFrame([(100, 100), (100, 8), (200, 5), (300, 300)], "ask long, id long")
    monkeypatch.setattr(maintenance, "_recall", lambda *_: got)
    monkeypatch.setattr(tables, "pairs", lambda *_: 1 / 0)
    assert tuple(registry.QUERIES["OP-26"](spark, str(tmp_path)).first()) == (4, 2, 1, 0.5, 0.25)
