"""Operators on small tables: what the star-schema queries don't reach."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import bitemporal, entities, graph, queues, retrieval
from palimpsest.operators.bitemporal import ReadMode
from palimpsest.operators.components import components
from palimpsest.sources import intake
from palimpsest.streaming import sessions

D = dt.datetime


def test_read_modes(spark):
    rows = [
        ("old", D(2024, 1, 1), D(2024, 2, 1), D(2024, 1, 2), D(2024, 2, 2), None, None),
        ("new", D(2024, 2, 1), None, D(2024, 2, 2), None, None, D(2024, 3, 1)),
        ("gone", D(2024, 1, 1), None, D(2024, 1, 1), None, D(2024, 1, 5), None),
    ]
    n = spark.createDataFrame(rows, "id string, valid_from timestamp, valid_until timestamp, tx_from timestamp, tx_until timestamp, forgotten_at timestamp, valid_horizon timestamp")
    read = lambda **m: {r["id"]: r["currency"] for r in bitemporal.read(n, ReadMode(**m), "2024-03-01").collect()}
    assert read() == {"old": "superseded", "new": "expired"}
    assert read(as_of="2024-02-01") == {"new": "current", "gone": "current"}  # the end is not inside
    assert read(knew_at="2024-02-01 12:00:00").keys() == {"old", "gone"}
    assert read(as_of="2024-01-15", knew_at="2024-02-10").keys() == {"gone"}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got.keys() == {x for a, b in edges if a != b for x in (a, b)}
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in got)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).collect() == []


def test_lineage_stops_at_eight(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "node long, next long")
    got = {r["node"]: (r["head"], r["depth"]) for r in graph.lineage_head(links, 8).collect()}
    assert got[0] == (8, 8) and got[15] == (20, 5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=6))
def test_bounded_steps_closed_form(spark, etas):
    w = max(etas[0], 0.1)
    for e in etas[1:]:
        w += e * (1 - w)
    got = entities.bounded_steps(spark.createDataFrame([(1, i, e) for i, e in enumerate(etas)], "k int, i int, eta double"), ["k"], ["i"]).first()
    assert got["strength"] == pytest.approx(w, abs=1e-9) and got["n"] == len(etas)


def test_packing_passes_over_what_does_not_fit(spark):
    rows = [(1, 1, 0.9, "f", 1, 60), (1, 2, 0.8, "f", 2, 60), (1, 3, 0.7, "f", 3, 30), (1, 4, 0.6, "f", 1, 5), (1, 5, 0.5, "e", 5, 10)]
    got = retrieval.pack(spark.createDataFrame(rows, "pack long, id long, score double, bucket string, episode long, tokens long"), 100, {"f": 2, "e": 1}).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 3, 5]


def test_admission_precedence(spark):
    rows = [("v", "vector", 1, 0.4, False, None), ("x", "bm25", 1, 0.1, True, None), ("c", "bm25", 1, 0.34, False, None), ("c", "name", 2, 0.34, False, None), ("b", "bm25", 1, 0.1, False, None), ("n", "vector", 1, 0.1, False, 0.9), ("t", "vector", 1, 0.34, False, 0.14)]
    got = {r["id"]: r["rule"] for r in retrieval.admit(spark.createDataFrame(rows, "id string, method string, cue int, relevance double, exact boolean, contribution double")).collect()}
    assert got == {"v": "vector_floor", "x": "exact_match", "c": "corroborated", "b": "bm25_any", "n": "none", "t": "typed_admission"}


def test_activation_decays_over_hops(spark):
    e = [(1, 2), (2, 3), (3, 4)]
    both = spark.createDataFrame([(a, b, "CO_OCCURS", 1.0, 1.0) for x, y in e for a, b in ((x, y), (y, x))], "node long, other long, type string, strength double, confidence double")
    seeds = spark.createDataFrame([(1, 1.0)], "node long, score double")
    found, why = retrieval.activate(seeds, both, spark.createDataFrame([(3,)], "node long"), retrieval.Budget(hops=2))
    got = {r["node"]: r for r in found.collect()}
    assert why == "hop_limit" and got.keys() == {1, 2, 3}
    assert got[2]["hops"] == 1 and got[2]["score"] == pytest.approx(0.56) and got[2]["path"] == "1 -[CO_OCCURS]-> 2"
    assert got[3]["hops"] == 2 and got[3]["score"] == pytest.approx(0.56**2 / 2) and got[3]["superseded"] and got[3]["path"] == "1 -[CO_OCCURS]-> 2 -[CO_OCCURS]-> 3"


def plain_activation(seeds, edges, superseded, budget, typed):
    """One node after another, with dictionaries."""
    degree, near = {}, {}
    for a, b, t, s, c in edges:
        degree[a] = degree.get(a, 0) + 1
        if s >= budget.strength:
            near.setdefault(a, []).append((-s, b, t, c))
    score, hops, path, best, proof = dict(seeds), dict.fromkeys(seeds, 0), {x: str(x) for x in seeds}, {}, {}
    waiting, seen, rounds = set(seeds), set(), 0
    while True:
        if rounds >= budget.rounds:
            return score, hops, path, proof, "max_iterations"
        if len(seen) >= budget.visited:
            return score, hops, path, proof, "node_budget"
        if not waiting:
            return score, hops, path, proof, "frontier_exhausted"
        strong = sorted((x for x in waiting if score[x] >= budget.least), key=lambda x: (-score[x], x))
        if not strong:
            return score, hops, path, proof, "below_min_activation"
        ring = [x for x in strong if hops[x] < budget.hops][: budget.visited - len(seen)]
        if not ring:
            return score, hops, path, proof, "hop_limit"
        rounds, before = rounds + 1, set(seen)
        seen |= set(ring)
        waiting -= set(ring)
        for i, a in enumerate(ring):
            open_ = sorted(e for e in near.get(a, []) if e[1] not in before)[: budget.neighbours]
            for s, b, t, c in open_:
                if b in ring and ring.index(b) <= i:
                    continue
                w = {"SUPERSEDES": 1.0, "CO_OCCURS": 0.8, "SIMILAR": 0.6}.get(t, 0.5) * -s * (c if t == "SIMILAR" else 1)
                gain = score[a] * w * budget.decay * (1 if degree[b] <= 10 else 1 / (1 + 0.5 * math.log(1 + degree[b] - 10))) * (0.5 if b in superseded else 1)
                score[b] = score.get(b, 0) + gain
                if t in typed and gain > proof.get(b, (0, 0))[1]:
                    proof[b] = (t, gain)
                if b not in seeds and gain > best.get(b, 0):
                    best[b], hops[b], path[b] = gain, hops[a] + 1, f"{path[a]} -[{t}]-> {b}"
                    if b not in seen:
                        waiting.add(b)


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"visited": 7}), (3, {"hops": 2, "neighbours": 3}), (4, {"rounds": 2}), (5, {"least": 0.4})])
def test_activation_is_the_plain_one(spark, seed, more):
    rnd = random.Random(seed)
    edges = []
    for _ in range(90):
        a, b = rnd.sample(range(30), 2)
        t, s, c = rnd.choice(["CO_OCCURS", "SIMILAR", "CONTRADICTS", "SUPERSEDES"]), rnd.choice([0.05, 0.6, 0.9, 1.0]), rnd.choice([0.5, 1.0])
        edges += [(a, b, t, s, c), (b, a, t, s, c)]
    edges = list(dict.fromkeys(edges))
    seeds, old, budget = {rnd.randrange(30): 1.0, rnd.randrange(30): 0.8}, set(rnd.sample(range(30), 6)), retrieval.Budget(**more)
    score, hops, path, proof, why = plain_activation(seeds, edges, old, budget, retrieval.TYPED)
    found, ended = retrieval.activate(
        spark.createDataFrame(list(seeds.items()), "node long, score double"), spark.createDataFrame(edges, "node long, other long, type string, strength double, confidence double"), spark.createDataFrame([(x,) for x in old], "node long"), budget
    )
    got = {r["node"]: r for r in found.collect()}
    assert ended == why and got.keys() == {x for x in score if score[x] >= budget.least}
    for x, r in got.items():
        assert r["score"] == pytest.approx(score[x]) and (r["hops"], r["path"], r["superseded"]) == (hops[x], path[x], x in old)
        assert (r["typed_edge"], r["typed_gain"]) == (proof[x][0], pytest.approx(proof[x][1])) if x in proof else r["typed_edge"] is None


def test_many_asks_spread_as_each_does_alone(spark):
    """Asks share rounds, but each has its own frontier, budget, order and end."""
    from palimpsest.operators import activation

    rnd = random.Random(5)
    edges = []
    for _ in range(120):
        a, b = rnd.sample(range(40), 2)
        t, s, c = rnd.choice(["CO_OCCURS", "SIMILAR", "CONTRADICTS"]), rnd.choice([0.05, 0.6, 1.0]), rnd.choice([0.5, 1.0])
        edges += [(a, b, t, s, c), (b, a, t, s, c)]
    edges = list(dict.fromkeys(edges))
    asks = {k: {x: rnd.choice([0.05, 0.7, 1.0]) for x in rnd.sample(range(45), rnd.randrange(1, 5))} for k in range(12)}
    old, budget = {3, 9, 11}, retrieval.Budget(visited=14, neighbours=3)
    ready = activation.prepared(spark.createDataFrame(edges, "node long, other long, type string, strength double, confidence double"), spark.createDataFrame([(x,) for x in old], "node long"), budget)
    rows = [(k, x, s) for k, own in asks.items() for x, s in own.items()] + [(None, 1, 1.0), (3, None, 1.0)]
    found, ended = activation.spread(spark.createDataFrame(rows, "ask long, node long, score double"), ready, budget)
    got, why = {(r["ask"], r["node"]): r for r in found.collect()}, dict(map(tuple, ended.collect()))
    want = {}
    for k, own in asks.items():
        score, hops, path, proof, end = plain_activation(own, edges, old, budget, retrieval.TYPED)
        assert why[k] == end
        want |= {(k, x): (score[x], hops[x], path[x], proof.get(x)) for x in score if score[x] >= budget.least}
    assert got.keys() == want.keys() and len(set(why.values())) > 1
    for k, (score, hops, path, proof) in want.items():
        r = got[k]
        assert r["score"] == pytest.approx(score) and (r["hops"], r["path"]) == (hops, path) and (r["typed_edge"] == proof[0] if proof else r["typed_edge"] is None)
    none, over = activation.spread(spark.createDataFrame([], "ask long, node long, score double"), ready)
    assert none.collect() == [] and over.collect() == []


def test_lanes_count_arrivals_of_a_session_and_of_all(spark):
    rnd = random.Random(3)
    rates = sessions.Rates(window_us=5_000_000, session=6, everywhere=40, hot_session=2)
    rows = [(i, rnd.randrange(5), rnd.choice([0, 3_599_000_000, 7_200_000_000]) + rnd.choice([rnd.randrange(30_000_000), 5_000_000, 10_000_000]), rnd.choice(["bulk", "interactive", None, None, None])) for i in range(400)]
    got = {r["seq"]: tuple(r)[1:] for r in sessions.lanes(spark.createDataFrame(rows, "seq long, session long, us long, requested string").repartition(3), rates).collect()}
    seen = set()
    for i, s, us, asked in rows:
        near = [r for r in rows if us - rates.window_us < r[2] <= us]
        own = sum(r[1] == s for r in near)
        why = "requested" if asked == "bulk" else "session-rate" if own > 6 else "global-rate" if len(near) > 40 and own > 2 else "default"
        assert got[i] == (own, len(near), "interactive" if why == "default" else "bulk", why)
        seen.add(why)
    assert len(seen) == 4
    assert sessions.lanes(spark.createDataFrame([], "seq long, session long, us long, requested string")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact(spark, seed):
    import numpy as np

    from palimpsest.operators import quantiles

    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 1), 0.5, 1e6])) for _ in range(400)] + [("one", 3.0), ("a", None)]
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["k"]: r for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(3), "k", "x", shares).collect()}
    for k in ("a", "b", None, "one"):
        x = [v for g, v in rows if g == k and v is not None]
        assert got[k]["n"] == len(x) and [got[k][f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(x, shares).tolist())
    assert quantiles.quantiles(spark.createDataFrame([], "k string, x double"), "k", "x", shares).collect() == []


def test_replay_over_days_is_the_plain_fold(spark):
    rnd = random.Random(7)
    rows = [(u, D(2024, 1, rnd.randrange(1, 9), rnd.randrange(24)), i, rnd.choice(["view", "click", "purchase", "error", "other"])) for i, u in enumerate(rnd.choices([1, 1, 1, 2, 3], k=300))]
    got = {r["user_id"]: r for r in sessions.replay(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, event_type string").repartition(3)).collect()}
    for u in (1, 2, 3):
        w, n = 0.5, 0
        for _, _, _, kind in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2])):
            n += kind == "view"
            w = w + 0.1 * (1 - w) if kind in ("click", "purchase") else max(0.1, w * 0.95) if kind == "error" else w
        assert got[u]["weight"] == pytest.approx(w) and got[u]["accesses"] == n


def test_knn_odd_vectors_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [0.0, 1.0])], "id long, vec array<double>")
    got = sorted(tuple(r) for r in retrieval.knn(v.filter("id = 1"), v, 3).collect())
    assert got == [(1, 2, 1.0, 1), (1, 3, 1.0, 2), (1, 4, 0.0, 3)]


def test_cluster_cap_follows_links(spark):
    items = spark.createDataFrame([(i, float(i)) for i in range(8)], "id long, score double")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "u long, v long")
    assert sorted(r["id"] for r in retrieval.cluster_cap(items, links, 2).collect()) == [2, 3, 4, 5, 6, 7]


def test_knn_in_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    v = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(40)], "id long, vec array<double>")
    whole = sorted(tuple(r) for r in retrieval.knn(v.filter("id < 9"), v, 3).collect())
    monkeypatch.setattr(retrieval, "ASK_BYTES", 64)
    assert sorted(tuple(r) for r in retrieval.knn(v.filter("id < 9"), v, 3).collect()) == whole and len(whole) == 27
    # an ask scores by its own size, whatever the sizes of the asks beside it
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.9, 0.1]), (4, [0.9, 0.1, 0.0]), (5, None)], "id long, vec array<double>")
    got = {(r["ask"], r["id"]) for r in retrieval.knn(mixed, mixed, 1, 0.5).collect()}
    assert got == {(1, 3), (3, 1), (2, 4), (4, 2)}


def test_sessions_split_at_exactly_thirty_minutes(spark):
    t = D(2024, 1, 1)
    rows = [(1, t, 1), (1, t + dt.timedelta(minutes=29, seconds=59), 2), (1, t + dt.timedelta(minutes=59, seconds=59), 3)]
    got = sessions.sessionise(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")).orderBy("event_id").collect()
    assert [r["session"] for r in got] == [1, 1, 2]


def test_chunks_are_balanced(spark):
    got = queues.balanced_chunks(spark.createDataFrame([(1, i) for i in range(10)], "k int, i int"), "k", "i", 4).orderBy("i").collect()
    assert [r["chunk"] for r in got] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, key string")
    for _ in range(2):
        intake.append(rows, str(tmp_path / "store"), ["key"], "id")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "store")).select("key", "id").collect()) == [("a", 1), ("b", 2)]


def test_staged_tables_can_be_cleared(spark):
    import os

    from palimpsest.operators import staging

    df = staging.stage(spark.range(3), "test")
    path = df.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert os.path.exists(path)
    staging.clear(spark)
    assert not os.path.exists(path)


def test_broken_documents_are_told(spark):
    docs = intake.parse(spark.createDataFrame([('{"turns":[{"role":"user","text":"hi"}],"session_id":"s"}',), ("nonsense",), (None,)], "value string"))
    assert sorted(r["broken"] for r in docs.collect()) == [False, True, True]
    assert intake.shape(docs).first()["n_turns"] == 1


def test_streaming_matches_batch(spark, tmp_path):
    t = D(2024, 1, 1)
    e = spark.createDataFrame([(i, t + dt.timedelta(hours=7 * i), 1, "view") for i in range(20)], "event_id long, ts timestamp, user_id long, event_type string")
    e.write.parquet(str(tmp_path / "in"))
    out = sessions.run_once(sessions.tumbling_days(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))), "complete")
    assert sum(r["n"] for r in out.collect()) == 20 and out.count() == 6


def test_append_once_repeats_nothing(spark, tmp_path):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, key string")
    e.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = sessions.append_once(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["id"], str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_imports_without_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
