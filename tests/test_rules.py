"""Rules of writes, intentions and retrieval on small tables, against what they must give."""

from __future__ import annotations

import datetime as dt
import random

from palimpsest.operators import bitemporal, entities, graph, intentions, retrieval, upkeep

D = dt.datetime


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_intentions_trigger_by_kind_before_score(spark):
    rnd = random.Random(2)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    some = [(i, rnd.choice([None, 100, 101, 102, 103]), rnd.choice([None, None, D(2024, 1, 1), D(2025, 1, 1)]), rnd.choice([None, vec(), vec()])) for i in range(60)]
    asks = [(k, vec()) for k in range(6)]
    active = [(k, n) for k in range(6) for n in (100, 101, 102) if rnd.random() < 0.3]
    served = [(k, i) for k in range(6) for i in range(60) if rnd.random() < 0.1]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {}
    for k, c in asks:
        found = []
        for i, subject, after, v in some:
            if (k, i) in served:
                continue
            if (k, subject) in active:
                found.append((0, -1.0, i))
            elif after and after <= D(2024, 6, 1):
                found.append((1, -1.0, i))
            elif v and cos(v, c) >= 0.5:
                found.append((2, -cos(v, c), i))
        want |= {(k, p): (i, intentions.KINDS[kind], round(-s, 9)) for p, (kind, s, i) in enumerate(sorted(found)[:26], 1)}
    got = intentions.triggered(
        spark.createDataFrame(some, "id long, subject long, after timestamp, vec array<double>"), spark.createDataFrame(asks, "ask long, vec array<double>"), spark.createDataFrame(active, "ask long, node long"), "2024-06-01", 0.5, 26, spark.createDataFrame(served, "ask long, id long")
    )
    assert {(r["ask"], r["place"]): (r["id"], r["kind"], round(r["score"], 9)) for r in got.collect()} == want
    assert {x[1] for x in want.values()} == set(intentions.KINDS)


def test_upserts_follow_merges_and_reopen(spark):
    known = [("ada", 1, 2, False), ("bo", 2, 3, False), ("cy", 3, None, True), ("di", 4, None, False)]
    seen = [("Ada",), ("ada ",), ("BO",), ("Di",), ("new",), ("New",), (None,)]
    got = {r["name_norm"]: (r["id"], r["action"], r["n"]) for r in entities.upsert(spark.createDataFrame(seen, "name string"), spark.createDataFrame(known, "name_norm string, id long, merged_into long, closed boolean")).collect()}
    assert got["ada"] == ("3", "reopened", 2) and got["bo"] == ("3", "reopened", 1) and got["di"] == ("4", "found", 1)
    assert got["new"][1:] == ("created", 2) and len(got["new"][0]) == 64 and len(got) == 4


def test_edges_begin_anew_after_they_were_closed(spark):
    o = [("a", 1, 0.5, False), ("a", 2, None, True), ("a", 3, 0.2, False), ("a", 4, 0.1, False), ("b", 1, 0.3, False), ("b", 2, 0.3, False), ("b", 3, None, True), ("c", 1, 0.05, False), ("d", 1, None, True), ("e", 1, 0.4, False), ("e", 2, None, True), ("e", 3, 0.2, False), ("e", 4, None, True)]
    got = {r["k"]: (round(r["strength"], 6), r["n"], r["closed"]) for r in entities.reopened_steps(spark.createDataFrame(o, "k string, at int, eta double, closes boolean"), ["k"], ["at"]).collect()}
    assert got == {"a": (0.28, 2, False), "b": (0.51, 2, True), "c": (0.1, 1, False), "e": (0.2, 1, True)}


def test_unsupersede_keeps_the_lineage_edge_in_the_past(spark):
    claims = [(1, 2, D(2024, 1, 1), D(2024, 1, 2)), (3, 4, D(2024, 1, 1), D(2024, 1, 2)), (5, 6, D(2024, 1, 1), D(2024, 1, 2))]
    undone = [(1, D(2024, 1, 5)), (1, D(2024, 1, 3)), (3, D(2024, 1, 1))]
    got = rows(bitemporal.unsupersede(spark.createDataFrame(claims, "id long, superseded_by long, valid_until timestamp, superseded_at timestamp"), spark.createDataFrame(undone, "id long, at timestamp")))
    assert got == [(1, None, None, 2, D(2024, 1, 2), D(2024, 1, 3)), (3, 4, D(2024, 1, 1), 4, D(2024, 1, 2), None), (5, 6, D(2024, 1, 1), 6, D(2024, 1, 2), None)]


def test_narratives_of_versions(spark):
    turns = [(1, v, t, f"line {t}\nmore") for v in (1, 2) for t in range(3 if v == 1 else 7)]
    got = sorted((r["version"], r["chunk"], r["body"], r["first_turn"], r["last_turn"], r["superseded"]) for r in upkeep.narratives(spark.createDataFrame(turns, "conv_id long, version int, turn int, text string"), 3).collect())
    assert got == [(1, 1, "line 0 / line 1 / line 2", 0, 2, True), (2, 1, "line 0 / line 1 / line 2", 0, 2, False), (2, 2, "line 3 / line 4", 3, 4, False), (2, 3, "line 5 / line 6", 5, 6, False)]


def test_pair_signals(spark):
    m = [(1, 10, D(2024, 1, 1)), (2, 10, D(2024, 1, 3)), (1, 11, D(2024, 1, 1)), (3, 12, D(2024, 1, 9)), (2, 10, D(2024, 1, 3))]
    both = [(10, 20), (10, 21), (11, 20), (12, 22), (10, 20)]
    got = rows(graph.pair_signals(spark.createDataFrame([(10, 11), (10, 12), (10, 99), (10, 11)], "a long, b long"), spark.createDataFrame(m, "episode long, entity long, at timestamp"), spark.createDataFrame(both, "node long, other long")))
    assert got == [(10, 11, 1, 0.5, 1, 0.5, 0.0, 2, 1), (10, 12, 0, 0.0, 0, 0.0, 6.0, 2, 1)]


def test_contradiction_candidates_in_tiers(spark):
    from pyspark.sql import functions as F

    claims = [(1, 7, "x", D(2024, 1, 1)), (2, 7, "y", D(2024, 1, 2)), (3, 7, "x", D(2024, 1, 3)), (4, 7, "x", D(2024, 1, 4)), (5, 8, "x", D(2024, 1, 1))]
    vecs = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [0.9, 0.1]), (4, [1.0, 0.05])]
    v = spark.createDataFrame(vecs, "id long, vec array<double>")
    got = rows(entities.contradiction_candidates(spark.createDataFrame(claims, "id long, subject long, aspect string, at timestamp"), F.col("id") == 4, v.filter("id = 4"), v, 3))
    assert got == [(4, 1, 2), (4, 2, 2), (4, 3, 1)]
    got = rows(entities.contradiction_candidates(spark.createDataFrame(claims[:1] + claims[3:], "id long, subject long, aspect string, at timestamp"), F.col("id") == 4, v.filter("id = 4"), v, 3))
    assert got == [(4, 1, 1), (4, 5, 3)]


def test_resonance_leaves_the_first_pass_out(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)] + [(20, [-1.0, 0.0])], "id long, vec array<double>")
    first = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.5), (2, 20, 1.0)], "ask long, id long, weight double")
    got = retrieval.resonance(first, v, 2, 2).collect()
    assert sorted((r["ask"], r["id"]) for r in got) == [(1, 1), (1, 4)]


def test_intake_parts_good_lines_from_bad_ones(spark, tmp_path):
    from palimpsest.sources import intake

    def line(session, *turns):
        import json

        return json.dumps({"session_id": session, "lane": "bulk", "turns": [{"role": r, "text": t} for r, t in turns]})

    good = [line("a", ("user", "hi")), line("b", ("user", "token = abcdefgh1"), ("assistant", "ok")), line("a", ("user", "hi"))]
    bad = ["{", "", '{"turns": []}', line("c"), line("d", ("user", None)), "[1]"]
    box, out, state = (str(tmp_path / x) for x in ("box", "out", "state"))

    def run(lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(box)
        intake.take_in(spark.readStream.text(box), out, state).awaitTermination()
        return [sorted(r[0] for r in spark.read.parquet(f"{out}/{x}").select(c).collect()) for x, c in (("stored", "session_id"), ("quarantine", "reason"))]

    stored, held = run(good + bad)
    assert stored == ["a", "b"] and held == ["bad-turn", "no-session", "no-turns", "not-json", "not-json", "not-json"]
    assert "abcdefgh1" not in str(spark.read.parquet(f"{out}/stored").collect())
    assert run(good)[0] == ["a", "b"], "a replay stores nothing"
    assert run([line("c", ("user", "now right"))])[0] == ["a", "b", "c"]
