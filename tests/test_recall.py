"""The recall of many asks, similar names and contained names, against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import names, recall, retrieval
from tests.test_operators import plain_activation


def cosine(a, b):
    if a is None or b is None:
        return 0.0
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def squash(name):
    return name.lower().translate(str.maketrans("", "", "-_./ "))


def overlap(a, b):
    """Of two names, as the survey has it: bigrams shared over those of the smaller name; 0 if too short or numbers differ."""
    x, y = squash(a), squash(b)
    if min(len(x), len(y)) < 4 or sorted(re.findall(r"\d+", a.lower())) != sorted(re.findall(r"\d+", b.lower())):
        return 0.0
    p, q = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (x, y))
    return len(p & q) / min(len(p), len(q))


WORDS = ["small ring", "Small  Ring", "small-ring", "small rings", "smal ring", "ring small", "gear 10", "gear 11", "gear 10s", "abc", "abcd", "abcde", "abcdf", "hot gear", "hotgear", "hot gears 2", "xy", "", "marble table", "marble tables", "marbel table", "aaaa", "aaaaaaa", "stone bridge over", "stone bridge ove", "1 2 gear", "12 gear"]


def test_related_names_are_all_pairs_that_overlap(spark):
    asks, known = [(i, n) for i, n in enumerate(WORDS)] + [(99, None)], [(100 + i, n) for i, n in enumerate(WORDS)] + [(100, "second name"), (500, None)]
    got = {(r["ask"], r["id"]): (r["relation"], round(r["overlap"], 9)) for r in names.related(spark.createDataFrame(asks, "ask long, name string"), spark.createDataFrame(known, "id long, name string")).collect()}
    want = {}
    for a, x in asks:
        for i, y in known:
            if x is None or y is None:
                continue
            fx, fy = " ".join(x.lower().split()), " ".join(y.lower().split())
            r = "fold" if fx == fy else "squash" if squash(fx) == squash(fy) else "bigram" if overlap(fx, fy) >= 0.85 else None
            if r:
                want[a, i] = (r, 1.0 if r != "bigram" else round(overlap(fx, fy), 9))
    assert got == want and {"fold", "squash", "bigram"} == {r for r, _ in want.values()}


@pytest.mark.parametrize("floor", [0.5, 0.85])
def test_similar_shapes_lose_no_pair(spark, floor):
    rnd = random.Random(3)
    some = list({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(4, 12))) for _ in range(150)})
    got = {(r["a"], r["b"]) for r in names.similar_shapes(names.shapes(spark.createDataFrame([(n,) for n in some], "name string")), None, floor).collect()}
    assert {frozenset(p) for p in got} == {frozenset((x, y)) for x in some for y in some if x < y and overlap(x, y) >= floor - 1e-12}
    assert names.similar_shapes(names.shapes(spark.createDataFrame([], "name string"))).collect() == []


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_contained_names(spark, block):
    texts = [(1, "The Small Ring and its smallring"), (2, "nothing"), (3, None), (4, ""), (5, "ringing SMALL RINGS été"), (6, "Été")]
    subjects = [(1, "small ring"), (2, "ring"), (3, "in"), (4, None), (5, ""), (6, "été"), (7, "Ring"), (2, "nothing")]
    got = {tuple(r) for r in names.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(subjects, "subject long, name string"), block_bytes=block).collect()}
    assert got == {(i, s) for i, t in texts for s, n in subjects if t and n and len(n) >= 3 and n.lower() in t.lower()}
    assert names.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "subject long, name string")).collect() == []


def plain_recall(ask, vec, text, name, memory, edges, old, limits, budget):
    """One ask through all steps, with lists and dictionaries."""
    by_id = {m[0]: m for m in memory}
    best = lambda found: sorted(found, key=lambda x: (-x[1], x[0]))[: limits.leg]
    words = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    legs = {"vector": best([(i, cosine(vec, m[1])) for i, m in by_id.items() if vec is not None and cosine(vec, m[1]) >= limits.vector_least])}
    docs = {i: words(m[2]) for i, m in by_id.items()}
    held = [w for w in docs.values() if w]
    mean = sum(map(len, held)) / max(1, len(held))
    scores = Counter()
    for w in set(words(text)):
        df = sum(w in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(w):
                scores[i] += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    legs["bm25"] = best(scores.items())
    top = legs["bm25"][0][1] if legs["bm25"] else 1
    legs["bm25"] = [(i, s / top) for i, s in legs["bm25"]]
    entity = {}
    for i, m in by_id.items():
        if name is None or m[3] is None:
            continue
        fx, fy = " ".join(name.lower().split()), " ".join(m[3].lower().split())
        if fx == fy:
            entity[i] = 1.0
        elif squash(fx) == squash(fy):
            entity[i] = 0.7
        elif overlap(fx, fy) >= 0.85:
            entity[i] = 0.7 * overlap(fx, fy)
    legs["entity"] = best(entity.items())
    latest = sorted(by_id, key=lambda i: (-by_id[i][4], i))[: limits.leg]
    legs["recency"] = [(i, 1 / (k + 1)) for k, i in enumerate(latest)]
    score = {}
    for found in legs.values():
        for i, s in found:
            score[i] = max(score.get(i, 0), s)
    chosen = []
    for leg, part in limits.shares.items():
        chosen += [i for i, _ in sorted(legs.get(leg, []), key=lambda x: (-x[1], x[0])) if i not in chosen][: int(limits.seeds * part)]
    for i in sorted(score, key=lambda i: (-score[i], i)):
        if len(chosen) < limits.seeds and i not in chosen:
            chosen.append(i)
    active, hops, path, proof, _ = plain_activation({i: score[i] for i in chosen}, edges, old, budget, retrieval.TYPED)
    active = {i: s for i, s in active.items() if s >= budget.least}
    lists = {"vector": [i for i, _ in legs["vector"]], "bm25": [i for i, _ in legs["bm25"]], "graph": sorted(active, key=lambda i: (-active[i], i))}
    fused, which = Counter(), {}
    for leg, ids in lists.items():
        for r, i in enumerate(ids):
            fused[i] += limits.lists[leg] / (61 + r)
            which.setdefault(i, []).append(leg)
    rows = []
    for i, s in fused.items():
        if i not in by_id:
            continue
        cos = cosine(vec, by_id[i][1])
        named = {leg: dict(legs[leg]).get(i) for leg in ("bm25", "entity", "recency")}
        exact = named["entity"] == 1.0 or (named["bm25"] is not None and len((text or "").strip()) >= 3 and text.strip().lower() in (by_id[i][2] or "").lower())
        kinds = (cos >= 0.33) + sum((named[leg] or 0) >= 0.33 for leg in ("bm25", "entity"))
        typed = proof.get(i, (0, 0))[1] if i in active else 0
        rule = "vector_floor" if cos >= 0.35 else "exact_match" if exact else "corroborated" if kinds >= 2 else "bm25_any" if named["bm25"] is not None else "typed_admission" if typed >= 0.14 and cos >= 0.33 else None
        if rule:
            rows.append((i, s * (0.5 if i in old else 1), rule, ",".join(sorted(which[i]))))
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))[: limits.pool]
    # clusters
    group = list(range(len(rows)))
    head = lambda i: (by_id[i][2] or "").strip(" ")[: limits.prefix].lower()
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            if by_id[x][5] == by_id[y][5] and ((head(x) and head(x) == head(y)) or cosine(by_id[x][1], by_id[y][1]) > limits.alike):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    count, kept = Counter(), []
    for r, g in zip(rows, group, strict=True):
        count[g] += 1
        if count[g] <= limits.per_cluster:
            kept.append(r)
    order, left = [], list(kept)
    while left:
        worth = [limits.trade * r[1] / kept[0][1] - (1 - limits.trade) * max((cosine(by_id[r[0]][1], by_id[o[0]][1]) for o in order), default=0) for r in left]
        order.append(left.pop(max(range(len(left)), key=lambda k: (worth[k], -k))))
    budget_left, used, seen, out = limits.tokens, Counter(), set(), []
    for r in order:
        m = by_id[r[0]]
        if m[6] <= budget_left and used[m[5]] < limits.caps.get(m[5], 0) and m[7] not in seen:
            budget_left -= m[6]
            used[m[5]] += 1
            seen.add(m[7])
            out.append((ask, r[0], len(out) + 1, m[5], pytest.approx(r[1]), r[2], r[3], hops.get(r[0]) if r[0] in active else None, path.get(r[0]) if r[0] in active else None))
    return out


def test_recall_of_many_asks_is_that_of_each(spark):
    rnd = random.Random(12)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    said = lambda n: " ".join(rnd.choice(["tide", "stone", "lamp", "reed", "moss", "fern", f"w{rnd.randrange(60)}"]) for _ in range(n))
    memory = []
    for i in range(60):
        near = rnd.choice(memory)[1] if i > 20 and rnd.random() < 0.3 else None
        memory.append((i, None if i == 7 else [x + rnd.gauss(0, 0.05) for x in near] if near else vec(), None if i == 9 else said(rnd.randrange(1, 12)), rnd.choice(WORDS[:6] + [None]), rnd.randrange(40), rnd.choice(["facts", "episodes", "narratives", "none"]), rnd.randrange(1, 30), rnd.randrange(25)))
    edges = []
    for _ in range(150):
        a, b = rnd.sample(range(60), 2)
        t, s, c = rnd.choice(["CO_OCCURS", "SIMILAR", "CONTRADICTS", "CAUSES"]), rnd.choice([0.05, 0.6, 1.0]), rnd.choice([0.5, 1.0])
        edges += [(a, b, t, s, c), (b, a, t, s, c)]
    edges, old = list(dict.fromkeys(edges)), set(rnd.sample(range(60), 8))
    limits, budget = recall.Limits(leg=8, seeds=10, pool=12, tokens=90, caps={"facts": 3, "episodes": 2, "narratives": 2}), retrieval.Budget(visited=25, neighbours=5)
    asks = [(k, [x + rnd.gauss(0, 0.3) for x in memory[k * 5][1] or vec()], said(4), rnd.choice(WORDS[:6])) for k in range(8)] + [(90, None, None, None), (91, vec(), "", "none like it")]
    got = recall.recall(
        spark.createDataFrame(asks, "ask long, vec array<double>, text string, name string"), spark.createDataFrame(memory, "id long, vec array<double>, text string, name string, at long, bucket string, tokens long, episode long"),
        spark.createDataFrame(edges, "node long, other long, type string, strength double, confidence double"), spark.createDataFrame([(x,) for x in old], "node long"), limits, budget,
    )
    rows = sorted(tuple(r) for r in got.select("ask", "id", "place", "bucket", "score", "rule", "legs", "hops", "path").collect())
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    want = sorted((r for a in asks for r in plain_recall(*a, memory, edges, old, limits, budget)), key=lambda r: r[:2])
    assert rows == want and len({r[0] for r in want}) > 7 and len({r[5] for r in want}) > 2
    assert got.filter(F.col("ask") < 0).count() == 0


def test_recall_of_nothing(spark):
    asks = spark.createDataFrame([], "ask long, vec array<double>, text string, name string")
    memory = spark.createDataFrame([], "id long, vec array<double>, text string, name string, at long, bucket string, tokens long, episode long")
    edges = spark.createDataFrame([], "node long, other long, type string, strength double, confidence double")
    assert recall.recall(asks, memory, edges, spark.createDataFrame([], "node long")).collect() == []
