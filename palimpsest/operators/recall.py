"""Recall of many asks at once: legs, seeds, spreading activation, fusion, admission, clusters and a pack for each ask."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors, weights
from palimpsest.operators import names, retrieval, staging
from palimpsest.operators.activation import Budget, prepared, spread


@dataclass(frozen=True)
class Limits:
    """What bounds one ask: rows of a leg, seeds, items that are clustered and packed, and the pack itself."""

    leg: int = 32
    seeds: int = 32
    pool: int = 64
    shares: dict[str, float] = field(default_factory=lambda: {"vector": 0.25, "context": 0.10, "bm25": 0.20, "entity": 0.15, "recency": 0.10})
    lists: dict[str, float] = field(default_factory=lambda: {"vector": 0.4, "bm25": 0.3, "graph": 0.3})
    vector_least: float = 0.1
    alike: float = 0.95
    prefix: int = 16
    per_cluster: int = 2
    trade: float = 0.7
    tokens: int = 4000
    caps: dict[str, int] = field(default_factory=lambda: {"facts": 12, "episodes": 8, "narratives": 4})


def legs(asks: DataFrame, memory: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(ask, id, leg, score, relevance, exact): what each leg finds for each ask, limits.leg rows at most (RET-2 to RET-6).

    asks: ask, vec, text, name; memory: id, vec, text, name, at. A null vector, text or name finds nothing by its leg. The
    latest items are the same for every ask.
    """
    top = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= limits.leg).drop("r")
    near = retrieval.knn(asks.filter("vec is not null").select(F.col("ask").alias("id"), "vec"), memory.select("id", "vec"), limits.leg, limits.vector_least, skip_self=False)
    vector = near.select("ask", "id", F.lit("vector").alias("leg"), "score", F.col("score").alias("relevance"), F.lit(False).alias("exact"))
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    hits = retrieval.bm25(memory.select(F.col("id").alias("doc_id"), "text"), asks.select("ask", F.explode(words).alias("term")), best=limits.leg)
    hits = retrieval.normalise_to_best(staging.stage(hits.withColumnRenamed("doc_id", "id"), "bm25-leg"), ["ask"])
    phrase = names.contained(memory.select("id", "text"), asks.select(F.col("ask").alias("subject"), F.col("text").alias("name"))).select(F.col("subject").alias("ask"), "id", F.lit(True).alias("exact"))
    bm25 = hits.join(phrase, ["ask", "id"], "left").select("ask", "id", F.lit("bm25").alias("leg"), "score", F.col("score").alias("relevance"), F.coalesce("exact", F.lit(False)).alias("exact"))
    same = F.col("relation") == "fold"
    entity = top(names.related(asks.select("ask", "name"), memory.select("id", "name"), most=limits.leg).withColumn("score", F.when(same, 1.0).otherwise(F.col("overlap") * weights.ACTIVATION_DECAY)))
    entity = entity.select("ask", "id", F.lit("entity").alias("leg"), "score", F.col("score").alias("relevance"), same.alias("exact"))
    latest = memory.select("id", "at").orderBy(F.desc("at"), "id").limit(limits.leg)
    latest = latest.select("id", (1 / F.row_number().over(Window.orderBy(F.desc("at"), "id"))).alias("score"))  # of a leg's rows
    recency = asks.select("ask").join(F.broadcast(latest)).select("ask", "id", F.lit("recency").alias("leg"), "score", F.lit(0.0).alias("relevance"), F.lit(False).alias("exact"))
    return vector.unionByName(bm25).unionByName(entity).unionByName(recency)


def seeds(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(ask, node, score): each leg's share of an ask's seeds, then the best of the rest (RET-7, RET-8). found: as legs() gives.

    An ask's legs have limits.leg rows each, so its list is gone through in one group.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        best = rows.groupby("id").score.max()
        chosen = retrieval.reserve(rows, limits.seeds, limits.shares)
        return pd.DataFrame({"ask": rows.ask.iloc[0], "node": chosen.id, "score": best.loc[chosen.id].to_numpy()})

    return found.groupBy("ask").applyInPandas(choose, "ask long, node long, score double")


def clusters(rows: pd.DataFrame, vecs: list, limits: Limits) -> tuple[list[int], list[int]]:
    """Places of an ask's ranked items after each cluster of near duplicates has kept its best ones (RET-17), and their ranks
    in their clusters.

    Items of a bucket are alike if the first characters of their texts are equal, or by a cosine over limits.alike.
    """
    label = list(range(len(rows)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    size = max((len(v) for v in vecs if v is not None), default=1)
    m = np.array([v if v is not None and len(v) == size else np.zeros(size) for v in vecs], float).reshape(len(rows), -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    cos, bucket, head = m @ m.T, rows.bucket.to_list(), rows["head"].to_list()
    for i in range(len(rows)):
        for j in range(i):
            if bucket[i] == bucket[j] and ((head[i] and head[i] == head[j]) or cos[i, j] > limits.alike):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    held: dict[int, int] = {}
    kept, rank = [], []
    for i in range(len(rows)):
        r = root(i)
        held[r] = held.get(r, 0) + 1
        if held[r] <= limits.per_cluster:
            kept.append(i)
            rank.append(held[r])
    return kept, rank


def capped(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(ask, id, rank): the best of each cluster of near duplicates within each ask's list (RET-17).

    rows: ask, id, score, bucket, head, vec; a list is of bounded length.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        kept, rank = clusters(pdf, pdf.vec.to_list(), limits)
        return pd.DataFrame({"ask": pdf.ask.iloc[kept], "id": pdf.id.iloc[kept], "rank": rank})

    return rows.groupBy("ask").applyInPandas(run, "ask long, id long, rank int")


def packed(rows: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """One ask's pack: clusters are capped, the rest is put in order of marginal relevance and packed greedily (RET-18, RET-24)."""
    rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    rows = rows.iloc[clusters(rows, rows.vec.to_list(), limits)[0]].reset_index(drop=True)
    size = max((len(v) for v in rows.vec if v is not None), default=1)
    order = retrieval.mmr(rows, np.array([v if v is not None and len(v) == size else np.zeros(size) for v in rows.vec], float).reshape(len(rows), -1), limits.trade)
    left, used, seen, kept = limits.tokens, dict.fromkeys(limits.caps, 0), set(), []
    for i in order:
        r = rows.iloc[i]
        if r.tokens <= left and used.get(r.bucket, 0) < limits.caps.get(r.bucket, 0) and r.episode not in seen:
            left -= r.tokens
            used[r.bucket] += 1
            seen.add(r.episode)
            kept.append(i)
    out = rows.iloc[kept].copy()
    out["place"] = range(1, len(out) + 1)
    return out[["ask", "id", "place", "bucket", "score", "rule", "legs", "hops", "path"]]


def recall(asks: DataFrame, memory: DataFrame, edges: DataFrame, superseded: DataFrame, limits: Limits = Limits(), budget: Budget = Budget()) -> DataFrame:
    """(ask, id, place, bucket, score, rule, legs, hops, path): the pack of every ask.

    asks: ask, vec, text, name. memory: id, vec, text, name, at, bucket, tokens, episode. edges: node, other, type, strength,
    confidence, both ways. superseded: node.

    Every step is one plan over all asks. Legs send on their best rows only; the spread is activation.spread(). Ranked lists
    of vector, bm25 and graph are fused by reciprocal rank, half for superseded items. What was reached is measured against
    the ask's vector, then admitted by the first rule that holds. An ask's best limits.pool items are clustered, ordered
    and packed in one group. An ask in which nothing is admitted has no rows. Ties go to the smaller id; null vectors have
    cosine 0, null texts and names find nothing.
    """
    found = staging.stage(legs(asks, memory, limits), "recall-legs")
    active, _ = spread(seeds(found, limits), prepared(edges, superseded, budget), budget)
    active = staging.stage(active, "recall-active")
    lists = found.filter(F.col("leg").isin("vector", "bm25")).select("ask", "id", "leg", "score").unionByName(active.select("ask", F.col("node").alias("id"), F.lit("graph").alias("leg"), "score"))
    rank = F.row_number().over(Window.partitionBy("ask", "leg").orderBy(F.desc("score"), "id")) - 1
    weight = F.create_map(*[F.lit(x) for kv in limits.lists.items() for x in kv])[F.col("leg")]
    old = superseded.select(F.col("node").alias("id")).distinct().withColumn("old", F.lit(True))
    fused = lists.withColumn("rank", rank).groupBy("ask", "id").agg(F.sum(weights.rrf(F.col("rank"), weight)).alias("score"), F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("legs"))
    fused = fused.join(old, "id", "left").withColumn("score", F.col("score") * F.when(F.col("old"), weights.SUPERSEDED_FACTOR).otherwise(1.0)).drop("old")
    # what was reached is measured against its ask (RET-13): pairs, never all asks with all items
    measured = fused.select("ask", "id").join(memory.select("id", "vec"), "id").join(asks.select("ask", F.col("vec").alias("ask_vec")), "ask")
    measured = measured.select("ask", "id", F.lit("vector").alias("method"), F.coalesce(vectors.cosine(F.col("ask_vec"), F.col("vec")), F.lit(0.0)).alias("relevance"), F.lit(False).alias("exact"), F.lit(None).cast("double").alias("contribution"))
    by_leg = found.filter("leg <> 'vector'").select("ask", "id", F.col("leg").alias("method"), "relevance", "exact", F.lit(None).cast("double").alias("contribution"))
    by_edge = active.select("ask", F.col("node").alias("id"), F.lit("graph").alias("method"), F.lit(0.0).alias("relevance"), F.lit(False).alias("exact"), F.col("typed_gain").alias("contribution"))
    rules = retrieval.admit(measured.unionByName(by_leg).unionByName(by_edge).withColumn("cue", F.lit(0)), by=["ask", "id"]).filter("rule <> 'none'")
    best = fused.join(rules, ["ask", "id"]).withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= limits.pool).drop("r")
    items = best.join(memory.select("id", "vec", F.lower(F.substring(F.trim("text"), 1, limits.prefix)).alias("head"), "bucket", "tokens", "episode"), "id")
    items = items.join(active.select("ask", F.col("node").alias("id"), "hops", "path"), ["ask", "id"], "left")
    schema = "ask long, id long, place int, bucket string, score double, rule string, legs string, hops int, path string"
    return items.groupBy("ask").applyInPandas(lambda rows: packed(rows, limits), schema)
