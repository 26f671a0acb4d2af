"""Intentions: which of them an ask triggers, and why others don't run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import retrieval, staging

KINDS = ("entity", "temporal", "situation")


def triggered(intentions: DataFrame, contexts: DataFrame, activated: DataFrame, now: str, floor: float, limit: int, exclude: DataFrame | None = None) -> DataFrame:
    """(ask, id, kind, score, place): the first condition that each intention meets for an ask, limit of an ask (RET-22).

    intentions: id, subject, after, vec. contexts: ask, vec (the centroid of what was activated). activated: ask, node.
    exclude: ask, id of what the search has served already; it is left out before the limit.

    An activated subject goes before a date that has come, this before a near situation, whatever the scores. Subjects are
    an equi join. Dates hold for every ask alike, so the first limit of those that an ask has no other place for are
    enough, and situations are a search of the nearest; no ask is paired with all intentions.
    """
    gone = exclude if exclude is not None else contexts.select("ask", F.lit(None).cast("long").alias("id")).filter("false")
    gone = staging.stage(gone.select("ask", "id").distinct(), "served")
    most = (gone.groupBy("ask").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) + limit
    entity = activated.join(intentions.select("id", F.col("subject").alias("node")), "node").select("ask", "id", F.lit(0).alias("k"), F.lit(1.0).alias("score")).distinct()
    entity = staging.stage(entity.join(gone, ["ask", "id"], "left_anti"), "by-entity")
    # an ask's entities may hold limit of the dates' places too
    due = intentions.filter(F.col("after") <= F.to_timestamp(F.lit(now))).select("id").orderBy("id").limit(most + limit)
    dated = contexts.select("ask").distinct().join(F.broadcast(due)).select("ask", "id", F.lit(1).alias("k"), F.lit(1.0).alias("score"))
    near = retrieval.knn(contexts.select(F.col("ask").alias("id"), "vec"), intentions.filter("vec is not null").select("id", "vec"), 2 * (most + limit), floor, skip_self=False)
    situation = near.select("ask", "id", F.lit(2).alias("k"), "score")
    best = entity.unionByName(dated).unionByName(situation).join(gone, ["ask", "id"], "left_anti").groupBy("ask", "id").agg(F.min("k").alias("k"), F.max_by("score", -F.col("k")).alias("score"))
    w = Window.partitionBy("ask").orderBy("k", F.desc("score"), "id")
    found = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    return found.select("ask", "id", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1).alias("kind"), "score", "place")
