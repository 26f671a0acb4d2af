"""Queues as event-sourced tables: order, depth, claims, bursts, chunks and the reinforcement fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def depth(queue: DataFrame, most_attempts: int) -> DataFrame:
    """depth, oldest and exhausted of each lane (AGG-11)."""
    return queue.groupBy("lane").agg(F.count(F.lit(1)).alias("depth"), F.unix_micros(F.min("enqueued_at")).alias("oldest"), F.count_if(F.col("attempts") >= most_attempts).alias("exhausted"))


def sequenced(queue: DataFrame) -> DataFrame:
    """lane_seq: the place of a job among those of its lane and session (WIN-3)."""
    return queue.withColumn("lane_seq", F.row_number().over(Window.partitionBy("lane", "session_id").orderBy("enqueued_at", "id")))


def claim_order(queue: DataFrame, lanes: list[str]) -> DataFrame:
    """Lanes by rank, then one job of each session at a time, then age."""
    rank = F.array_position(F.array(*map(F.lit, lanes)), F.col("lane"))
    return sequenced(queue).withColumn("lane_rank", rank).orderBy("lane_rank", "lane_seq", "enqueued_at", "id")


def state(events: DataFrame) -> DataFrame:
    """The current state of each job of an append-only log (STR-S8): job, last event, attempts. events: job, event, at, seq."""
    last = F.max(F.struct("at", "seq", "event")).alias("l")
    return events.groupBy("job").agg(last, F.count_if(F.col("event") == "release").alias("attempts")).select("job", F.col("l.event").alias("event"), F.col("l.at").alias("at"), "attempts")


def leases(events: DataFrame, now: Column, stale_minutes: int = 10, most_attempts: int = 5) -> DataFrame:
    """Jobs that aren't done: job, state (held, waiting, dead), attempts (STR-S8). events: as in state().

    A claim older than stale_minutes returns to the pool without counting as an attempt, each release counts as one,
    and a job that was released most_attempts times is never claimed again.
    """
    fresh = (F.col("event") == "claim") & (F.col("at") >= now - F.make_dt_interval(mins=F.lit(stale_minutes)))
    v = F.when(fresh, "held").when(F.col("attempts") >= most_attempts, "dead").otherwise("waiting")
    return state(events).filter("event <> 'done'").select("job", v.alias("state"), "attempts")


def newest(rows: DataFrame, by: list[str], cap: int, order: list) -> DataFrame:
    """A bounded queue that drops its oldest rows beyond cap (STR-S9)."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("back") <= cap).drop("back")


def whole_bursts(bursts: DataFrame, by: list[str], batch: int) -> DataFrame:
    """Bursts oldest first while the rows before them are fewer than batch (STR-S10). bursts: by, burst, lo, n."""
    w = Window.partitionBy(*by).orderBy("lo", "burst").rowsBetween(Window.unboundedPreceding, -1)
    return bursts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("before") < batch)


def balanced_chunks(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Contiguous chunks of at most so many rows whose sizes differ by one at most (WIN-10)."""
    w = Window.partitionBy(by)
    k, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    n = rows.withColumns({"k": k, "r": r}).withColumn("chunks", F.ceil(F.col("k") / most))
    n = n.withColumns({"small": F.floor(F.col("k") / F.col("chunks")), "wide": F.col("k") % F.col("chunks")})
    edge = F.col("wide") * (F.col("small") + 1)
    chunk = F.when(F.col("r") <= edge, F.floor((F.col("r") - 1) / (F.col("small") + 1)) + 1).otherwise(F.col("wide") + F.floor((F.col("r") - 1 - edge) / F.col("small")) + 1)
    return n.select(by, order, chunk.cast("long").alias("chunk"))


def reinforcement_fold(members: DataFrame, rate: float) -> DataFrame:
    """src < dst, eta: each burst gives a pair 1 / (size - 1), a pair's sum is cut at 1 (AGG-12). members: episode, entity."""
    size = members.groupBy("episode").agg(F.count(F.lit(1)).alias("k"))
    a, b = members.withColumnRenamed("entity", "src"), members.withColumnRenamed("entity", "dst")
    p = a.join(b, "episode").filter("src < dst").join(size, "episode")
    return p.groupBy("src", "dst").agg((F.lit(rate) * F.least(F.lit(1.0), F.sum(1 / (F.col("k") - 1)))).alias("eta"))
