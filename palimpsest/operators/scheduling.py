"""The maintenance scheduler: health in one row, a scored decision, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r), F.lit(True))
    return out


#: Health thresholds of the critical conditions: fixed values. Shares of small populations mean nothing.
LEAST_POPULATION, LEAST_PARITY, MOST_ORPHANS = 20, 0.8, 0.3


def critical_conditions(health: DataFrame) -> DataFrame:
    """One row, conditions: what calls for an operation out of turn (OP-S).

    health: one row of expected (texts that should have vectors), parity, nodes, orphans, unlinked (episodes without a
    session). Null metrics meet no condition.
    """
    met = F.array(
        F.when(F.col("unlinked") > 0, F.lit("missing_backbone_links")),
        F.when((F.col("expected") >= LEAST_POPULATION) & (F.col("parity") < LEAST_PARITY), F.lit("vector_parity")),
        F.when((F.col("nodes") >= LEAST_POPULATION) & (F.col("orphans") > MOST_ORPHANS), F.lit("orphan_share")),
    )
    return health.select(F.array_compact(met).alias("conditions"))


def scored(candidates: DataFrame, floor: float = 0.5, demoted: float = 0.5, starvation: int = 8, free_ms: float = 1000.0, decades: int = 3, dearest: float = 2.0) -> DataFrame:
    """Candidates with their urgency: relevance, weighed down if ineffective, up by waiting, divided by cost (OP-S).

    candidates: operation, answers, relevance, effectiveness, waiting, runs, mean_ms. Without a record an operation is
    unmeasured: full weight, no waiting, no cost. Waiting multiplies, so what has no work never starves.
    """
    weight = F.when(F.col("effectiveness") < floor, demoted).otherwise(1.0)
    boost = 1 + F.greatest(F.coalesce("waiting", F.lit(0)), F.lit(0)) / starvation
    dear = F.least(F.lit(float(decades)), F.log10(F.col("mean_ms") / free_ms))
    cost = F.when(F.col("mean_ms") > free_ms, 1 + dear / decades * (dearest - 1)).otherwise(1.0)
    return candidates.withColumn("urgency", F.col("relevance") * weight * boost / cost)


def decide(candidates: DataFrame, conditions: DataFrame, threshold: float = 0.2, floor: float = 0.5, grace: int = 3, advisor: bool = True) -> DataFrame:
    """One row, operation, tier, urgency: what the scheduler does next (OP-S).

    Tier 1: of the operations that answer a critical condition and have work, the most relevant, as long as it is within
    its grace, unmeasured or effective. Tier 2: the most urgent at or above the threshold. Else the advisor (tier 3) or
    nothing (a null tier). Ties go to the longer waiting, then to the name. candidates: as scored() gives; conditions:
    as critical_conditions() gives.
    """
    c = candidates.join(F.broadcast(conditions), F.lit(True))  # one row
    earned = (F.coalesce("runs", F.lit(0)) < grace) | F.coalesce(F.col("effectiveness") >= floor, F.lit(True))
    critical = F.array_contains("conditions", F.col("answers")) & earned
    tier = F.when(F.col("relevance") > 0, F.when(critical, 1).when(F.col("urgency") >= threshold, 2))
    c = c.withColumn("tier", tier).filter("tier is not null").withColumn("urgency", F.when(F.col("tier") == 1, F.col("relevance")).otherwise(F.col("urgency")))
    best = c.orderBy("tier", F.desc("urgency"), F.desc(F.coalesce("waiting", F.lit(0))), "operation").limit(1).select("operation", "tier", "urgency")
    none = F.lit(3) if advisor else F.lit(None).cast("int")
    return conditions.select(F.lit(1).alias("one")).join(F.broadcast(best), F.lit(True), "left").select("operation", F.coalesce("tier", none).alias("tier"), "urgency")


def guard(rows: DataFrame) -> DataFrame:
    """reject if degraded or without work, downgrade outside the allow-list, else accept (OP-S2)."""
    v = F.when(F.col("degraded") | ~F.col("has_work"), "reject").when(~F.col("allowed"), "downgrade").otherwise("accept")
    return rows.withColumn("verdict", v)
