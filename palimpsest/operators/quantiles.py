"""Exact quantiles of columns of any size, by counting bins first and sorting only the bins that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import staging

BINS = 4096


def quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, n, q0, q1, ...): each group's count and its quantiles, interpolated between neighbouring values.

    Values are counted by bin, which is combined before the shuffle; the bins that hold the wanted places are found in
    groups x BINS counts, and only their values are ranked, each bin by itself. Null values are left out.
    """
    rows = staging.stage(df.select(F.col(by).alias("k"), F.col(value).cast("double").alias("x")).filter("x is not null"), "quantile-values")
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("z")).first()
    low, width = ends["a"] or 0.0, max(((ends["z"] or 0.0) - (ends["a"] or 0.0)) / BINS, 1e-300)
    rows = rows.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(width))).cast("int"))
    counts = rows.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("m"))
    wanted = staging.stage(places(counts, shares), "quantile-places")  # two rows a quantile and group
    bins = wanted.select("k", "bin").distinct()
    held = rows.join(bins, (rows.k.eqNullSafe(bins.k)) & (rows.bin == bins.bin)).select(rows.k, rows.bin, "x")
    return between(held.withColumn("m", F.lit(1)), wanted, by, shares)


def places(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(k, bin, n, before, q, at, rank): the bins that hold the values between which quantiles lie. counts: k, bin, m."""
    w = Window.partitionBy("k")
    counts = counts.withColumns({"upto": F.sum("m").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("m").over(w)})
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)])).alias("s")
    wanted = counts.select("k", "bin", "n", (F.col("upto") - F.col("m")).alias("before"), "upto", place).select("*", (F.col("s.p") * (F.col("n") - 1)).alias("at"))
    # places are counted from 0; a quantile lies between two neighbouring ones
    wanted = wanted.select("k", "bin", "n", "before", "upto", F.col("s.q").alias("q"), "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    return wanted.filter("rank >= before and rank < upto").drop("upto")


def between(held: DataFrame, wanted: DataFrame, by: str, shares: list[float]) -> DataFrame:
    """(by, n, q0, q1, ...) from the values of the bins that are wanted. held: k, bin, x, m (how often); wanted: as of places()."""
    ranked = held.groupBy("k", "bin", "x").agg(F.sum("m").alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy("k", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.select(F.col("k").alias("vk"), F.col("bin").alias("vb"), "x", "m", "upto")
    hit = wanted.join(ranked, F.col("k").eqNullSafe(F.col("vk")) & (F.col("bin") == F.col("vb")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("m")) & (F.col("rank") - F.col("before") < F.col("upto")))
    share = F.when(F.floor("at") == F.ceil("at"), F.lit(1.0)).otherwise(1 - F.abs(F.col("at") - F.col("rank")))
    each = hit.groupBy("k", "n", "q").agg(F.sum(share * F.col("x")).alias("v"))
    return each.groupBy(F.col("k").alias(by), "n").agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(f"q{i}") for i in range(len(shares))])
