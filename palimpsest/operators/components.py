"""Connected components over an edge table, by repeated contraction in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import staging


def components(edges: DataFrame) -> DataFrame:
    """The component of every node that has an edge: (node, root), root being some node of the component.

    edges: (u, v) of type long. Each round every node takes the neighbour of least priority (a hash that changes
    by round), edges move to what their ends took, and edges within one node go; the nodes of a component become
    fewer by a constant factor a round until one is left. Neighbour minima are combined before the shuffle, and
    every round's table is written to the shared folder; joins are merges, so nothing that grows with the edges is broadcast. Self loops and nulls are ignored; no edges give no rows.
    """
    now = staging.stage(edges.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    taken: list[DataFrame] = []
    while not now.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(taken))).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = now.select(F.col("u").alias("node"), rank("v").alias("r")).unionByName(now.select(F.col("v").alias("node"), rank("u").alias("r")))
        step = staging.stage(
            ends.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least(F.col("r"), rank("node"))["id"].alias("took")),
            "cc-step",
        )
        taken.append(step)
        left, right = (step.select(F.col("node").alias(e), F.col("took").alias(t)).hint("merge") for e, t in (("u", "a"), ("v", "b")))
        moved = now.join(left, "u").join(right, "v")
        now = staging.stage(moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges")
    if not taken:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # what a node took, was in turn a node of the next round, unless its edges were gone by then
    root = taken[-1].select("node", F.col("took").alias("root"))
    for step in reversed(taken[:-1]):
        root = staging.stage(step.join(root.withColumnRenamed("node", "took").hint("merge"), "took", "left").select("node", F.coalesce("root", "took").alias("root")), "cc-roots")
    return root


def named_by_least(root: DataFrame, slots: int = 16) -> DataFrame:
    """(node, least): each node with the least node of its component. root: node, root.

    A component may hold most of the nodes, so its name is dealt over slots, and no task joins all its members.
    """
    dealt = root.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(slots)).cast("int"))
    least = dealt.groupBy("root", "slot").agg(F.min("node").alias("m")).groupBy("root").agg(F.min("m").alias("least"))
    least = least.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return dealt.join(least, ["root", "slot"]).select("node", "least")
