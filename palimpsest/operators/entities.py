"""Entity resolution: canonical choice, redirection of edges, bounded steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import hashing, text
from palimpsest.operators import graph, retrieval


def canonical(entities: DataFrame, key: str) -> DataFrame:
    """(id, canonical): of entities with the same key the most mentioned, then least id (WR-10). entities: id, key, k.

    One aggregation gives each key's canonical row; a key's members get it by a join on the key.
    """
    best = entities.groupBy(key).agg(F.max_by("id", F.struct("k", -F.col("id"))).alias("canonical"))
    return entities.select("id", key).join(best, key).select("id", "canonical")


def redirect(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Edges between canonical entities: largest strength, summed counts, no self loops (WR-12)."""
    a, b = canon.select(F.col("id").alias("src"), F.col("canonical").alias("a")), canon.select(F.col("id").alias("dst"), F.col("canonical").alias("b"))
    moved = edges.join(a, "src").join(b, "dst").filter("a <> b")
    return moved.groupBy("type", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("strength").alias("strength"), F.sum("n").alias("n"))


def bounded_steps(observations: DataFrame, key: list[str], order: list[str], floor: float = 0.1) -> DataFrame:
    """Strength after steps towards 1 in order, in closed form (WR-2): key, strength, n. observations: key, order, eta.

    The first step is at least floor, so only it needs the order: the least of the order is found by one aggregation
    that also takes the product, without a sort of a pair's observations.
    """
    first = F.min_by("eta", F.struct(*order))
    g = observations.groupBy(*key).agg(first.alias("first"), F.product(1 - F.col("eta")).alias("all"), F.count_if(F.col("eta") == 1).alias("full"), F.product(F.when(F.col("eta") < 1, 1 - F.col("eta")).otherwise(F.lit(1.0))).alias("partial"), F.count(F.lit(1)).alias("n"))
    # the product of the others: leave the first out, also where it or another is a full step
    rest = F.when(F.col("full") - (F.col("first") == 1).cast("int") > 0, F.lit(0.0)).when(F.col("first") == 1, F.col("partial")).otherwise(F.col("partial") / (1 - F.col("first")))
    return g.select(*key, (1 - (1 - F.greatest(F.col("first"), F.lit(floor))) * rest).alias("strength"), "n")


def unique_alias_holders(aliases: DataFrame) -> DataFrame:
    """Aliases that one holder has (JOIN-11): alias, holder. aliases: holder, alias."""
    return aliases.groupBy("alias").agg(F.min("holder").alias("holder"), F.max("holder").alias("other")).filter("holder = other").drop("other")


def verdict_precedence(rows: DataFrame) -> DataFrame:
    """decided, veto, auto or propose (WR-24). rows: decided, unanimous, confidence."""
    v = F.when(F.col("decided"), "decided").when(F.col("unanimous") == F.lit(False), "veto").when(F.col("confidence") >= 0.85, "auto").otherwise("propose")
    return rows.withColumn("verdict", v)


def latest_versions(rows: DataFrame, key: str) -> DataFrame:
    """The newest version of each key and whether a row is stale (WIN-9)."""
    return rows.withColumn("stale", F.col("version") < F.max("version").over(Window.partitionBy(key)))


def contradiction_candidates(claims: DataFrame, new: Column, asks: DataFrame, held: DataFrame, each: int = 3, floor: float = 0.75) -> DataFrame:
    """(id, other, tier): the best claims that each new one may contradict (WR-15). claims: id, subject, aspect, at; new: which
    of them are new; asks, held: id, vec of new claims and of those that are sought.

    Tier 1 is the claim before it of the same subject and aspect, tier 2 the subject's each last ones before it, tier 3 the
    nearest by vector at floor or above. The first two are taken from the rows before a claim in order of time, so that a
    subject of many claims is one sorted pass and no join with itself. A pair counts by its best tier.
    """
    order = [F.col("at"), F.col("id")]
    by_key, by_subject = Window.partitionBy("subject", "aspect").orderBy(*order), Window.partitionBy("subject").orderBy(*order)
    rows = claims.select("id", F.lag("id").over(by_key).alias("keyed"), *[F.lag("id", k).over(by_subject).alias(f"s{k}") for k in range(1, each + 1)]).filter(new)
    none = F.lit(None).cast("double")
    keyed = rows.select("id", F.col("keyed").alias("other"), F.lit(1).alias("tier"), none.alias("score"))
    own = rows.select("id", F.explode(F.array(*[f"s{k}" for k in range(1, each + 1)])).alias("other"), F.lit(2).alias("tier"), none.alias("score"))
    # one place more than are wanted, for the claim itself
    near = retrieval.knn(asks, held, 2 * each + 1, floor).select(F.col("ask").alias("id"), F.col("id").alias("other"), F.lit(3).alias("tier"), "score")
    best = keyed.unionByName(own).unionByName(near).filter("other is not null").groupBy("id", "other").agg(F.min("tier").alias("tier"), F.max("score").alias("score"))
    w = Window.partitionBy("id").orderBy("tier", F.desc_nulls_last("score"), F.desc("other"))
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= each).drop("r", "score")


def reopened_steps(observations: DataFrame, key: list[str], order: list[str], floor: float = 0.1) -> DataFrame:
    """bounded_steps() where edges are closed and seen again (WR-2): key, strength, n, closed. observations: key, order, eta,
    closes.

    A row that closes makes no step. What is seen after it begins anew, at fresh strength; so the steps after the last
    closing count, or, for an edge that is closed, those between it and the one before. n counts these steps.
    """
    at = F.struct(*order)
    ends = observations.groupBy(*key).agg(F.max(F.when(F.col("closes"), at)).alias("last"), F.max(F.when(~F.col("closes"), at)).alias("seen"))
    marked = observations.join(ends, key).withColumn("closed", F.coalesce(F.col("last") > F.col("seen"), F.lit(False)))
    # of a closed edge the closing before the last one
    before = marked.filter(F.col("closes") & F.col("closed") & (at < F.col("last"))).groupBy(*key).agg(F.max(at).alias("before"))
    rows = marked.filter(~F.col("closes")).join(before, key, "left")
    since = F.when(F.col("closed"), F.col("before")).otherwise(F.col("last"))
    live = rows.filter(since.isNull() | (at > since))
    return bounded_steps(live, [*key, "closed"], order, floor)


def upsert(seen: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """(name_norm, id, action, n): what each observed name becomes (WR-9). seen: name; known: name_norm, id, merged_into, closed.

    Names are folded and counted once. A known one leads along its merges (most links) to the entity that stands for it,
    which is reopened if it is closed; an unknown one is created, with an id of its name. Null names are left out.
    """
    names = seen.filter("name is not null").groupBy(text.fold_ascii(F.col("name")).alias("name_norm")).agg(F.count(F.lit(1)).alias("n"))
    heads = graph.lineage_head(known.filter("merged_into is not null").select(F.col("id").alias("node"), F.col("merged_into").alias("next")), most).select(F.col("node").alias("id"), "head")
    ended = known.select(F.col("id").alias("head"), F.col("closed"))
    led = known.select("name_norm", "id").join(heads, "id", "left").select("name_norm", F.coalesce("head", "id").alias("head")).join(ended, "head", "left")
    made = hashing.derived_id(F.lit("entity"), F.col("name_norm"))
    action = F.when(F.col("head").isNull(), "created").when(F.col("closed"), "reopened").otherwise("found")
    return names.join(led, "name_norm", "left").select("name_norm", F.coalesce(F.col("head").cast("string"), made).alias("id"), action.alias("action"), "n")
