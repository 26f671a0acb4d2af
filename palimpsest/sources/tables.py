"""The star-schema and text tables read as a memory graph: claims, mentions, edges, turns, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; times without a zone are taken in the session's, which is UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as keyed claims: a customer is the subject, the priority the aspect, the next order of both supersedes."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("aspect"), F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_until"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("tx_from"), (F.lead("o_orderdate").over(w) + F.expr("INTERVAL 1 DAY")).alias("tx_until"),
        F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("forgotten_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 180 DAYS")).alias("valid_horizon"), F.lead("o_orderkey").over(w).alias("superseded_by"),
    )


CLAIMS = """claims AS (
    SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS aspect, o_totalprice AS value, o_orderdate AS valid_from,
           lead(o_orderdate) OVER w AS valid_until, o_orderdate + INTERVAL 1 DAY AS tx_from, lead(o_orderdate) OVER w + INTERVAL 1 DAY AS tx_until,
           CASE WHEN o_orderkey % 50 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS forgotten_at, o_orderdate + INTERVAL 180 DAY AS valid_horizon,
           lead(o_orderkey) OVER w AS superseded_by
    FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mentions of parts (entities) by orders (episodes), with their count."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode"), F.col("l_partkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


MENTIONS = "mentions AS (SELECT l_orderkey AS episode, l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that an episode mentions together, src < dst, with the number of such episodes. An order has few lines."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_partkey").alias("entity"))
    m = m.repartition("episode").distinct()  # dealt once, for both sides of the join too
    a, b = m.withColumnRenamed("entity", "src"), m.withColumnRenamed("entity", "dst")
    return a.join(b, "episode").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


PAIRS = "pairs AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS n FROM mentions a JOIN mentions b ON a.episode = b.episode AND a.entity < b.entity GROUP BY 1, 2)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurrence edges with a strength by count and a status by the keys' sum."""
    return pairs(spark, sf_dir).select(
        F.when((F.col("src") + F.col("dst")) % 3 == 0, "SIMILAR").otherwise("CO_OCCURS").alias("type"), "src", "dst", "n",
        (1 - F.pow(F.lit(0.7), F.col("n")) * (1 - ((F.col("src") * 7 + F.col("dst")) % 10) / 20.0)).alias("strength"),
        (0.5 + ((F.col("src") + F.col("dst")) % 5) / 10.0).alias("confidence"),
    )


EDGES = """edges AS (
    SELECT CASE WHEN (src + dst) % 3 = 0 THEN 'SIMILAR' ELSE 'CO_OCCURS' END AS type, src, dst, n,
           1 - pow(0.7::DOUBLE, n) * (1 - ((src * 7 + dst) % 10) / 20.0::DOUBLE) AS strength, 0.5::DOUBLE + ((src + dst) % 5) / 10.0::DOUBLE AS confidence
    FROM pairs)"""

GRAPH = f"{MENTIONS}, {PAIRS}, {EDGES}"


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge from either end: node, other, and the other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = [F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in (("src", "dst"), ("dst", "src"))]
    return edges.select(F.explode(F.array(*ends)).alias("ends"), *rest).select("ends.node", "ends.other", *rest)


BOTH = "both_ways AS (SELECT src AS node, dst AS other, type, n, strength, confidence FROM edges UNION ALL SELECT dst, src, type, n, strength, confidence FROM edges)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def restated(v: DataFrame) -> DataFrame:
    """Later restatements of every tenth claim: its vector without the first eight places, under an id of its own."""
    return v.filter("id % 10 = 3").select((F.col("id") + 10_000_000).alias("id"), F.concat(F.array_repeat(F.lit(0.0), 8), F.slice("vec", 9, 4096).cast("array<double>")).alias("vec"), "label")


_NEW = "list_concat([0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[], a.embedding[9:]::DOUBLE[])"
_NEW_COS = f"list_dot_product({_NEW}, b.embedding::DOUBLE[]) / sqrt(list_dot_product({_NEW}, {_NEW}) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
#: The ten nearest claims of each restatement.
RESTATED = f"restated AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id + 10000000 AS ask, b.vec_id AS id, {_NEW_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 3) QUALIFY rank <= 10)"
