"""Queries on graph analytics: GRA-* and community aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors
from palimpsest.operators import graph, retrieval, staging
from palimpsest.operators.components import components, named_by_least
from palimpsest.plans.aggregate import _COS, r6
from palimpsest.plans.registry import query
from palimpsest.plans.retrieval import ORPHANS, orphans
from palimpsest.sources import tables
from palimpsest.sources.tables import BOTH, GRAPH, table

# a community of a part is its brand where a query needs fixed communities
_LAB = "lab AS (SELECT p_partkey AS node, p_brand AS community FROM part)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))


_ROUND = "l{n} AS (SELECT node, community FROM (SELECT b.node, p.community, row_number() OVER (PARTITION BY b.node ORDER BY count(*) DESC, p.community) AS r FROM (SELECT DISTINCT node, other FROM both_ways) b JOIN l{p} p ON p.node = b.other GROUP BY b.node, p.community) WHERE r = 1)"


@query("GRA-1", f"WITH {GRAPH}, {BOTH}, l0 AS (SELECT DISTINCT node, node AS community FROM both_ways), {', '.join(_ROUND.format(n=i, p=i - 1) for i in range(1, 4))} SELECT node, community FROM l3")
def gra_1(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of label propagation; the operator's default is ten."""
    return graph.label_propagation(tables.both_ways(staging.stage(tables.pairs(spark, d).select("src", "dst"), "pairs")), 3)


@query("GRA-2", "WITH m AS (SELECT DISTINCT l_suppkey AS item, l_partkey AS member FROM lineitem), s AS (SELECT item, count(*) AS k FROM m GROUP BY 1), p AS (SELECT a.item AS a, b.item AS b, count(*) AS inter FROM m a JOIN m b ON a.member = b.member AND a.item <> b.item GROUP BY 1, 2), j AS (SELECT a, b, inter, inter / (x.k + y.k - inter)::DOUBLE AS score FROM p JOIN s x ON x.item = a JOIN s y ON y.item = b), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM j WHERE score >= 0.1) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, inter, round(score, 6) AS score FROM t WHERE r <= 10 ORDER BY score DESC, a, b LIMIT 500")
def gra_2(spark: SparkSession, d: str) -> DataFrame:
    """Similar suppliers by the parts that both deliver: ten each, at 0.1 or more, the best 500 pairs."""
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("member")).distinct()
    return graph.most_similar(graph.jaccard(m, 0.1)).select("a", "b", "inter", r6("score").alias("score"))


@query(
    "GRA-3",
    f"""WITH {GRAPH}, {BOTH}, deg AS (SELECT vec_id AS id, count(other) AS degree FROM embeddings LEFT JOIN both_ways ON node = vec_id AND n >= 2 GROUP BY 1), seeds AS (SELECT id FROM deg WHERE degree <= 2 ORDER BY degree, id LIMIT 200),
        k AS (SELECT a.vec_id AS ask, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM seeds s JOIN embeddings a ON a.vec_id = s.id JOIN embeddings b ON b.vec_id <> a.vec_id)
        SELECT DISTINCT least(ask, id) AS src, greatest(ask, id) AS dst, round(score, 5) AS score FROM k WHERE rank <= 5 AND score >= 0.1 AND NOT EXISTS (SELECT 1 FROM both_ways e WHERE e.node = ask AND e.other = id)""",
)
def gra_3(spark: SparkSession, d: str) -> DataFrame:
    """A kNN graph from entities of few edges (of two episodes or more) to those that no edge joins them with yet."""
    v = tables.vectors(spark, d).select("id", "vec")
    both = staging.stage(tables.both_ways(tables.edges(spark, d)).select("node", "other", "n"), "both")
    seeds = graph.under_connected(v.select("id"), both.filter("n >= 2"))
    near = retrieval.knn(v.join(seeds, "id", "left_semi"), v, 5, 0.1)
    near = near.join(both.select(F.col("node").alias("ask"), F.col("other").alias("id")), ["ask", "id"], "left_anti")
    return near.select(F.least("ask", "id").alias("src"), F.greatest("ask", "id").alias("dst"), F.round("score", 5).alias("score")).distinct()


#: Nominated pairs: asked entities with their strongest five neighbours.
_NOMINATED = "nom AS (SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY strength DESC, other, type) AS r FROM both_ways WHERE node % 100 = 0) WHERE r <= 5)"


@query(
    "GRA-4",
    f"""WITH {GRAPH}, {BOTH}, {_NOMINATED}, n AS (SELECT DISTINCT node, other FROM both_ways), k AS (SELECT node, count(*) AS k FROM n GROUP BY 1), e AS (SELECT entity, count(*) AS k, min(o_orderdate) AS first, max(o_orderdate) AS last FROM mentions JOIN orders ON o_orderkey = episode GROUP BY 1),
        sh AS (SELECT a, b, count(*) AS shared FROM nom JOIN mentions x ON x.entity = a JOIN mentions y ON y.entity = b AND y.episode = x.episode GROUP BY 1, 2), ov AS (SELECT a, b, count(*) AS overlap FROM nom JOIN n x ON x.node = a JOIN n y ON y.node = b AND y.other = x.other GROUP BY 1, 2)
        SELECT nom.a, nom.b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (p.k + q.k - coalesce(shared, 0))::DOUBLE, 6) AS jaccard, coalesce(overlap, 0) AS neighbours, round(coalesce(overlap, 0) / (u.k + w.k - coalesce(overlap, 0))::DOUBLE, 6) AS neighbour_jaccard,
               round(greatest(0, epoch_us(greatest(p.first, q.first)) - epoch_us(least(p.last, q.last))) / 86400000000.0, 6) AS gap_days, p.k AS episodes_a, q.k AS episodes_b
        FROM nom JOIN e p ON p.entity = nom.a JOIN e q ON q.entity = nom.b JOIN k u ON u.node = nom.a JOIN k w ON w.node = nom.b LEFT JOIN sh ON sh.a = nom.a AND sh.b = nom.b LEFT JOIN ov ON ov.a = nom.a AND ov.b = nom.b""",
)
def gra_4(spark: SparkSession, d: str) -> DataFrame:
    """The evidence for nominated pairs, from all episodes and all edges."""
    e = staging.stage(tables.both_ways(tables.edges(spark, d)), "both-ways")
    w = Window.partitionBy("node").orderBy(F.desc("strength"), "other", "type")
    best = e.filter("node % 100 = 0").withColumn("r", F.row_number().over(w)).filter("r <= 5")
    pairs = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    dated = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode"), F.col("o_orderdate").alias("at"))
    s = graph.pair_signals(pairs, tables.mentions(spark, d).join(dated, "episode").select("episode", "entity", "at"), e.select("node", "other"))
    return s.select("a", "b", "shared", r6("jaccard").alias("jaccard"), "neighbours", r6("neighbour_jaccard").alias("neighbour_jaccard"), r6("gap_days").alias("gap_days"), "episodes_a", "episodes_b")


_CROSS = "cr AS (SELECT least(x.community, y.community) AS ca, greatest(x.community, y.community) AS cb, count(*) AS n FROM edges e JOIN lab x ON x.node = e.src JOIN lab y ON y.node = e.dst WHERE x.community <> y.community GROUP BY 1, 2)"


# edges between parts of near numbers, and blocks of fifty parts as their communities
_BLOCKS = f"{GRAPH}, near AS (SELECT src, dst, src // 50 AS x, dst // 50 AS y FROM edges WHERE dst - src <= 5), ends AS (SELECT x AS c, x = y AS inside FROM near UNION ALL SELECT y, x = y FROM near), k AS (SELECT c, count(*) FILTER (inside) // 2 AS internal, count(*) FILTER (NOT inside) AS external FROM ends GROUP BY 1), prof AS (SELECT z.c, z.size, least(1, coalesce(internal, 0) / z.size::DOUBLE) AS coh, greatest(0, 1 - coalesce(external, 0) / z.size::DOUBLE) AS iso FROM (SELECT p_partkey // 50 AS c, count(*) AS size FROM part GROUP BY 1) z LEFT JOIN k ON k.c = z.c), best AS (SELECT * FROM prof WHERE coh * iso > 0), cr AS (SELECT least(x, y) AS ca, greatest(x, y) AS cb, count(*) AS n FROM near WHERE x <> y GROUP BY 1, 2)"


@query(
    "GRA-5",
    f"""WITH {_BLOCKS}, s AS (SELECT a.c AS ca, b.c AS cb, coalesce(n, 0) AS n, least(1, coalesce(n, 0) / least(a.size, b.size)::DOUBLE) AS overlap, least(a.coh, b.coh) * (least(a.size, b.size) / greatest(a.size, b.size)::DOUBLE) * (1 - least(1, coalesce(n, 0) / least(a.size, b.size)::DOUBLE)) * least(a.iso, b.iso) AS score FROM best a JOIN best b ON a.c < b.c LEFT JOIN cr ON cr.ca = a.c AND cr.cb = b.c)
        SELECT ca, cb, n, round(score, 8) AS score FROM s WHERE overlap <= 0.25 AND s.score > 0""",
)
def gra_5(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of communities for bridges: coherent, of like size, hardly joined and cut off from the rest."""
    labels = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 50").alias("community"))
    near = staging.stage(tables.edges(spark, d).filter("dst - src <= 5").select("src", "dst"), "near")
    return graph.bridge_pairs(graph.community_profile(near, labels), graph.crossing(near, labels), most=None).select("ca", "cb", "n", F.round("score", 8).alias("score"))


@query("GRA-6", f"WITH {ORPHANS} SELECT id FROM orphans")
def gra_6(spark: SparkSession, d: str) -> DataFrame:
    """Orphans: neither structural nor unprocessed, and without an edge beyond the backbone."""
    return orphans(spark, d)


@query("GRA-7", f"WITH {GRAPH}, {BOTH} SELECT b.node, b.other, b.type, round(b.strength, 6) AS strength, p.p_name AS name FROM both_ways b JOIN part p ON p.p_partkey = b.other WHERE b.node % 100 = 0")
def gra_7(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_partkey").alias("other"), F.col("p_name").alias("name"))
    e = tables.both_ways(tables.edges(spark, d)).filter("node % 100 = 0")
    return e.join(names, "other").select("node", "other", "type", r6("strength").alias("strength"), "name")


@query(
    "GRA-8",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS u, l_orderkey + 7 AS v FROM lineitem WHERE l_orderkey % 7 = 0 AND l_orderkey % 3 <> 0), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, root) AS (SELECT u, u FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node)
       SELECT node, min(root) AS root FROM r GROUP BY 1""",
)
def gra_8(spark: SparkSession, d: str) -> DataFrame:
    """Groups of duplicate pairs: components, named by their least member."""
    e = table(spark, d, "lineitem").filter("l_orderkey % 7 = 0 and l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("u"), (F.col("l_orderkey") + 7).alias("v")).distinct()
    root = staging.stage(components(e), "groups")
    return named_by_least(root).select("node", F.col("least").alias("root"))


@query("GRA-9", "WITH e AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS other, l_quantity AS w FROM lineitem), v AS (SELECT node, w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM e JOIN embeddings ON vec_id = other), m AS (SELECT node, i, sum(w * x) / sum(w) AS y FROM v GROUP BY 1, 2) SELECT node, round(sqrt(sum(y * y)), 5) AS norm FROM m GROUP BY 1")
def gra_9(spark: SparkSession, d: str) -> DataFrame:
    """Context vectors: weighted means of the neighbours' vectors."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("weight")).distinct()
    m = retrieval.mean_vector(e.join(tables.vectors(spark, d).select("id", "vec"), "id"), "node", 64)
    return m.select("node", F.round(vectors.norm(F.col("vec")), 5).alias("norm"))


@query("AGG-14", f"WITH {GRAPH}, {_LAB}, ends AS (SELECT x.community AS ca, y.community AS cb FROM edges e JOIN lab x ON x.node = e.src JOIN lab y ON y.node = e.dst), per AS (SELECT ca AS community, ca = cb AS inside FROM ends UNION ALL SELECT cb, ca = cb FROM ends), k AS (SELECT community, count(*) FILTER (inside) // 2 AS internal, count(*) FILTER (NOT inside) AS external FROM per GROUP BY 1) SELECT z.community, z.size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external FROM (SELECT community, count(*) AS size FROM lab GROUP BY 1) z LEFT JOIN k ON k.community = z.community")
def agg_14(spark: SparkSession, d: str) -> DataFrame:
    return graph.community_profile(tables.edges(spark, d), _labels(spark, d))


@query("AGG-15", f"WITH {GRAPH}, {_LAB}, {_CROSS} SELECT ca, cb, n FROM cr")
def agg_15(spark: SparkSession, d: str) -> DataFrame:
    return graph.crossing(tables.edges(spark, d), _labels(spark, d))


@query("AGG-16", "SELECT p_brand AS community, count(DISTINCT l_partkey) AS members, count(DISTINCT o_custkey) AS sessions FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def agg_16(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("community"))
    return lines.join(brand, "l_partkey").groupBy("community").agg(F.count_distinct("l_partkey").alias("members"), F.count_distinct("o_custkey").alias("sessions"))
