"""Queries on joins and retrieval: JOIN-*, RET-*, and the flagship hybrid recall."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors, weights
from palimpsest.operators import entities, graph, intentions, names, recall, retrieval, staging, vector_index
from palimpsest.operators.quantiles import quantiles
from palimpsest.plans.aggregate import KNN, N, knn, r6
from palimpsest.plans.registry import query
from palimpsest.plans.write import _G0, _entities
from palimpsest.sources import tables
from palimpsest.sources.tables import BOTH, CLAIMS, GRAPH, MENTIONS, table


def _both(spark: SparkSession, d: str) -> DataFrame:
    return tables.both_ways(tables.edges(spark, d))


def _staged_both(spark: SparkSession, d: str) -> DataFrame:
    """What carries activation, both ways, over edges that are staged one way."""
    return tables.both_ways(staging.stage(tables.edges(spark, d).select("src", "dst", "type", "strength", "confidence"), "edges"))


@query("JOIN-1", f"WITH {GRAPH}, {BOTH}, r AS (SELECT node, other, type, strength, row_number() OVER (PARTITION BY node ORDER BY strength DESC, other, type) AS rank FROM both_ways WHERE node % 100 = 0 AND other % 100 <> 0) SELECT node, other, round(strength, 6) AS strength, rank::INT AS rank FROM r WHERE rank <= 5")
def join_1(spark: SparkSession, d: str) -> DataFrame:
    """Expansion by one hop with the strongest five neighbours that aren't visited."""
    e = staging.stage(_both(spark, d), "both-ways")
    visited = e.filter("node % 100 = 0").select(F.col("node").alias("other")).distinct()
    w = Window.partitionBy("node").orderBy(F.desc("strength"), "other", "type")
    near = e.filter("node % 100 = 0").join(visited, "other", "left_anti")
    return near.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("node", "other", r6("strength").alias("strength"), "rank")


@query("JOIN-2", "SELECT l_orderkey, l_linenumber, r.boost FROM lineitem JOIN (VALUES ('R', 2), ('A', 1)) r(flag, boost) ON l_returnflag = r.flag")
def join_2(spark: SparkSession, d: str) -> DataFrame:
    params = spark.createDataFrame([("R", 2), ("A", 1)], "l_returnflag string, boost int")
    return table(spark, d, "lineitem").join(F.broadcast(params), "l_returnflag").select("l_orderkey", "l_linenumber", "boost")


@query("JOIN-3", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_3(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(N().alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["orders"])


@query("JOIN-4", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def join_4(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(r, "p_partkey", "left_semi")


@query("JOIN-5", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_5(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("JOIN-6", f"WITH {CLAIMS} SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM claims WHERE valid_until IS NULL)")
def join_6(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are missing or closed."""
    open_ = tables.claims(spark, d).filter("valid_until is null").select("id")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().join(open_, "id", "left_anti")


_SOUGHT = "sought AS (SELECT doc_id AS subject, lower(trim(regexp_extract(text, '^\\S+\\s+\\S+'))) AS name FROM documents)"


def _sought(spark: SparkSession, d: str) -> DataFrame:
    """Names of several words: each document's first two."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("subject"), F.lower(F.trim(F.regexp_extract("text", r"^\S+\s+\S+", 0))).alias("name"))


@query("JOIN-7", f"WITH {_SOUGHT} SELECT conv_id * 1000 + turn AS id, subject FROM conversations JOIN sought ON length(name) >= 3 AND contains(lower(text), name)")
def join_7(spark: SparkSession, d: str) -> DataFrame:
    """Subjects whose names a turn contains anywhere: one automaton over all names reads each text once."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return names.contained(turns, _sought(spark, d))


@query("JOIN-8", f"WITH {KNN} SELECT ask, id, rank::INT AS rank, round(score, 5) AS score FROM knn WHERE score >= 0.1")
def join_8(spark: SparkSession, d: str) -> DataFrame:
    return knn(spark, d).filter("score >= 0.1").select("ask", "id", "rank", F.round("score", 5).alias("score"))


@query("JOIN-9", "WITH a AS (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10), b AS (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) SELECT s_suppkey, c_custkey, round(s_acctbal + c_acctbal, 2) AS score FROM a, b WHERE s_nationkey <> c_nationkey ORDER BY s_acctbal + c_acctbal DESC, s_suppkey, c_custkey LIMIT 1")
def join_9(spark: SparkSession, d: str) -> DataFrame:
    """The best pair of two lists of ten: both are sorted, so the pair is near their heads; the lists are bounded."""
    a = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)
    b = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    p = a.join(F.broadcast(b), F.col("s_nationkey") != F.col("c_nationkey")).withColumn("score", F.col("s_acctbal") + F.col("c_acctbal"))
    return p.orderBy(F.desc("score"), "s_suppkey", "c_custkey").limit(1).select("s_suppkey", "c_custkey", F.round("score", 2).alias("score"))


@query("JOIN-10", "SELECT translate(lower(p_brand), '-_./ #', '') AS squash, count(*) AS n, min(p_partkey) AS canonical FROM part GROUP BY 1 HAVING count(*) > 1")
def join_10(spark: SparkSession, d: str) -> DataFrame:
    key = F.translate(F.lower("p_brand"), "-_./ #", "")
    return table(spark, d, "part").groupBy(key.alias("squash")).agg(N().alias("n"), F.min("p_partkey").alias("canonical")).filter("n > 1")


@query("JOIN-11", "WITH a AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) || '-' || p_partkey % 811 AS alias FROM part), u AS (SELECT alias, min(p_partkey) AS holder FROM a GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1) SELECT alias, holder FROM u")
def join_11(spark: SparkSession, d: str) -> DataFrame:
    """Aliases (words of names with a number) that exactly one entity holds."""
    number = F.concat(F.lit("-"), (F.col("p_partkey") % 811).cast("string"))
    a = table(spark, d, "part").select(F.col("p_partkey").alias("holder"), F.explode(F.split("p_name", " ")).alias("alias"), number.alias("number"))
    return entities.unique_alias_holders(a.select("holder", F.concat("alias", "number").alias("alias"))).select("alias", "holder")


@query(
    "JOIN-12",
    f"""WITH {CLAIMS}, p AS (SELECT o_custkey AS subject, o_orderpriority AS aspect, o_orderdate + INTERVAL 5 DAY AS moment, o_orderkey AS probe FROM orders)
        SELECT probe, arg_max(id, (valid_from, id)) AS claim FROM p JOIN claims USING (subject, aspect) WHERE valid_from <= moment AND (valid_until IS NULL OR valid_until > moment) GROUP BY 1""",
)
def join_12(spark: SparkSession, d: str) -> DataFrame:
    """The claim that held at each probe's instant: an as-of join by one ordered pass over both, not by ranges."""
    c = tables.claims(spark, d).select("subject", "aspect", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), "id")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("aspect"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("at"), F.lit(1).alias("kind"), F.col("o_orderkey").alias("id"))
    w = Window.partitionBy("subject", "aspect").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("kind") == 0, F.col("id")), True).over(w)
    return c.unionByName(p).withColumn("claim", held).filter("kind = 1 and claim is not null").select(F.col("id").alias("probe"), "claim")


@query(
    "JOIN-13",
    f"""WITH RECURSIVE {CLAIMS}, walk(node, head, depth) AS (SELECT id, superseded_by, 1 FROM claims WHERE superseded_by IS NOT NULL
        UNION ALL SELECT w.node, c.superseded_by, w.depth + 1 FROM walk w JOIN claims c ON c.id = w.head WHERE c.superseded_by IS NOT NULL AND w.depth < 8)
        SELECT node, arg_max(head, depth) AS head, max(depth)::INT AS depth FROM walk GROUP BY 1""",
)
def join_13(spark: SparkSession, d: str) -> DataFrame:
    c = tables.claims(spark, d).filter("superseded_by is not null").select(F.col("id").alias("node"), F.col("superseded_by").alias("next"))
    return graph.lineage_head(c, 8)


#: Parts whose lines are backbone edges, but for large shipments by air; promotional ones are structural, very large ones
#: aren't processed yet. Orphans are current parts of the others without another edge.
_LINKED = "l_quantity >= 49 AND l_returnflag = 'R'"
ORPHANS = f"orphans AS (SELECT p_partkey AS id FROM part WHERE NOT starts_with(p_type, 'PROMO') AND p_size <= 45 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE {_LINKED}))"
#: Containers of an orphan are its orders by rising key; a sibling is the first linked part of the first that has one.
SIBLINGS = f"""siblings AS (SELECT id, arg_min(sibling, (container, sibling)) AS sibling FROM (SELECT o.id, a.l_orderkey AS container, b.l_partkey AS sibling FROM orphans o JOIN lineitem a ON a.l_partkey = o.id JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_partkey <> o.id
    WHERE b.l_partkey IN (SELECT l_partkey FROM lineitem WHERE {_LINKED})) GROUP BY 1)"""


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Parts without an edge beyond the backbone (GRA-6)."""
    linked = table(spark, d, "lineitem").filter(_LINKED).select(F.col("l_partkey").alias("id"))
    open_ = table(spark, d, "part").filter("not startswith(p_type, 'PROMO') and p_size <= 45").select(F.col("p_partkey").alias("id"))
    return open_.join(linked, "id", "left_anti")


def siblings(spark: SparkSession, d: str, lost: DataFrame) -> DataFrame:
    """(id, sibling): over an orphan's containers to a linked part, the first of each. lost: id."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_partkey").alias("id"))
    linked = table(spark, d, "lineitem").filter(_LINKED).select(F.col("l_partkey").alias("id")).distinct()
    held = lines.join(lost.select("id"), "id", "left_semi").distinct()
    others = lines.join(linked, "id", "left_semi").select("container", F.col("id").alias("sibling")).distinct()
    return held.join(others, "container").filter("id <> sibling").groupBy("id").agg(F.min_by("sibling", F.struct("container", "sibling")).alias("sibling"))


@query("JOIN-14", f"WITH {ORPHANS}, {SIBLINGS} SELECT id, sibling FROM siblings")
def join_14(spark: SparkSession, d: str) -> DataFrame:
    """Orphans relinked over their container to a sibling: the first of each container."""
    return siblings(spark, d, orphans(spark, d))


@query("JOIN-15", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AND o_orderkey NOT IN (SELECT event_id FROM events)")
def join_15(spark: SparkSession, d: str) -> DataFrame:
    """Stored, but neither in the ledger nor in the queue."""
    ledger = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    queue = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(ledger, "id", "left_anti").join(queue, "id", "left_anti")


@query("JOIN-16", "SELECT event_id FROM events WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND 'done:' || o_orderkey = 'done:' || event_id)")
def join_16(spark: SparkSession, d: str) -> DataFrame:
    """Failures without a mark of completion: filled orders are the marks."""
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("done:"), F.col("o_orderkey").cast("string")).alias("key"))
    e = table(spark, d, "events").filter("event_type = 'error'").withColumn("key", F.concat(F.lit("done:"), F.col("event_id").cast("string")))
    return e.join(done, "key", "left_anti").select("event_id")


@query("JOIN-17", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT IN (1, 5, 9)")
def join_17(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").filter(F.array_contains(F.array(F.lit(1), F.lit(5), F.lit(9)), k)).select("event_id")


def _cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues of the fallback path: the raw query, weight 3, without model calls."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("cue_id"), F.trim("text").alias("cue"), F.lit(3).alias("weight"))


@query("RET-1", "SELECT item_id AS cue_id, trim(text) AS cue, 3 AS weight FROM benchmark")
def ret_1(spark: SparkSession, d: str) -> DataFrame:
    c = _cues(spark, d)
    first = c.groupBy(F.lower("cue").alias("k")).agg(F.min("cue_id").alias("cue_id"))
    return c.join(first, "cue_id", "left_semi")


@query("RET-2", f"WITH {KNN} SELECT ask AS cue, id, round(score, 5) AS relevance FROM knn WHERE rank <= 5 AND score >= 0.1")
def ret_2(spark: SparkSession, d: str) -> DataFrame:
    return knn(spark, d, 5, 0.1).select(F.col("ask").alias("cue"), "id", F.round("score", 5).alias("relevance"))


@query("RET-3", f"WITH {KNN}, c AS (SELECT ask, b.vec_id AS id, score FROM knn k JOIN embeddings a ON a.vec_id = k.id JOIN embeddings b ON b.vec_id = k.id + 1) SELECT c.ask AS cue, c.id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS relevance FROM c JOIN embeddings a ON a.vec_id = c.ask JOIN embeddings b ON b.vec_id = c.id")
def ret_3(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from one index (the neighbour's successor), scored again on their own vectors."""
    v = tables.vectors(spark, d).select("id", "vec")
    c = knn(spark, d).select("ask", (F.col("id") + 1).alias("id")).join(v, "id")
    c = c.join(v.select(F.col("id").alias("ask"), F.col("vec").alias("ask_vec")), "ask")
    return c.select(F.col("ask").alias("cue"), "id", F.round(vectors.cosine(F.col("ask_vec"), F.col("vec")), 5).alias("relevance"))


_TERMS = "t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), q AS (SELECT DISTINCT item_id AS ask, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 100 = 0)"
_BM25 = f"""{_TERMS}, h AS (SELECT ask, tf.* FROM tf JOIN q USING (term)), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY 1),
    bm25 AS (SELECT ask, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM h JOIN df USING (term) JOIN l USING (doc_id) CROSS JOIN w GROUP BY 1, 2)"""


@query("RET-4", f"WITH {_BM25} SELECT ask, b.doc_id, round(score / max(score) OVER (PARTITION BY ask), 6) AS relevance, contains(lower(d.text), lower(trim(i.text))) AS exact FROM bm25 b JOIN documents d ON d.doc_id = b.doc_id JOIN benchmark i ON i.item_id = ask")
def ret_4(spark: SparkSession, d: str) -> DataFrame:
    """Both BM25 legs: terms, normalised to each query's best, and whether the document holds the query as a phrase."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = table(spark, d, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("ask"), "text")
    hits = staging.stage(retrieval.bm25(docs, asked.select("ask", F.explode(words("text")).alias("term"))), "bm25")
    phrases = names.contained(docs.withColumnRenamed("doc_id", "id"), asked.select(F.col("ask").alias("subject"), F.col("text").alias("name"))).select(F.col("subject").alias("ask"), F.col("id").alias("doc_id"))
    best = hits.groupBy("ask").agg(F.max("score").alias("best"))
    found = hits.join(best, "ask").join(phrases.withColumn("exact", F.lit(True)), ["ask", "doc_id"], "left")
    return found.select("ask", "doc_id", r6(F.col("score") / F.col("best")).alias("relevance"), F.coalesce("exact", F.lit(False)).alias("exact"))


_SHAPE = "SELECT *, translate(f, '-_./ ', '') AS s, list_sort(regexp_extract_all(f, '[0-9]+')) AS n FROM"
_GRAMS = "list_distinct(list_transform(range(1, length({0}.s)), lambda i: substr({0}.s, i, 2)))"
_OVERLAP = f"len(list_intersect({_GRAMS.format('x')}, {_GRAMS.format('y')})) / least(len({_GRAMS.format('x')}), len({_GRAMS.format('y')}))::DOUBLE"
_LONG = "length(x.s) >= 4 AND length(y.s) >= 4 AND x.n = y.n"
_KNOWN = "known AS (SELECT p_partkey AS id, lower(p_name) AS f FROM part UNION ALL SELECT p_partkey, lower(p_brand) FROM part)"


def _known_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).unionByName(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")))


@query(
    "RET-5",
    f"""WITH {_KNOWN}, asked AS (SELECT p_partkey AS ask, lower(CASE WHEN p_partkey % 200 = 0 THEN p_name WHEN p_partkey % 300 = 0 THEN replace(p_name, ' ', '-') ELSE p_name || 's' END) AS f FROM part WHERE p_partkey % 100 = 0),
        x AS ({_SHAPE} asked), y AS ({_SHAPE} (SELECT DISTINCT f FROM known)),
        m AS (SELECT ask, y.f, CASE WHEN x.f = y.f THEN 0 WHEN x.s = y.s THEN 1 ELSE 2 END AS r, CASE WHEN x.s = y.s THEN 1.0 ELSE {_OVERLAP} END AS o FROM x JOIN y ON x.f = y.f OR x.s = y.s OR ({_LONG} AND {_OVERLAP} >= 0.85)),
        b AS (SELECT ask, id, min((r, -o)) AS best FROM m JOIN known USING (f) GROUP BY 1, 2)
        SELECT ask, id, CASE best[1] WHEN 0 THEN 'fold' WHEN 1 THEN 'squash' ELSE 'bigram' END AS relation, round(-best[2], 6) AS overlap FROM b""",
)
def ret_5(spark: SparkSession, d: str) -> DataFrame:
    """The entity leg: names and aliases that are the asked one, exactly, but for its joining marks, or by their bigrams."""
    k, n = F.col("p_partkey"), F.col("p_name")
    said = F.when(k % 200 == 0, n).when(k % 300 == 0, F.replace(n, F.lit(" "), F.lit("-"))).otherwise(F.concat(n, F.lit("s")))
    asks = table(spark, d, "part").filter(k % 100 == 0).select(k.alias("ask"), said.alias("name"))
    return names.related(asks, _known_names(spark, d)).select("ask", "id", "relation", r6("overlap").alias("overlap"))


@query("RET-6", "SELECT o_orderkey AS id, round(1.0 / place, 6) AS score FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 20")
def ret_6(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    w = Window.orderBy(F.desc("o_orderdate"), "o_orderkey")  # of twenty rows
    return recent.select(F.col("o_orderkey").alias("id"), r6(1 / F.row_number().over(w)).alias("score"))


_LEGS = f"{KNN}, legs AS (SELECT id, 'vector' AS leg, score, score AS relevance FROM knn UNION ALL SELECT vec_id, 'label', 0.5, 0.2 FROM embeddings WHERE label = 3 UNION ALL SELECT vec_id, 'recency', 1.0 / (1 + vec_id), 0.0 FROM embeddings WHERE vec_id < 30)"


def _legs(spark: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(spark, d)
    return (
        knn(spark, d).select("id", F.lit("vector").alias("leg"), "score", F.col("score").alias("relevance"))
        .unionByName(v.filter("label = 3").select("id", F.lit("label").alias("leg"), F.lit(0.5).alias("score"), F.lit(0.2).alias("relevance")))
        .unionByName(v.filter("id < 30").select("id", F.lit("recency").alias("leg"), (1.0 / (1 + F.col("id"))).alias("score"), F.lit(0.0).alias("relevance")))
    )


@query("RET-7", f"WITH {_LEGS} SELECT id, round(max(score), 5) AS score, round(max(relevance), 5) AS relevance, string_agg(DISTINCT leg, ',' ORDER BY leg) AS legs, count(*) AS provenance FROM legs GROUP BY 1")
def ret_7(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.merge_seeds(_legs(spark, d)).select("id", F.round("score", 5).alias("score"), F.round("relevance", 5).alias("relevance"), "legs", "provenance")


@query("RET-8")
def ret_8(spark: SparkSession, d: str) -> DataFrame:
    """Reservations of each leg within a budget of 32: a list of a few hundred rows at most, in one task."""
    w = Window.partitionBy("leg").orderBy(F.desc("score"), "id")
    top = _legs(spark, d).groupBy("leg", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(w)).filter("r <= 32")
    shares = {"vector": 0.25, "label": 0.2, "recency": 0.15}
    return top.select("leg", "id", "score", F.lit(0).alias("pack")).groupBy("pack").applyInPandas(lambda pdf: retrieval.reserve(pdf, 32, shares), "id long, place int")


@query("RET-9", f"WITH {GRAPH}, {BOTH}, g AS (SELECT node, count(*) AS degree FROM both_ways GROUP BY 1) SELECT b.node, other, type, round(strength, 6) AS strength, degree FROM (SELECT b.*, row_number() OVER (PARTITION BY b.node ORDER BY strength DESC, other, type) AS rank FROM both_ways b WHERE b.node % 100 = 0 AND strength >= 0.1) b JOIN g ON g.node = b.other WHERE rank <= 64")
def ret_9(spark: SparkSession, d: str) -> DataFrame:
    """Strongest neighbours of the asked nodes (ids divisible by 100) among all edges."""
    e = staging.stage(_both(spark, d), "both-ways")
    return retrieval.adjacency(e, e.filter("node % 100 = 0").select("node").distinct()).select("node", "other", "type", r6("strength").alias("strength"), "degree")


_SHARE = "0.7 * (CASE b.type WHEN 'CO_OCCURS' THEN 0.8 ELSE 0.6 END) * b.strength * (CASE WHEN b.type = 'SIMILAR' THEN b.confidence ELSE 1.0 END) * (CASE WHEN gd.degree <= 10 THEN 1.0 ELSE 1 / (1 + 0.5 * ln(1 + gd.degree - 10)) END) * (CASE WHEN old.node IS NULL THEN 1.0 ELSE 0.5 END)"
#: Score that counts at all in these queries: in the tables' graph nodes have hundreds of neighbours and most are superseded.
LEAST = 0.03
#: Two rounds: the second one's nodes fire one after another, which is a recursion over their places.
_ACT = f"""{GRAPH.replace(MENTIONS + ', ', '')}, {BOTH}, gd AS (SELECT node, count(*) AS degree FROM both_ways GROUP BY 1), old AS (SELECT id AS node FROM canon WHERE id <> canonical),
    b AS (SELECT b.node, b.other, b.type, b.strength, {_SHARE} AS share FROM both_ways b JOIN gd ON gd.node = b.other LEFT JOIN old ON old.node = b.other WHERE b.strength >= 0.1),
    asks AS (SELECT DISTINCT node AS ask FROM both_ways WHERE node % 100 = 0),
    r1 AS (SELECT ask, other AS node, type, share AS gain FROM (SELECT ask, b.*, row_number() OVER (PARTITION BY ask ORDER BY strength DESC, other, type) AS rank FROM asks JOIN b ON b.node = ask) WHERE rank <= 64),
    f AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY gain DESC, node) AS place FROM r1 WHERE gain >= {LEAST}),
    s2 AS (SELECT * FROM (SELECT f.ask, f.node AS src, f.place, b.other, b.type, b.share, o.place AS other_place, row_number() OVER (PARTITION BY f.ask, f.node ORDER BY b.strength DESC, b.other, b.type) AS rank
        FROM f JOIN b ON b.node = f.node LEFT JOIN f o ON o.ask = f.ask AND o.node = b.other WHERE b.other <> f.ask) WHERE rank <= 64),
    ins AS (SELECT ask, other_place AS place, list({{'p': place, 'share': share, 'type': type}} ORDER BY place, rank) AS ins FROM s2 WHERE other_place > place GROUP BY 1, 2),
    fi AS (SELECT f.*, coalesce(ins, []) AS ins FROM f LEFT JOIN ins USING (ask, place)),
    rec(ask, i, done) AS (
        SELECT ask, 0::BIGINT, []::STRUCT(score DOUBLE, hops INT, path VARCHAR)[] FROM asks
        UNION ALL
        SELECT r.ask, r.i + 1, list_append(r.done, (
            SELECT {{'score': fi.gain + coalesce(list_sum(g), 0), 'hops': (CASE WHEN coalesce(list_max(g), 0) > fi.gain THEN r.done[fi.ins[list_position(g, list_max(g))].p].hops + 1 ELSE 1 END)::INT,
                    'path': CASE WHEN coalesce(list_max(g), 0) > fi.gain THEN r.done[fi.ins[list_position(g, list_max(g))].p].path || ' -[' || fi.ins[list_position(g, list_max(g))].type || ']-> ' || fi.node ELSE r.ask || ' -[' || fi.type || ']-> ' || fi.node END}}
            FROM (SELECT list_transform(fi.ins, lambda e: e.share * r.done[e.p].score) AS g)))
        FROM rec r JOIN fi ON fi.ask = r.ask AND fi.place = r.i + 1),
    fired AS (SELECT f.ask, f.node, f.place, d.done[f.place] AS x FROM f JOIN (SELECT ask, arg_max(done, i) AS done FROM rec GROUP BY 1) d USING (ask)),
    more AS (SELECT s2.ask, other AS node, sum(share * x.score) AS gain, max(share * x.score) AS top, arg_max({{'hops': x.hops + 1, 'path': x.path || ' -[' || type || ']-> ' || other}}, (share * x.score, -s2.place, -rank)) AS way
        FROM s2 JOIN fired ON fired.ask = s2.ask AND fired.place = s2.place WHERE other_place IS NULL GROUP BY 1, 2),
    weak AS (SELECT ask, node, type, gain FROM r1 WHERE gain < {LEAST}),
    act AS (SELECT ask, ask AS node, 1.0::DOUBLE AS score, 0 AS hops, ask::VARCHAR AS path FROM asks
        UNION ALL SELECT ask, node, x.score, x.hops, x.path FROM fired
        UNION ALL SELECT coalesce(w.ask, m.ask), coalesce(w.node, m.node), coalesce(w.gain, 0) + coalesce(m.gain, 0), CASE WHEN coalesce(m.top, 0) > coalesce(w.gain, 0) THEN m.way.hops ELSE 1 END,
            CASE WHEN coalesce(m.top, 0) > coalesce(w.gain, 0) THEN m.way.path ELSE w.ask || ' -[' || w.type || ']-> ' || w.node END FROM weak w FULL JOIN more m ON m.ask = w.ask AND m.node = w.node)"""


def _superseded(spark: SparkSession, d: str) -> DataFrame:
    """Entities that were merged into another one."""
    return entities.canonical(_entities(spark, d), "squash").filter("id <> canonical").select(F.col("id").alias("node"))


def _spread(spark: SparkSession, d: str, budget: retrieval.Budget, typed: tuple[str, ...] = retrieval.TYPED) -> DataFrame:
    """Activation of every entity whose id is divisible by 100, each an ask of its own."""
    e, old = _staged_both(spark, d), staging.stage(_superseded(spark, d), "superseded")
    seeds = e.filter("node % 100 = 0").select(F.col("node").alias("ask"), "node", F.lit(1.0).alias("score")).distinct()
    found, ended = retrieval.spread(seeds, retrieval.prepared(e, old, budget), budget, typed)
    found = found.join(ended, "ask").join(old.distinct().withColumn("superseded", F.lit(True)), "node", "left")
    return found.select("ask", "node", r6("score").alias("score"), "hops", "path", "typed_edge", r6("typed_gain").alias("typed_gain"), F.coalesce("superseded", F.lit(False)).alias("superseded"), "ended")


@query("RET-10", f"WITH RECURSIVE {_G0}, {_ACT} SELECT ask, node, round(score, 6) AS score, hops, path, node IN (SELECT node FROM old) AS superseded FROM act WHERE score >= {LEAST}")
def ret_10(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of spreading activation of all asks at once; RET-11 goes on to three hops."""
    return _spread(spark, d, retrieval.Budget(rounds=2, least=LEAST)).drop("typed_edge", "typed_gain", "ended")


@query("RET-11")
def ret_11(spark: SparkSession, d: str) -> DataFrame:
    """Three hops with the strongest path of each node and its typed evidence (here: SIMILAR edges): rounds depend on the
    scores of the one before, so tests hold it against a plain implementation."""
    return _spread(spark, d, retrieval.Budget(least=LEAST), ("SIMILAR",))


_LISTS = f"{_LEGS}, lists AS (SELECT id, CASE leg WHEN 'vector' THEN 0.4 WHEN 'label' THEN 0.3 ELSE 0.3 END AS weight, row_number() OVER (PARTITION BY leg ORDER BY score DESC, id) - 1 AS rank FROM (SELECT leg, id, max(score) AS score FROM legs GROUP BY 1, 2))"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    best = _legs(spark, d).groupBy("leg", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("leg").orderBy(F.desc("score"), "id")
    return best.select("id", "leg", F.when(F.col("leg") == "vector", 0.4).otherwise(0.3).alias("weight"), (F.row_number().over(w) - 1).alias("rank"))


@query("RET-12", f"WITH {_LISTS} SELECT id, weight::DOUBLE AS weight, rank FROM lists")
def ret_12(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("id", "weight", F.col("rank").cast("long").alias("rank"))


@query("RET-13", f"WITH {KNN}, a AS (SELECT DISTINCT id FROM knn WHERE rank > 5) SELECT q.vec_id AS cue, a.id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 5) AS relevance FROM a JOIN embeddings e ON e.vec_id = a.id CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0")
def ret_13(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals scored against every cue (the asked vectors)."""
    v = tables.vectors(spark, d).select("id", "vec")
    arrivals = v.join(knn(spark, d).filter("rank > 5").select("id").distinct(), "id", "left_semi")
    scored = functools.reduce(DataFrame.unionByName, retrieval.asked_pairs(v.filter("id % 100 = 0"), arrivals, skip_self=False))
    return scored.select(F.col("ask").alias("cue"), "id", F.round("score", 5).alias("relevance"))


@query("RET-14", f"WITH {_LISTS} SELECT l.id, round(sum(weight / (60 + rank + 1)) * max(CASE WHEN e.label IN (1, 2) THEN 1.25 ELSE 1 END) * max(CASE WHEN l.id % 10 = 3 THEN 0.5 ELSE 1 END), 8) AS score FROM lists l JOIN embeddings e ON e.vec_id = l.id GROUP BY 1")
def ret_14(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists, with a boost for the labels asked for and half the score for claims that were restated."""
    v = tables.vectors(spark, d)
    boosts = v.filter("label in (1, 2)").select("id", F.lit(1.25).alias("factor"))
    old = tables.restated(v).select((F.col("id") - 10_000_000).alias("id"), F.lit(weights.SUPERSEDED_FACTOR).alias("factor"))
    return retrieval.fuse(_lists(spark, d), factors=boosts.unionByName(old)).select("id", F.round("score", 8).alias("score"))


_EVID = "ev AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 'vector' WHEN 'A' THEN 'bm25' ELSE 'graph' END AS method, l_suppkey % 3 AS cue, l_discount * 4 AS relevance, l_quantity >= 50 AND l_returnflag = 'A' AS exact, l_tax * 2 AS contribution FROM lineitem)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") == "R", "vector").when(F.col("l_returnflag") == "A", "bm25").otherwise("graph").alias("method"), (F.col("l_suppkey") % 3).alias("cue"),
        (F.col("l_discount") * 4).alias("relevance"), ((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "A")).alias("exact"), (F.col("l_tax") * 2).alias("contribution"),
    )


_RULES = """m AS (SELECT id, max(relevance) FILTER (method = 'vector') AS cos, bool_or(exact) AS ex, count(DISTINCT method || cue) FILTER (relevance >= 0.33) AS kinds, bool_or(method = 'bm25') AS bm, max(contribution) AS con FROM ev GROUP BY 1),
    rules AS (SELECT id, CASE WHEN cos >= 0.35 THEN 'vector_floor' WHEN ex THEN 'exact_match' WHEN kinds >= 2 THEN 'corroborated' WHEN bm THEN 'bm25_any' WHEN con >= 0.14 AND cos >= 0.33 THEN 'typed_admission' ELSE 'none' END AS rule FROM m)"""


@query("RET-15", f"WITH {_EVID}, {_RULES} SELECT id, rule FROM rules")
def ret_15(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.admit(_evidence(spark, d))


@query("RET-16", f"WITH {_EVID}, {_RULES}, i AS (SELECT id, p_brand || ' ' || p_name AS name, row_number() OVER (PARTITION BY p_brand || ' ' || p_name ORDER BY id) AS same FROM rules JOIN part ON p_partkey = id WHERE rule <> 'none'), f AS (SELECT row_number() OVER (PARTITION BY substr(lower(trim(name)), 1, 16) ORDER BY id) AS near FROM i WHERE same = 1), o AS (SELECT cos FROM rules JOIN m USING (id) WHERE rule = 'none') SELECT (SELECT count(*) FROM f WHERE near <= 2) AS admitted, (SELECT count(*) FROM f WHERE near > 2) AS near_duplicate, (SELECT count(*) FROM i WHERE same > 1) AS duplicate, (SELECT count(*) FROM o WHERE cos IS NOT NULL) AS below_floor, (SELECT count(*) FROM o WHERE cos IS NULL) AS unmeasured")
def ret_16(spark: SparkSession, d: str) -> DataFrame:
    """What an admission let in and why the rest stayed out."""
    e = _evidence(spark, d)
    measured = e.groupBy("id").agg(F.max(F.when(F.col("method") == "vector", F.col("relevance"))).alias("cos"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    return retrieval.admission_report(retrieval.admit(e), measured, names)


_NEAR_LIST = "list_concat([0, 0, 0, 0]::DOUBLE[], embedding[5:]::DOUBLE[])"
_COS2 = "list_dot_product(x.vec, y.vec) / sqrt(list_dot_product(x.vec, x.vec) * list_dot_product(y.vec, y.vec))"


@query(
    "RET-17",
    f"""WITH RECURSIVE items AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, vec_id AS doc, label % 3 AS bucket FROM embeddings UNION ALL SELECT vec_id + 10000000, {_NEAR_LIST}, vec_id + 1, label % 3 FROM embeddings WHERE vec_id % 5 <> 0),
        l AS (SELECT x.id AS ask, y.id, y.bucket, y.vec, y.doc, {_COS2} AS score FROM items x JOIN items y ON true WHERE x.id % 100 = 0 AND x.id < 10000000 QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, y.id) <= 64),
        t AS (SELECT l.*, substr(lower(trim(text)), 1, 16) AS head FROM l LEFT JOIN documents ON doc_id = doc),
        e AS (SELECT x.ask, x.id AS u, y.id AS v FROM t x JOIN t y ON x.ask = y.ask AND x.bucket = y.bucket AND x.id <> y.id WHERE (x.head <> '' AND x.head = y.head) OR {_COS2} > 0.95),
        r(ask, id, root) AS (SELECT ask, id, id FROM t UNION SELECT r.ask, e.v, r.root FROM r JOIN e ON e.ask = r.ask AND e.u = r.id),
        c AS (SELECT ask, id, min(root) AS cluster FROM r GROUP BY 1, 2)
        SELECT ask, id, rank::INT AS rank FROM (SELECT ask, id, row_number() OVER (PARTITION BY ask, cluster ORDER BY score DESC, id) AS rank FROM c JOIN t USING (ask, id)) WHERE rank <= 2""",
)
def ret_17(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates in each ask's list of 64: alike by the first characters or by vector within a bucket, two of each stay.
    Restatements with another text are planted."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("vec_id").alias("doc"), (F.col("label") % 3).alias("bucket"))
    more = v.filter("id % 5 <> 0").select((F.col("id") + 10_000_000).alias("id"), F.concat(F.array_repeat(F.lit(0.0), 4), F.slice("vec", 5, 4096)).alias("vec"), (F.col("doc") + 1).alias("doc"), "bucket")
    items = staging.stage(v.unionByName(more), "items")
    near = retrieval.knn(items.filter("id % 100 = 0 and id < 10000000").select("id", "vec"), items.select("id", "vec"), 64, skip_self=False).drop("rank")
    head = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lower(F.substring(F.trim("text"), 1, 16)).alias("head"))
    rows = near.join(items, "id").join(head, "doc", "left").select("ask", "id", "score", "bucket", "head", "vec")
    return recall.capped(rows, recall.Limits())


@query("RET-18")
def ret_18(spark: SparkSession, d: str) -> DataFrame:
    """MMR order of each asked vector's ten neighbours."""
    v = tables.vectors(spark, d).select("id", "vec")
    return retrieval.mmr_groups(knn(spark, d).select(F.col("ask").alias("pack"), "id", "score").join(v, "id").select("pack", "id", "score", "vec"))


@query("RET-19", f"WITH {CLAIMS} SELECT id, round(value * CASE WHEN aspect IN ('1-URGENT', '2-HIGH') THEN 1.25 ELSE 1 END, 4) AS score FROM claims")
def ret_19(spark: SparkSession, d: str) -> DataFrame:
    boost = F.when(F.col("aspect").isin("1-URGENT", "2-HIGH"), 1.25).otherwise(1.0)
    return tables.claims(spark, d).select("id", F.round(F.col("value") * boost, 4).alias("score"))


@query("RET-20", f"WITH {KNN}, held AS (SELECT DISTINCT id FROM knn JOIN embeddings ON id = vec_id WHERE label IN (1, 2) AND score >= 0.2) SELECT DISTINCT k.id FROM knn k WHERE k.id NOT IN (SELECT id FROM held)")
def ret_20(spark: SparkSession, d: str) -> DataFrame:
    """Restatements (labels 1 and 2 close to the cue) are held back."""
    k = knn(spark, d)
    held = k.filter("score >= 0.2").join(tables.vectors(spark, d).filter("label in (1, 2)").select("id"), "id", "left_semi").select("id")
    return k.select("id").distinct().join(held, "id", "left_anti")


@query(
    "RET-21",
    f"""WITH RECURSIVE {_G0}, {_ACT}, first AS (SELECT ask, node, round(score, 6) AS score FROM act WHERE score >= {LEAST}),
        v AS (SELECT ask, score, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM first JOIN embeddings ON vec_id = node), c AS (SELECT ask, list(m ORDER BY i) AS vec FROM (SELECT ask, i, sum(x * score) / sum(score) AS m FROM v GROUP BY 1, 2) GROUP BY 1),
        s AS (SELECT ask, vec_id AS id, list_dot_product(c.vec, e.embedding::DOUBLE[]) / sqrt(list_dot_product(c.vec, c.vec) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score FROM embeddings e, c WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.ask = c.ask AND f.node = e.vec_id))
        SELECT ask, id, round(score, 4) AS score FROM s WHERE s.score >= 0.1 QUALIFY row_number() OVER (PARTITION BY ask ORDER BY s.score DESC, id) <= 5""",
)
def ret_21(spark: SparkSession, d: str) -> DataFrame:
    """Context resonance: the centroid of what each ask activates, weighted by activation, and its nearest that weren't in the
    first pass. The floor is 0.1, as the vectors are random."""
    first = staging.stage(_spread(spark, d, retrieval.Budget(rounds=2, least=LEAST)).select("ask", F.col("node").alias("id"), F.col("score").alias("weight")), "first-pass")
    return retrieval.resonance(first, tables.vectors(spark, d).select("id", "vec"), 64, 5, 0.1).select("ask", "id", F.round("score", 4).alias("score"))


#: Vectors as intentions: their subject is the part after them, every 41st has a date, and an ask's neighbours are activated.
_INTENTIONS = "it AS (SELECT vec_id AS id, vec_id + 1 AS subject, CASE WHEN vec_id % 41 = 0 THEN TIMESTAMP '2001-01-01' + INTERVAL (vec_id) DAY END AS after, embedding::DOUBLE[] AS vec FROM embeddings)"
_TRIGGERS = f"""{GRAPH}, {BOTH}, {_INTENTIONS}, ctx AS (SELECT vec_id AS ask, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 100 = 0), near AS (SELECT DISTINCT node AS ask, other AS node FROM both_ways WHERE node % 100 = 0 AND n >= 2),
    c AS (SELECT ctx.ask, it.id, list_dot_product(ctx.vec, it.vec) / sqrt(list_dot_product(ctx.vec, ctx.vec) * list_dot_product(it.vec, it.vec)) AS cos, near.node IS NOT NULL AS on_entity, coalesce(after <= TIMESTAMP '2001-06-01', false) AS due
        FROM ctx JOIN it ON it.id <> ctx.ask LEFT JOIN near ON near.ask = ctx.ask AND near.node = it.subject),
    m AS (SELECT ask, id, CASE WHEN on_entity THEN 0 WHEN due THEN 1 WHEN cos >= 0.1 THEN 2 END AS k, CASE WHEN on_entity OR due THEN 1.0 ELSE cos END AS score FROM c)"""


def _triggered(spark: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(spark, d).select("id", "vec")
    after = F.when(F.col("id") % 41 == 0, F.to_timestamp(F.lit("2001-01-01")) + F.make_dt_interval(F.col("id").cast("int")))
    asks = v.filter("id % 100 = 0").select(F.col("id").alias("ask"), "vec")
    near = _both(spark, d).filter("node % 100 = 0 and n >= 2").select(F.col("node").alias("ask"), F.col("other").alias("node")).distinct()
    near = near.join(asks.select("ask"), "ask", "left_semi")
    return intentions.triggered(v.select("id", (F.col("id") + 1).alias("subject"), after.alias("after"), "vec"), asks, near, "2001-06-01", 0.1, 5, asks.select("ask", F.col("ask").alias("id")))


@query("RET-22", f"WITH {_TRIGGERS} SELECT ask, id, CASE k WHEN 0 THEN 'entity' WHEN 1 THEN 'temporal' ELSE 'situation' END AS kind, round(score, 5) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY k, score DESC, id) AS place FROM m WHERE k IS NOT NULL) WHERE place <= 5")
def ret_22(spark: SparkSession, d: str) -> DataFrame:
    """Intentions that asks trigger: by an activated subject, a date that has come, or a near situation (0.1: random vectors)."""
    return _triggered(spark, d).select("ask", "id", "kind", F.round("score", 5).alias("score"), "place")


@query(
    "RET-23",
    f"""WITH {_SOUGHT}, turns AS (SELECT conv_id * 1000 + turn AS id, text, (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings) AS v, conv_id % 20 AS episode FROM conversations),
        a AS (SELECT DISTINCT t.id AS turn, subject, v, episode FROM turns t JOIN sought ON length(name) >= 3 AND contains(lower(text), name)),
        c AS (SELECT doc_id AS claim, text, doc_id % 20 AS episode FROM documents), h AS (SELECT DISTINCT claim, subject, episode FROM c JOIN (SELECT * FROM sought WHERE subject IN (SELECT subject FROM a)) ON length(name) >= 3 AND contains(lower(text), name)),
        p AS (SELECT DISTINCT turn, claim, v FROM a JOIN h USING (subject) WHERE a.episode <> h.episode),
        s AS (SELECT turn, claim, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]) * list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS r FROM p JOIN embeddings x ON x.vec_id = v JOIN embeddings y ON y.vec_id = claim)
        SELECT turn, claim, round(r, 5) AS relatedness FROM s WHERE r >= 0.1 QUALIFY row_number() OVER (PARTITION BY turn ORDER BY r DESC, claim) = 1""",
)
def ret_23(spark: SparkSession, d: str) -> DataFrame:
    """The claim beside each turn: documents as claims with vectors of their id. The floor is 0.1, as the vectors are random."""
    v = tables.vectors(spark, d).select("id", "vec")
    n = v.count()
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", ((F.col("conv_id") * 7 + F.col("turn")) % n).alias("v"), (F.col("conv_id") % 20).alias("episode"))
    turns = turns.join(v.withColumnsRenamed({"id": "v"}), "v").drop("v")
    claims = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 20).alias("episode")).join(v, "id")
    return names.related_claims(turns, claims, _sought(spark, d), 0.1).select("turn", "claim", F.round("relatedness", 5).alias("relatedness"))


@query("RET-24", "WITH b AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'episodes' WHEN 'assistant' THEN 'facts' ELSE 'narratives' END AS bucket FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bucket ORDER BY turn DESC) AS place FROM b) SELECT conv_id, turn, bucket FROM r WHERE place <= CASE bucket WHEN 'facts' THEN 2 WHEN 'episodes' THEN 3 ELSE 1 END")
def ret_24(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.when(F.col("role") == "user", "episodes").when(F.col("role") == "assistant", "facts").otherwise("narratives")
    cap = F.when(F.col("bucket") == "facts", 2).when(F.col("bucket") == "episodes", 3).otherwise(1)
    w = Window.partitionBy("conv_id", "bucket").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("bucket", bucket).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).select("conv_id", "turn", "bucket")


@query("RET-25", f"WITH {KNN} SELECT 'access' AS event, id, NULL::BIGINT AS other, count(*) AS n FROM knn GROUP BY 2 UNION ALL SELECT 'co_activation', a.id, b.id, count(*) FROM knn a JOIN knn b ON a.ask = b.ask AND a.id < b.id GROUP BY 2, 3")
def ret_25(spark: SparkSession, d: str) -> DataFrame:
    """After a recall: an access of each served node, and the pairs of each recall's ten best."""
    k = staging.stage(knn(spark, d).select("ask", "id"), "served")
    access = k.groupBy("id").agg(N().alias("n")).select(F.lit("access").alias("event"), "id", F.lit(None).cast("long").alias("other"), "n")
    pairs = k.join(k.withColumnRenamed("id", "other"), "ask").filter("id < other").groupBy("id", "other").agg(N().alias("n"))
    return access.unionByName(pairs.select(F.lit("co_activation").alias("event"), "id", "other", "n"))


@query("RET-26", "SELECT o_custkey, count(*) AS pending FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def ret_26(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").groupBy("o_custkey").agg(N().alias("pending"))


@query(
    "RET-27",
    f"""WITH {_TRIGGERS}, ran AS (SELECT ask, k FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY k, score DESC, id) AS place FROM m WHERE k IS NOT NULL) WHERE place <= 5)
        SELECT ctx.ask, CASE WHEN ctx.ask % 300 = 0 THEN 'time-travel' WHEN count(k) = 0 THEN 'none-triggered' ELSE 'run' END AS outcome, CASE WHEN ctx.ask % 300 = 0 THEN 0 ELSE count(k) END AS n, CASE WHEN ctx.ask % 300 = 0 THEN 0 ELSE count(*) FILTER (k = 0) END AS by_entity FROM ctx LEFT JOIN ran ON ran.ask = ctx.ask GROUP BY 1""",
)
def ret_27(spark: SparkSession, d: str) -> DataFrame:
    """The intention stage of each ask: skipped where another time is read (every third ask) or nothing triggers, else run."""
    asks = tables.vectors(spark, d).filter("id % 100 = 0").select(F.col("id").alias("ask"))
    per = _triggered(spark, d).groupBy("ask").agg(N().alias("n"), F.count_if(F.col("kind") == "entity").alias("by_entity"))
    per = asks.join(per, "ask", "left").na.fill(0, ["n", "by_entity"])
    other = F.col("ask") % 300 == 0
    why = F.when(other, "time-travel").when(F.col("n") == 0, "none-triggered").otherwise("run")
    return per.select("ask", why.alias("outcome"), F.when(other, 0).otherwise(F.col("n")).alias("n"), F.when(other, 0).otherwise(F.col("by_entity")).alias("by_entity"))


@query("RET-28", f"WITH {_EVID}, {_RULES} SELECT id, rule FROM rules WHERE rule IN ('typed_admission', 'corroborated')")
def ret_28(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.admit(_evidence(spark, d)).filter(F.col("rule").isin("typed_admission", "corroborated"))


@query("RET-29", f"WITH {KNN} SELECT e.label = q.label AS related, count(*) AS n, round(quantile_cont(score, 0.05), 5) AS p05, round(quantile_cont(score, 0.95), 5) AS p95 FROM knn JOIN embeddings e ON e.vec_id = knn.id JOIN embeddings q ON q.vec_id = knn.ask GROUP BY 1")
def ret_29(spark: SparkSession, d: str) -> DataFrame:
    """Floors measured again over labelled pairs."""
    v = tables.vectors(spark, d).select("id", "label")
    k = knn(spark, d).join(v, "id").join(v.select(F.col("id").alias("ask"), F.col("label").alias("ask_label")), "ask")
    q = quantiles(k.withColumn("related", F.col("label") == F.col("ask_label")), "related", "score", [0.05, 0.95])
    return q.select("related", "n", F.round("q0", 5).alias("p05"), F.round("q1", 5).alias("p95"))


@query(
    "hybrid_recall",
    f"""WITH {KNN}, near AS (SELECT ask, id, score, rank - 1 AS rank FROM knn), lab AS (SELECT ask, b.vec_id AS id, row_number() OVER (PARTITION BY ask ORDER BY b.vec_id) - 1 AS rank FROM (SELECT DISTINCT ask FROM near) n JOIN embeddings a ON a.vec_id = n.ask JOIN embeddings b ON b.label = a.label AND b.vec_id <> a.vec_id),
        fused AS (SELECT ask, id, sum(s) AS score, max(cos) AS cos FROM (SELECT ask, id, 0.4 / (61 + rank) AS s, score AS cos FROM near UNION ALL SELECT ask, id, 0.3 / (61 + rank), NULL FROM lab WHERE rank < 10) GROUP BY 1, 2)
        SELECT ask, id, round(score, 8) AS score, CASE WHEN cos >= 0.1 THEN 'vector_floor' ELSE 'corroborated' END AS rule, row_number() OVER (PARTITION BY ask ORDER BY round(score, 8) DESC, id)::INT AS place FROM fused""",
)
def hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid recall: vector neighbours and a label leg, fused by reciprocal rank, admitted and ranked."""
    v = tables.vectors(spark, d)
    near = knn(spark, d).select("ask", "id", (F.col("rank") - 1).alias("rank"), "score")
    of_label = v.filter("id % 100 = 0").select(F.col("id").alias("ask"), "label")
    # the first members of a label are enough for a leg of ten, so labels of any size stay cheap
    first = v.select("id", "label", F.row_number().over(Window.partitionBy("label").orderBy("id")).alias("r")).filter("r <= 11")
    lab = first.join(of_label, "label").filter("id <> ask")
    lab = lab.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy("id")) - 1).filter("rank < 10")
    legs = near.select("ask", "id", weights.rrf(F.col("rank"), 0.4).alias("s"), F.col("score").alias("cos")).unionByName(lab.select("ask", "id", weights.rrf(F.col("rank"), 0.3).alias("s"), F.lit(None).cast("double").alias("cos")))
    fused = legs.groupBy("ask", "id").agg(F.round(F.sum("s"), 8).alias("score"), F.max("cos").alias("cos"))
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    return fused.select("ask", "id", "score", F.when(F.col("cos") >= 0.1, "vector_floor").otherwise("corroborated").alias("rule"), F.row_number().over(w).alias("place"))


def _memory(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a memory's items: with the vector and the part's name of the same id."""
    docs, p = table(spark, d, "documents"), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    docs = docs.select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("at"), F.ceil(F.length("text") / 4).cast("long").alias("tokens"), (F.col("doc_id") % 97).alias("episode"))
    items = docs.join(tables.vectors(spark, d), "id", "left").join(p, "id", "left")
    bucket = F.when(F.col("id") % 3 == 0, "facts").when(F.col("id") % 3 == 1, "episodes").otherwise("narratives")
    return staging.stage(items.select("id", "vec", "text", "name", "at", bucket.alias("bucket"), "tokens", "episode"), "memory")


def _recall(spark: SparkSession, d: str) -> DataFrame:
    """Every item whose id is divisible by 100 is asked for: by its vector without the first places, its first line, its name."""
    m = _memory(spark, d)
    vec = F.concat(F.array_repeat(F.lit(0.0), 8), F.slice("vec", 9, 4096).cast("array<double>"))
    asks = staging.stage(m.filter("id % 100 = 0").select(F.col("id").alias("ask"), vec.alias("vec"), F.substring_index("text", "\n", 1).alias("text"), F.concat("name", F.lit("s")).alias("name")), "asks")
    return recall.recall(asks, m, _staged_both(spark, d), staging.stage(_superseded(spark, d), "superseded"), budget=retrieval.Budget(least=LEAST))


@query("recall")
def recall_(spark: SparkSession, d: str) -> DataFrame:
    """The whole recall of all asks, from legs to packs; tests hold it against a plain recall of one ask at a time."""
    return _recall(spark, d).select("ask", "id", "place", "bucket", F.round("score", 8).alias("score"), "rule", "legs", "hops", "path")


@query("vector_index", f"WITH {KNN} SELECT ask, id, rank::INT AS rank, round(score, 5) AS score FROM knn WHERE score > 0")
def vector_index_(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every asked vector from inverted lists, in the exact mode."""
    v = tables.vectors(spark, d).select("id", "vec")
    index = vector_index.build(v, 64, 16)
    asks = v.filter("id % 100 = 0")
    found = vector_index.search(index, asks, 11, 4, exact=True).filter("ask <> id and score > 0")  # one more, for the ask itself
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("ask", "id", "rank", F.round("score", 5).alias("score"))
