"""Queries on writes, lineage and entity resolution: WR-*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import hashing, text
from palimpsest.operators import bitemporal, entities, graph, retrieval, staging, upkeep
from palimpsest.plans.aggregate import N, r6
from palimpsest.plans.registry import query
from palimpsest.sources import tables
from palimpsest.sources.tables import CLAIMS, GRAPH, MENTIONS, RESTATED, table


@query("WR-1", "SELECT event_id % 97 AS id, arg_max(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS tx_from FROM events GROUP BY 1")
def wr_1(spark: SparkSession, d: str) -> DataFrame:
    """Upserts as appends: the latest state by id."""
    e = table(spark, d, "events").withColumns({"id": F.col("event_id") % 97, "tx_from": F.unix_micros("ts")})
    return bitemporal.latest(e, ["id"], [F.col("tx_from"), F.col("event_id")], ["event_type", "tx_from"])


@query(
    "WR-2",
    """WITH o AS (SELECT l_partkey AS src, l_suppkey AS dst, 0.05 + l_discount AS eta, l_returnflag = 'R' AND l_quantity >= 45 AS closes, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem),
            c AS (SELECT src, dst, max(i) FILTER (closes) AS last, max(i) AS i FROM o GROUP BY 1, 2), k AS (SELECT o.*, coalesce(c.last = c.i, false) AS closed, coalesce(c.last, 0) AS last FROM o JOIN c USING (src, dst)),
            f AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY i) AS j FROM k WHERE NOT closes AND (i > last OR closed) AND (NOT closed OR i > coalesce((SELECT max(p.i) FROM o p WHERE p.src = k.src AND p.dst = k.dst AND p.closes AND p.i < k.last), 0)))
       SELECT src, dst, round(1 - product(CASE WHEN j = 1 THEN 1 - greatest(eta, 0.1) ELSE 1 - eta END), 10) AS strength, count(*) AS n, bool_or(closed) AS closed FROM f GROUP BY 1, 2""",
)
def wr_2(spark: SparkSession, d: str) -> DataFrame:
    """Edge strength by bounded steps; large returns close an edge, and one that is seen again begins anew."""
    o = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.lit(0.05) + F.col("l_discount")).alias("eta"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("closes"), "l_shipdate", "l_orderkey", "l_linenumber"
    )
    return entities.reopened_steps(o, ["src", "dst"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("src", "dst", F.round("strength", 10).alias("strength"), "n", "closed")


@query("WR-3", "SELECT o_orderkey AS id, epoch_us(min(c)) AS valid_until FROM (SELECT o_orderkey, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def wr_3(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("timestamp").alias("valid_until"))
    closures = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"))
    return bitemporal.close(nodes, closures).select("id", F.unix_micros("valid_until").alias("valid_until"))


@query("WR-4", f"WITH {MENTIONS}, closed AS (SELECT o_orderkey AS episode FROM orders WHERE o_orderstatus = 'F') SELECT DISTINCT entity FROM mentions WHERE episode IN (SELECT episode FROM closed) AND entity NOT IN (SELECT entity FROM mentions WHERE episode NOT IN (SELECT episode FROM closed))")
def wr_4(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose only sources are closed episodes; every line is a source."""
    m = tables.mentions(spark, d).select("episode", "entity")
    closed = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("episode"))
    gone = m.join(closed, "episode", "left_semi").select("entity").distinct()
    return gone.join(m.join(closed, "episode", "left_anti").select("entity").distinct(), "entity", "left_anti")


@query("WR-5", f"WITH {RESTATED} SELECT k.id, min(k.ask) AS closed_by FROM restated k JOIN embeddings a ON a.vec_id = k.ask - 10000000 JOIN embeddings b ON b.vec_id = k.id WHERE a.label = b.label AND score >= 0.6 GROUP BY 1")
def wr_5(spark: SparkSession, d: str) -> DataFrame:
    """Family close: earlier claims of a restatement's subject (label) whose cosine with it is 0.6 or more."""
    v = tables.vectors(spark, d)
    new = tables.restated(v)
    k = retrieval.knn(new, v, 10, 0.6).join(v.select("id", "label"), "id").join(new.select(F.col("id").alias("ask"), F.col("label").alias("ask_label")), "ask").filter("label = ask_label")
    return k.groupBy("id").agg(F.min("ask").alias("closed_by"))


@query("WR-6", f"WITH {CLAIMS} SELECT id, superseded_by, epoch_us(valid_until) AS closed_at FROM claims WHERE superseded_by IS NOT NULL")
def wr_6(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).filter("superseded_by is not null").select("id", "superseded_by", F.unix_micros("valid_until").alias("closed_at"))


@query(
    "WR-7",
    f"""WITH {CLAIMS}, u AS (SELECT l_orderkey AS id, l_shipdate AS undo_at FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)
        SELECT c.id, CASE WHEN undone THEN NULL ELSE superseded_by END AS superseded_by, CASE WHEN undone THEN NULL ELSE epoch_us(valid_until) END AS valid_until, superseded_by AS lineage, epoch_us(tx_until) AS edge_from, CASE WHEN undone THEN epoch_us(undo_at) END AS edge_until
        FROM (SELECT *, undo_at IS NOT NULL AS undone FROM (SELECT claims.*, (SELECT min(undo_at) FROM u WHERE u.id = claims.id AND undo_at >= claims.tx_until) AS undo_at FROM claims)) c WHERE superseded_by IS NOT NULL""",
)
def wr_7(spark: SparkSession, d: str) -> DataFrame:
    """Unsupersede: events after a supersession was written take the stamps off and close the lineage edge in transaction time."""
    undo = table(spark, d, "lineitem").filter("l_returnflag = 'A' and l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"))
    c = tables.claims(spark, d).filter("superseded_by is not null").select("id", "superseded_by", "valid_until", F.col("tx_until").alias("superseded_at"))
    n = bitemporal.unsupersede(c, undo)
    return n.select("id", "superseded_by", F.unix_micros("valid_until").alias("valid_until"), "lineage", F.unix_micros("edge_from").alias("edge_from"), F.unix_micros("edge_until").alias("edge_until"))


@query("WR-8", f"WITH {CLAIMS}, f AS (SELECT l_orderkey AS id, min(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 GROUP BY 1) SELECT c.id, epoch_us(coalesce(c.forgotten_at, f.at)) AS forgotten_at FROM claims c LEFT JOIN f ON f.id = c.id")
def wr_8(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").filter("l_returnflag = 'A' and l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"))
    return bitemporal.forget(tables.claims(spark, d).select("id", "forgotten_at"), f).select("id", F.unix_micros("forgotten_at").alias("forgotten_at"))


@query(
    "WR-9",
    """WITH RECURSIVE k AS (SELECT lower(p_name) AS name_norm, min(p_partkey) AS id FROM part GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY name_norm) AS i FROM k),
            e AS (SELECT name_norm, n.id, CASE WHEN i % 3 <> 0 THEN (SELECT id FROM n m WHERE m.i = n.i + 1) END AS merged_into, n.id % 2 = 0 AS closed FROM n),
            w(start, id, depth) AS (SELECT id, id, 0 FROM e UNION ALL SELECT w.start, e.merged_into, depth + 1 FROM w JOIN e ON e.id = w.id WHERE e.merged_into IS NOT NULL AND depth < 8), h AS (SELECT start, arg_max(id, depth) AS head FROM w GROUP BY 1),
            o AS (SELECT name_norm, count(*) AS n FROM (SELECT lower(p_name) AS name_norm FROM part UNION ALL SELECT 'new ' || lower(p_brand) FROM part) GROUP BY 1)
       SELECT o.name_norm, coalesce(h.head::VARCHAR, sha256('entity' || chr(0) || o.name_norm)) AS id, CASE WHEN h.head IS NULL THEN 'created' WHEN t.closed THEN 'reopened' ELSE 'found' END AS action, n FROM o LEFT JOIN e USING (name_norm) LEFT JOIN h ON h.start = e.id LEFT JOIN e t ON t.id = h.head""",
)
def wr_9(spark: SparkSession, d: str) -> DataFrame:
    """Entity upserts by folded name over planted merges in chains: the head of the chain is found, reopened if it is closed;
    unknown names are created."""
    p = table(spark, d, "part")
    known = staging.stage(p.groupBy(text.fold_ascii(F.col("p_name")).alias("name_norm")).agg(F.min("p_partkey").alias("id")), "entities")
    w = Window.orderBy("name_norm")  # of the few names of parts
    e = known.withColumns({"i": F.row_number().over(w), "next": F.lead("id").over(w)})
    e = e.select("name_norm", "id", F.when(F.col("i") % 3 != 0, F.col("next")).alias("merged_into"), (F.col("id") % 2 == 0).alias("closed"))
    seen = p.select(F.explode(F.array("p_name", F.concat(F.lit("new "), "p_brand"))).alias("name"))
    return entities.upsert(seen, staging.stage(e, "merged")).select("name_norm", "id", "action", "n")


_G0 = f"{MENTIONS}, ment AS (SELECT entity, count(*) AS k FROM mentions GROUP BY 1), g AS (SELECT p_partkey AS id, translate(lower(p_name), '-_./ ', '') AS squash, coalesce(k, 0) AS k FROM part LEFT JOIN ment ON entity = p_partkey), canon AS (SELECT id, first_value(id) OVER (PARTITION BY squash ORDER BY k DESC, id) AS canonical FROM g)"


@query("WR-10", f"WITH {_G0} SELECT id, canonical FROM canon WHERE id <> canonical")
def wr_10(spark: SparkSession, d: str) -> DataFrame:
    """Tier 0: equal squashed names; the most mentioned, then least id, is canonical."""
    return entities.canonical(_entities(spark, d), "squash").filter("id <> canonical")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    k = tables.mentions(spark, d).groupBy(F.col("entity").alias("id")).agg(N().alias("k"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.squash(text.fold_ascii(F.col("p_name"))).alias("squash"))
    return p.join(k, "id", "left").na.fill(0, ["k"])


@query(
    "WR-11",
    f"""WITH {RESTATED}, m AS (SELECT l_partkey AS item, l_orderkey AS member FROM lineitem UNION SELECT l_partkey + 10000000, l_orderkey FROM lineitem WHERE l_partkey % 10 = 3 AND l_orderkey % 2 = 0), s AS (SELECT item, count(*) AS k FROM m GROUP BY 1),
        j AS (SELECT a.item AS a, b.item AS b, count(*) AS inter FROM m a JOIN m b ON a.member = b.member AND a.item < b.item GROUP BY 1, 2),
        n AS (SELECT least(ask, id) AS a, greatest(ask, id) AS b, 'vector' AS how FROM restated WHERE score >= 0.53 AND rank <= 8 UNION SELECT a, b, 'episodes' FROM j JOIN s x ON x.item = a JOIN s y ON y.item = b WHERE inter / (x.k + y.k - inter)::DOUBLE >= 0.1)
        SELECT a, b, string_agg(how, ',' ORDER BY how) AS how FROM n GROUP BY 1, 2""",
)
def wr_11(spark: SparkSession, d: str) -> DataFrame:
    """Nominations by vector and by shared episodes, each pair once; new names are planted, with half of the old one's episodes."""
    v = tables.vectors(spark, d)
    near = retrieval.knn(tables.restated(v), v, 8, 0.53)
    near = near.select(F.least("ask", "id").alias("a"), F.greatest("ask", "id").alias("b"), F.lit("vector").alias("how"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("member"))
    new = lines.filter("item % 10 = 3 and member % 2 = 0").withColumn("item", F.col("item") + 10_000_000)
    shared = graph.jaccard(lines.union(new).distinct(), 0.1).select("a", "b", F.lit("episodes").alias("how"))
    return near.union(shared).groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("how")), ",").alias("how"))


_REDIR = f"{GRAPH.replace(MENTIONS + ', ', '')}, moved AS (SELECT type, x.canonical AS a, y.canonical AS b, strength, n FROM edges JOIN canon x ON x.id = src JOIN canon y ON y.id = dst WHERE x.canonical <> y.canonical)"


@query("WR-12", f"WITH {_G0}, {_REDIR} SELECT type, least(a, b) AS src, greatest(a, b) AS dst, round(max(strength), 6) AS strength, sum(n)::BIGINT AS n FROM moved GROUP BY 1, 2, 3")
def wr_12(spark: SparkSession, d: str) -> DataFrame:
    """Edges of merged entities redirected to their canonical ones and folded."""
    canon = entities.canonical(_entities(spark, d), "squash")
    return entities.redirect(tables.edges(spark, d), canon).withColumn("strength", r6("strength"))


@query("WR-13", f"WITH {_G0}, undone AS (SELECT id, CASE WHEN id % 10 = 0 THEN id ELSE canonical END AS canonical FROM canon), {_REDIR.replace('canon x', 'undone x').replace('canon y', 'undone y')} SELECT type, least(a, b) AS src, greatest(a, b) AS dst, round(max(strength), 6) AS strength, sum(n)::BIGINT AS n FROM moved GROUP BY 1, 2, 3")
def wr_13(spark: SparkSession, d: str) -> DataFrame:
    """Unmerge: the same without the undone rows of the map."""
    canon = entities.canonical(_entities(spark, d), "squash").withColumn("canonical", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.col("canonical")))
    return entities.redirect(tables.edges(spark, d), canon).withColumn("strength", r6("strength"))


@query("WR-14", f"WITH {_G0} SELECT l_orderkey, l_linenumber, canonical AS subject FROM lineitem JOIN canon ON id = l_partkey WHERE l_partkey <> canonical")
def wr_14(spark: SparkSession, d: str) -> DataFrame:
    canon = entities.canonical(_entities(spark, d), "squash")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"))
    return lines.join(canon, "id").filter("id <> canonical").select("l_orderkey", "l_linenumber", F.col("canonical").alias("subject"))


@query(
    "WR-15",
    f"""WITH {CLAIMS}, v AS (SELECT id, subject, aspect, valid_from, id % (SELECT count(*) FROM embeddings) AS vec FROM claims), new AS (SELECT * FROM v WHERE id % 100 = 0),
        k AS (SELECT n.id, arg_max(o.id, (o.valid_from, o.id)) AS other, 1 AS tier, NULL::DOUBLE AS score FROM new n JOIN v o ON o.subject = n.subject AND o.aspect = n.aspect AND (o.valid_from, o.id) < (n.valid_from, n.id) GROUP BY 1),
        s AS (SELECT n.id, o.id AS other, 2 AS tier, NULL::DOUBLE AS score FROM new n JOIN v o ON o.subject = n.subject AND (o.valid_from, o.id) < (n.valid_from, n.id) QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY o.valid_from DESC, o.id DESC) <= 3),
        c AS (SELECT n.id, o.id AS other, 3 AS tier, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]) * list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS score
            FROM new n JOIN embeddings x ON x.vec_id = n.vec JOIN embeddings y ON true JOIN v o ON o.id = y.vec_id WHERE o.id <> n.id),
        a AS (SELECT * FROM k UNION ALL SELECT * FROM s UNION ALL SELECT * FROM c WHERE score >= 0.75), f AS (SELECT id, other, min(tier) AS tier, max(score) AS score FROM a GROUP BY 1, 2)
        SELECT id, other, tier FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, score DESC NULLS LAST, other DESC) <= 3""",
)
def wr_15(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for contradiction of every claim whose id is divisible by 100, among all claims: the keyed predecessor, the
    subject's latest ones, and those whose vector is near. A claim's vector is that of its id by the number of vectors."""
    v = staging.stage(tables.vectors(spark, d).select("id", "vec"), "vectors")
    n = v.count()
    c = tables.claims(spark, d).select("id", "subject", "aspect", F.col("valid_from").alias("at"))
    new = c.filter("id % 100 = 0").select("id", (F.col("id") % n).alias("v")).join(v.withColumnRenamed("id", "v"), "v").select("id", "vec")
    held = v.join(c.select("id"), "id", "left_semi")
    return entities.contradiction_candidates(c, F.col("id") % 100 == 0, new, held).select("id", "other", "tier")


@query("WR-16", "WITH p AS (SELECT user_id AS pair, event_type, ts, event_id FROM events) SELECT pair, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'dismissed' ELSE 'open' END AS state FROM p GROUP BY 1")
def wr_16(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("pair", F.col("user_id"))
    state = F.when(F.col("event_type") == "purchase", "applied").when(F.col("event_type") == "error", "dismissed").otherwise("open")
    return bitemporal.latest(e, ["pair"], [F.col("ts"), F.col("event_id")], ["event_type"]).select("pair", state.alias("state"))


@query("WR-17", f"WITH {MENTIONS}, size AS (SELECT episode, count(*) AS k FROM mentions GROUP BY 1), p AS (SELECT a.episode, a.entity AS src, b.entity AS dst, 1.0 / (k - 1) AS eta, row_number() OVER (PARTITION BY a.entity, b.entity ORDER BY a.episode) AS i FROM mentions a JOIN mentions b ON a.episode = b.episode AND a.entity < b.entity JOIN size s ON s.episode = a.episode) SELECT src, dst, round(1 - product(CASE WHEN i = 1 THEN 1 - greatest(eta, 0.1) ELSE 1 - eta END), 6) AS strength, count(*) AS n FROM p GROUP BY 1, 2")
def wr_17(spark: SparkSession, d: str) -> DataFrame:
    """Co-occurrence edges by bounded steps of 1 / (n - 1)."""
    m = tables.mentions(spark, d).select("episode", "entity")
    size = m.groupBy("episode").agg(N().alias("k"))
    p = m.withColumnRenamed("entity", "src").join(m.withColumnRenamed("entity", "dst"), "episode").filter("src < dst").join(size, "episode").withColumn("eta", 1 / (F.col("k") - 1))
    return entities.bounded_steps(p, ["src", "dst"], ["episode"]).select("src", "dst", r6("strength").alias("strength"), "n")


@query(
    "WR-18",
    """WITH p AS (SELECT conv_id, turn, text, conv_id AS source, turn + 1 AS target, upper(trim(CASE turn % 3 WHEN 0 THEN ' causes ' WHEN 1 THEN 'ENABLES' ELSE 'likes' END)) AS type, trim(substr(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 2, 3)) AS quote FROM conversations)
       SELECT conv_id, turn, type, source, target, min(quote) AS quote FROM p WHERE type IN ('CAUSES', 'ENABLES', 'PRECEDES', 'CONTRADICTS', 'SIMILAR', 'RELATED_TO', 'ANALOGOUS_TO') AND source <> target AND quote <> '' AND contains(text, quote)
         AND source IN (SELECT c_custkey FROM customer) AND target IN (SELECT c_custkey FROM customer) GROUP BY 1, 2, 3, 4, 5""",
)
def wr_18(spark: SparkSession, d: str) -> DataFrame:
    """Proposals with a quote from the next turn, which this turn's text may or may not hold."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    kind = F.when(F.col("turn") % 3 == 0, " causes ").when(F.col("turn") % 3 == 1, "ENABLES").otherwise("likes")
    t = table(spark, d, "conversations").withColumn("quote", F.substring(F.lead("text").over(w), 2, 3))
    p = t.select(F.struct("conv_id", "turn").alias("episode"), "text", kind.alias("type"), F.col("conv_id").alias("source"), (F.col("turn") + 1).alias("target"), "quote")
    kept = upkeep.checked_relations(p, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))
    return kept.select("episode.conv_id", "episode.turn", "type", "source", "target", "quote")


@query(
    "WR-19",
    """WITH e AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, lower(p_name) AS name_norm, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE p_size % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'tool' ELSE 'topic' END AS type, lower(p_brand) AS alias, l_returnflag = 'R' AS sp FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 50 <> 0),
            g AS (SELECT id, name_norm, min(place) AS place, arg_min(name, place) AS name, string_agg(DISTINCT type, ',' ORDER BY type) AS types, list_sort(list(DISTINCT alias))[:8] AS aliases, bool_or(sp) AS is_speaker FROM e GROUP BY 1, 2)
       SELECT id, name_norm, name, types, array_to_string(aliases, ',') AS aliases, is_speaker FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS r FROM g) WHERE r <= 3""",
)
def wr_19(spark: SparkSession, d: str) -> DataFrame:
    """Entities of extraction payloads planted from each order's lines, every fiftieth of them cut off; three a payload."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size")
    kind = F.when(F.col("p_size") % 3 == 0, "person").when(F.col("p_size") % 3 == 1, "tool").otherwise("unheard of")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  "), F.regexp_replace(F.upper("p_name"), " ", "  "))).otherwise(F.col("p_name"))
    e = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(name.alias("name"), kind.alias("type"), F.array("p_brand").alias("aliases"), (F.col("l_returnflag") == "R").alias("is_speaker")).alias("e"))
    lines = table(spark, d, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(e)).alias("lines"))
    payload = F.to_json(F.struct(F.transform("lines", lambda x: x["e"]).alias("entities")))
    payloads = lines.select("id", F.when(F.col("id") % 50 == 0, F.substring(payload, 1, 20)).otherwise(payload).alias("payload"))
    found = upkeep.extracted_entities(payloads, ("person", "tool", "topic"), most=3)
    return found.select("id", "name_norm", "name", F.array_join("types", ",").alias("types"), F.array_join("aliases", ",").alias("aliases"), "is_speaker")


@query("WR-20", f"WITH {MENTIONS} SELECT episode, entity, n FROM mentions")
def wr_20(spark: SparkSession, d: str) -> DataFrame:
    return tables.mentions(spark, d)


_ALIAS = "al AS (SELECT l_orderkey AS episode, split_part(p_name, ' ', 1) AS alias, min(p_partkey) AS id, count(DISTINCT p_partkey) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


@query("WR-21", f"WITH {_ALIAS}, q AS (SELECT DISTINCT l_orderkey AS episode, split_part(p_name, ' ', 1) AS named, l_orderkey % 5 = 0 AS first_person FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT q.episode, q.named, CASE WHEN first_person THEN -1 WHEN k = 1 THEN id END AS subject FROM q LEFT JOIN al ON al.episode = q.episode AND al.alias = q.named")
def wr_21(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of claims: first person, else the single holder of the name in the episode."""
    named = F.split("p_name", " ")[0]
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), named.alias("named"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), "l_partkey").join(p, "l_partkey")
    holders = lines.groupBy("episode", "named").agg(F.min("l_partkey").alias("id"), F.max("l_partkey").alias("other"))
    return holders.select("episode", "named", F.when(F.col("episode") % 5 == 0, F.lit(-1).cast("long")).when(F.col("id") == F.col("other"), F.col("id")).alias("subject"))


@query(
    "WR-22",
    """WITH names AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'i' WHEN 1 THEN lower(n_name) WHEN 2 THEN 'land ' || n_nationkey WHEN 3 THEN 'realm ' || n_regionkey ELSE lower(c_name) END AS name, c_custkey % 5 = 0 AS sp FROM customer JOIN nation ON n_nationkey = c_nationkey),
            ids AS (SELECT lower(n_name) AS name, n_nationkey::VARCHAR AS id, n_regionkey FROM nation), al AS (SELECT alias, min(id) AS id FROM (SELECT 'land ' || n_nationkey AS alias, n_nationkey::VARCHAR AS id FROM nation UNION SELECT 'realm ' || n_regionkey, n_nationkey::VARCHAR FROM nation) GROUP BY 1 HAVING count(DISTINCT id) = 1)
       SELECT c_custkey, CASE WHEN sp THEN 'speaker' WHEN i.n_regionkey = 0 THEN 'structural' WHEN i.id IS NOT NULL THEN 'name' WHEN al.id IS NOT NULL THEN 'alias' ELSE 'new' END AS tier, coalesce(CASE WHEN sp THEN 'me' END, i.id, al.id, sha256('entity' || chr(0) || names.name)) AS entity FROM names LEFT JOIN ids i ON i.name = names.name LEFT JOIN al ON alias = names.name""",
)
def wr_22(spark: SparkSession, d: str) -> DataFrame:
    """Names at write: of speakers, of nations (those of the first region are structural), of their aliases, and new ones."""
    nation = table(spark, d, "nation")
    land, realm = F.concat(F.lit("land "), F.col("n_nationkey").cast("string")), F.concat(F.lit("realm "), F.col("n_regionkey").cast("string"))
    i = F.col("c_custkey") % 5
    name = F.when(i == 0, "i").when(i == 1, F.lower("n_name")).when(i == 2, land).when(i == 3, realm).otherwise(F.lower("c_name"))
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(nation, "n_nationkey")
    ids = nation.select(F.lower("n_name").alias("name_norm"), F.col("n_nationkey").cast("string").alias("id"), "n_regionkey", F.explode(F.array(land, realm)).alias("alias"))
    aliases = ids.select("alias", F.col("id").alias("holder"))
    routed = upkeep.route(c.select("c_custkey", name.alias("name_norm"), (i == 0).alias("is_speaker")), ids.filter("n_regionkey = 0").select("name_norm", "id"), ids.select("name_norm", "id"), aliases, "me")
    return routed.select("c_custkey", "tier", "entity")


@query("WR-23", "SELECT o_orderkey AS proposal FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def wr_23(spark: SparkSession, d: str) -> DataFrame:
    """Open proposals whose pair is gone."""
    alive = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").join(alive, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("proposal"))


@query("WR-24", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'decided' WHEN l_linestatus = 'F' AND l_discount < 0.02 THEN 'veto' WHEN l_discount * 10 >= 0.85 THEN 'auto' ELSE 'propose' END AS verdict FROM lineitem")
def wr_24(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "R", "decided").when((F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.02), "veto").when(F.col("l_discount") * 10 >= 0.85, "auto").otherwise("propose")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("verdict"))


@query("WR-25", f"WITH {MENTIONS}, {{}} SELECT src, dst, n FROM pairs".replace("{}", "pairs AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS n FROM mentions a JOIN mentions b ON a.episode = b.episode AND a.entity < b.entity WHERE a.episode % 4 <> 0 GROUP BY 1, 2)"))
def wr_25(spark: SparkSession, d: str) -> DataFrame:
    """Signals of episodes that the ledger doesn't hold yet (here: every fourth is done)."""
    m = tables.mentions(spark, d).select("episode", "entity")
    ledger = m.filter("episode % 4 = 0").select("episode").distinct()
    m = m.join(ledger, "episode", "left_anti")
    return m.withColumnRenamed("entity", "src").join(m.withColumnRenamed("entity", "dst"), "episode").filter("src < dst").groupBy("src", "dst").agg(N().alias("n"))


@query("WR-26", "WITH t AS (SELECT l_partkey AS id, max(l_shipdate) AS last FROM lineitem GROUP BY 1), v AS (SELECT vec_id AS id, TIMESTAMP '2001-01-01' + to_days((vec_id % 200)::INT) AS made FROM embeddings) SELECT p_partkey AS id, CASE WHEN made IS NULL THEN 'missing' WHEN last > made THEN 'stale' ELSE 'fresh' END AS state FROM part LEFT JOIN v ON v.id = p_partkey LEFT JOIN t ON t.id = p_partkey")
def wr_26(spark: SparkSession, d: str) -> DataFrame:
    """Context vectors and their age; a shipment of a part touches it."""
    made = F.to_timestamp(F.lit("2001-01-01")) + F.make_dt_interval((F.col("id") % 200).cast("int"))
    v = tables.vectors(spark, d).select("id", made.alias("made"))
    touches = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("at"))
    return upkeep.vector_age(table(spark, d, "part").select(F.col("p_partkey").alias("id")), v, touches)


@query(
    "WR-27",
    """WITH v AS (SELECT conv_id, turn, text, unnest([1, 2]) AS version FROM conversations), t AS (SELECT * FROM v WHERE version = 2 OR turn < 3), k AS (SELECT *, count(*) OVER w AS k, row_number() OVER (PARTITION BY conv_id, version ORDER BY turn) AS r FROM t WINDOW w AS (PARTITION BY conv_id, version)),
            c AS (SELECT *, ceil(k / 4.0) AS chunks FROM k), s AS (SELECT *, floor(k / chunks) AS small, k % chunks AS wide FROM c),
            b AS (SELECT conv_id, version, turn, text, (CASE WHEN r <= wide * (small + 1) THEN floor((r - 1) / (small + 1)) + 1 ELSE wide + floor((r - 1 - wide * (small + 1)) / small) + 1 END)::BIGINT AS chunk FROM s),
            n AS (SELECT conv_id, version, chunk, string_agg(split_part(text, chr(10), 1), ' / ' ORDER BY turn) AS body, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM b GROUP BY 1, 2, 3)
       SELECT conv_id, version, chunk, body, first_turn, last_turn, turns, sha256(conv_id::VARCHAR || chr(0) || version::VARCHAR || chr(0) || chunk::VARCHAR || chr(0) || body) AS id, max(version) OVER (PARTITION BY conv_id) > version AS superseded FROM n""",
)
def wr_27(spark: SparkSession, d: str) -> DataFrame:
    """Narratives in two versions, of the first three turns and of all: chunks of even size, the first line of each turn, an
    id of the content; the later version supersedes."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).filter("version = 2 or turn < 3")
    return upkeep.narratives(t, 4).select("conv_id", "version", "chunk", "body", "first_turn", "last_turn", "turns", "id", "superseded")


@query("WR-28", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'dismissed' END AS state FROM events WHERE event_type IN ('purchase', 'error')")
def wr_28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error")).select("event_id", F.when(F.col("event_type") == "purchase", "applied").otherwise("dismissed").alias("state"))


@query("WR-29", "SELECT l_partkey AS src, l_suppkey AS dst, round(max(l_discount), 6) AS strength FROM lineitem GROUP BY 1, 2")
def wr_29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(r6(F.max("l_discount")).alias("strength"))


@query("WR-30", "SELECT sha256('merge' || chr(0) || event_id) AS id, 'lifecycle' AS kind FROM events WHERE event_type = 'signup'")
def wr_30(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'signup'").select(hashing.derived_id(F.lit("merge"), F.col("event_id")).alias("id"), F.lit("lifecycle").alias("kind"))


@query("WR-31", "SELECT conv_id, turn, epoch_us(try_cast(nullif(trim(CASE turn % 4 WHEN 0 THEN ' 2024-01-0' || (conv_id % 9 + 1) WHEN 1 THEN '2024-02-30' WHEN 2 THEN '  ' ELSE text END), '') AS TIMESTAMP)) AS trigger_after FROM conversations")
def wr_31(spark: SparkSession, d: str) -> DataFrame:
    """Triggers narrowed to dates: dates with blanks, days that don't exist, blanks and prose."""
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" 2024-01-0"), (F.col("conv_id") % 9 + 1).cast("string"))).when(F.col("turn") % 4 == 1, "2024-02-30").when(F.col("turn") % 4 == 2, "  ").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.unix_micros(upkeep.trigger_after(said)).alias("trigger_after"))


@query("WR-31_restated", "WITH a AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'unusable' WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'answered' END AS status, length(text) % 2 = 0 AS restated FROM conversations WHERE turn < 2), e AS (SELECT f.conv_id AS id, CASE WHEN f.status = 'unusable' AND s.conv_id IS NOT NULL THEN s.status ELSE f.status END AS status, CASE WHEN f.status = 'unusable' AND s.conv_id IS NOT NULL THEN s.restated ELSE f.restated END AS restated FROM a f LEFT JOIN a s ON s.conv_id = f.conv_id AND s.turn = 1 WHERE f.turn = 0) SELECT id, status, CASE WHEN status = 'answered' THEN restated END AS restated FROM e")
def wr_31_restated(spark: SparkSession, d: str) -> DataFrame:
    """Restatement checks with one retry; a conversation's first two turns stand for the two answers."""
    n = F.length("text")
    status = F.when(n % 3 == 0, "unusable").when(n % 7 == 0, "failed").otherwise("answered")
    return upkeep.validated(table(spark, d, "conversations").filter("turn < 2").select(F.col("conv_id").alias("id"), F.col("turn").alias("attempt"), status.alias("status"), (n % 2 == 0).alias("restated")))
