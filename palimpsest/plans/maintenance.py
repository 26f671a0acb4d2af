"""Queries on maintenance operations and the scheduler: OP-*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates, redaction, weights
from palimpsest.operators import bitemporal, entities, graph, names, queues, retrieval, scheduling, staging, upkeep
from palimpsest.plans.aggregate import KNN, N, knn, r6
from palimpsest.plans.read import SHAPE
from palimpsest.plans.registry import query
from palimpsest.plans.retrieval import _LONG, _OVERLAP, _SHAPE, ORPHANS, SIBLINGS, _recall, orphans, siblings
from palimpsest.plans.scalar import LEAKY, RESIDUE, leaky
from palimpsest.plans.stateful import JOBS, job_log
from palimpsest.plans.write import _G0, _REDIR, _entities
from palimpsest.sources import intake, tables
from palimpsest.sources.tables import BOTH, CLAIMS, GRAPH, MENTIONS, RESTATED, table


@query("OP-1", "SELECT doc_id, 32 AS dims FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) ORDER BY doc_id LIMIT 200")
def op_1(spark: SparkSession, d: str) -> DataFrame:
    """Backfill: texts without a vector (those of every third one are taken to be missing) get one, a batch of 200."""
    vecs = table(spark, d, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"))
    batch = table(spark, d, "documents").filter(F.trim("text") != "").select("doc_id", "text").join(vecs, "doc_id", "left_anti").orderBy("doc_id").limit(200)
    return batch.select("doc_id", F.size(intake.hashed_embedding(F.col("text"))).alias("dims"))


@query("OP-2", "SELECT o_orderkey AS id, 'reflect' AS job FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def op_2(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("id"), F.lit("reflect").alias("job"))


@query("OP-3", f"WITH {JOBS} SELECT job, attempts FROM jobs WHERE state = 'dead'")
def op_3(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters: jobs that failed as often as they may."""
    return queues.leases(job_log(spark, d), F.to_timestamp(F.lit("2024-01-30 12:00:00"))).filter("state = 'dead'").select("job", "attempts")


_ASSIGNED = r"""(?i)((?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[:=]\s*[\"'']?)([^\s\"''`.,;:<>(){}\[\]\\]{8,})"""


@query("OP-4", f"""WITH {LEAKY}, r AS (SELECT DISTINCT doc_id, text FROM ({RESIDUE})),
    h AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '\\bAKIA[A-Z0-9]{{16}}\\b') || regexp_extract_all(text, '{_ASSIGNED}', 2))) AS secret FROM r),
    f AS (SELECT doc_id, any_value(text) AS text, list(DISTINCT secret ORDER BY length(secret) DESC, secret) AS found FROM h GROUP BY 1)
    SELECT doc_id, list_reduce([text] || found, lambda t, x: replace(t, x, '⟨secret:' || CASE WHEN regexp_full_match(x, 'AKIA[A-Z0-9]{{16}}') THEN 'aws-access-key:' ELSE 'generic-secret-assignment:' END || substr(sha256(x), 1, 6) || '⟩')) AS text FROM f""")
def op_4(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which the residue scan finds something, each with the redacted version that supersedes its text."""
    return leaky(spark, d).filter(F.size(redaction.residue("text")) > 0).select("doc_id", redaction.redact("text").alias("text"))


@query("OP-5", f"WITH {GRAPH} SELECT src, dst, round(greatest(0.1, least(1.0, strength + 0.1 * least(1.0, n * 0.5) * (1 - strength))), 6) AS strength FROM edges")
def op_5(spark: SparkSession, d: str) -> DataFrame:
    """Reinforcement flush: each edge takes one step by the folded signals that it was made from."""
    eta = 0.1 * F.least(F.lit(1.0), F.col("n") * 0.5)
    return tables.edges(spark, d).select("src", "dst", r6(weights.reinforced(F.col("strength"), eta)).alias("strength"))


@query("OP-6", f"WITH {GRAPH} SELECT src, dst, round(greatest(0.1, strength * (1 - 0.05 * exp(-pow((src + dst) % 90 - 30, 2) / 450.0))), 6) AS strength FROM edges")
def op_6(spark: SparkSession, d: str) -> DataFrame:
    days = (F.col("src") + F.col("dst")) % 90
    return tables.edges(spark, d).select("src", "dst", r6(weights.decayed(F.col("strength"), days)).alias("strength"))


@query("OP-7", f"WITH {GRAPH} SELECT src, dst FROM edges WHERE strength <= 0.4 AND (src + dst) % 90 >= 14 AND type IN ('CO_OCCURS', 'SIMILAR')")
def op_7(spark: SparkSession, d: str) -> DataFrame:
    return tables.edges(spark, d).filter("strength <= 0.4 and (src + dst) % 90 >= 14 and type in ('CO_OCCURS', 'SIMILAR')").select("src", "dst")


@query(
    "OP-8",
    f"""WITH {CLAIMS}, n AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN substr(sha256(c_custkey::VARCHAR), 1, 40) WHEN 1 THEN 'code-Na' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 2 THEN '/var/' || lower(c_mktsegment) WHEN 3 THEN substr(md5(c_custkey::VARCHAR), 1, 12) ELSE c_name END AS name FROM customer),
        s AS (SELECT id, {SHAPE} AS shape FROM n),
        m AS (SELECT o_custkey AS id, count(*) AS k, max(o_orderdate) AS last FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), p AS (SELECT subject AS id FROM claims WHERE superseded_by IS NOT NULL AND id % 20 = 0 UNION SELECT min(c_custkey) FROM customer GROUP BY c_nationkey, c_mktsegment)
        SELECT s.id, shape, k FROM s JOIN m ON m.id = s.id WHERE shape IS NOT NULL AND k <= 5 AND last <= TIMESTAMP '2001-06-01' - INTERVAL 7 DAY AND NOT EXISTS (SELECT 1 FROM p WHERE p.id = s.id)""",
)
def op_8(spark: SparkSession, d: str) -> DataFrame:
    """Identifier decay over customers under planted names; superseded claims are typed edges, a segment's first one is canonical."""
    c = table(spark, d, "customer")
    i = F.col("c_custkey")
    key = i.cast("string").cast("binary")
    name = F.element_at(F.array(F.substring(F.sha2(key, 256), 1, 40), F.concat(F.lit("code-Na"), F.lpad(i.cast("string"), 9, "0")), F.concat(F.lit("/var/"), F.lower("c_mktsegment")), F.substring(F.md5(key), 1, 12), F.col("c_name")), (i % 5 + 1).cast("int"))
    mentions = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"))
    typed = tables.claims(spark, d).filter("superseded_by is not null and id % 20 = 0").select(F.col("subject").alias("id"))
    protected = typed.union(c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("id")).select("id"))
    return upkeep.identifier_decay(c.select(i.alias("id"), name.alias("name")), mentions, protected, F.to_timestamp(F.lit("2001-06-01")))


@query("OP-9", "SELECT o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) WHERE back > 1")
def op_9(spark: SparkSession, d: str) -> DataFrame:
    """Narrative cleanup: all but the newest version of each."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("back", F.row_number().over(w)).filter("back > 1").select(F.col("o_orderkey").alias("id"))


@query("OP-10", f"WITH {CLAIMS} SELECT DISTINCT c.subject AS narrative FROM claims c JOIN customer ON c_custkey = subject WHERE valid_until IS NOT NULL AND valid_until >= TIMESTAMP '2001-01-01'")
def op_10(spark: SparkSession, d: str) -> DataFrame:
    """Narratives that cite a claim closed since."""
    closed = tables.claims(spark, d).filter("valid_until >= timestamp'2001-01-01'").select(F.col("subject").alias("narrative")).distinct()
    return closed.join(table(spark, d, "customer").select(F.col("c_custkey").alias("narrative")), "narrative", "left_semi")


@query("OP-11", f"WITH {CLAIMS} SELECT id FROM claims WHERE valid_until IS NULL AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id) ORDER BY valid_from, id LIMIT 20")
def op_11(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return tables.claims(spark, d).filter("valid_until is null").join(used, "id", "left_semi").orderBy("valid_from", "id").limit(20).select("id")


@query("OP-12", "WITH m AS (SELECT l_partkey AS id, l_orderkey, min(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2) SELECT id, count(*) AS k, count(*) FILTER (seen < TIMESTAMP '2000-01-01') AS baseline FROM m GROUP BY 1 HAVING count(*) FILTER (seen >= TIMESTAMP '2000-01-01') >= 5")
def op_12(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions behind the growth of mentions since they were made, here at the start of 2000."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), "l_orderkey").agg(F.min("l_shipdate").alias("at"))
    baselines = m.filter("at < timestamp'2000-01-01'").groupBy("id").agg(N().alias("baseline"))
    return upkeep.outgrown(m, baselines)


@query("OP-13", f"WITH {CLAIMS} SELECT id FROM claims WHERE valid_until IS NULL AND valid_horizon < TIMESTAMP '1999-01-01'")
def op_13(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).filter("valid_until is null and valid_horizon < timestamp'1999-01-01'").select("id")


@query("OP-14", f"WITH {MENTIONS}, m AS (SELECT entity, count(*) AS k FROM mentions GROUP BY 1) SELECT entity, 'What is ' || p_name || '?' AS question FROM m JOIN part ON p_partkey = entity WHERE k >= 5 AND p_size < 5")
def op_14(spark: SparkSession, d: str) -> DataFrame:
    m = tables.mentions(spark, d).groupBy(F.col("entity").alias("p_partkey")).agg(N().alias("k")).filter("k >= 5")
    return table(spark, d, "part").filter("p_size < 5").join(m, "p_partkey").select(F.col("p_partkey").alias("entity"), F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("question"))


@query("OP-15", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def op_15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(dates.day_key(F.col("ts")).alias("day")).agg(N().alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("OP-16", "SELECT strftime(ts, '%G-W%V') AS week, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days, count(*) AS n FROM events GROUP BY 1")
def op_16(spark: SparkSession, d: str) -> DataFrame:
    """Weeks rolled up from days, so that the second step reads the first one's rows."""
    day = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(N().alias("n"))
    return day.groupBy(dates.week_key(F.col("day").cast("timestamp")).alias("week")).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"))


@query("OP-17", f"WITH {MENTIONS}, c AS (SELECT p_brand AS community, count(DISTINCT entity) AS size, count(DISTINCT o_custkey) AS sessions FROM mentions JOIN part ON p_partkey = entity JOIN orders ON o_orderkey = episode GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY size) AS i, count(*) OVER () AS total FROM c) SELECT community, size, sessions FROM r WHERE sessions >= 2 AND size >= (SELECT greatest(2, max(size)) FROM r WHERE i = ceil(0.75 * total))")
def op_17(spark: SparkSession, d: str) -> DataFrame:
    """Communities at or above the 75th percentile of sizes with two sessions at least."""
    lines = tables.mentions(spark, d).select(F.col("episode").alias("o_orderkey"), F.col("entity").alias("p_partkey")).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    c = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("community")), "p_partkey").groupBy("community").agg(F.count_distinct("p_partkey").alias("size"), F.count_distinct("o_custkey").alias("sessions"))
    c = staging.stage(c, "communities")
    w = Window.orderBy("size")  # of the different sizes
    run = c.groupBy("size").agg(N().alias("k")).withColumns({"upto": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ranked = run.filter(F.col("upto") >= F.ceil(F.lit(0.75) * F.col("total"))).agg(F.greatest(F.min("size"), F.lit(2)).alias("floor"))
    return c.join(F.broadcast(ranked), (F.col("size") >= F.col("floor")) & (F.col("sessions") >= 2)).select("community", "size", "sessions")


@query("OP-18", f"WITH {GRAPH} SELECT DISTINCT src, dst FROM pairs WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = pairs.src AND e.dst = pairs.dst AND e.type = 'SIMILAR')")
def op_18(spark: SparkSession, d: str) -> DataFrame:
    have = tables.edges(spark, d).filter("type = 'SIMILAR'").select("src", "dst")
    return tables.pairs(spark, d).filter("n >= 2").select("src", "dst").join(have, ["src", "dst"], "left_anti")


@query("OP-19", f"WITH {ORPHANS}, {SIBLINGS} SELECT o.id, CASE WHEN s.sibling IS NOT NULL THEN 'relink' WHEN p_size > 40 THEN 'forget' ELSE 'keep' END AS action, s.sibling FROM orphans o LEFT JOIN siblings s USING (id) JOIN part ON p_partkey = o.id")
def op_19(spark: SparkSession, d: str) -> DataFrame:
    """Orphan cleanup: orphans are relinked to a sibling of their container; of the rest large ones are forgotten."""
    o = staging.stage(orphans(spark, d), "orphans")
    found = o.join(siblings(spark, d, o), "id", "left").join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    action = F.when(F.col("sibling").isNotNull(), "relink").when(F.col("p_size") > 40, "forget").otherwise("keep")
    return found.select("id", action.alias("action"), "sibling")


@query("OP-20")
def op_20(spark: SparkSession, d: str) -> DataFrame:
    """Community refresh: ten rounds of label propagation, sizes of the communities."""
    return graph.label_propagation(tables.both_ways(staging.stage(tables.pairs(spark, d).select("src", "dst"), "pairs"))).groupBy("community").agg(N().alias("size"))


@query("OP-21", f"WITH {GRAPH}, lab AS (SELECT p_partkey AS node, p_brand AS community FROM part), cr AS (SELECT least(x.community, y.community) AS ca, greatest(x.community, y.community) AS cb, count(*) AS n FROM edges e JOIN lab x ON x.node = e.src JOIN lab y ON y.node = e.dst WHERE x.community <> y.community GROUP BY 1, 2) SELECT ca, cb FROM cr ORDER BY n, ca, cb LIMIT 10")
def op_21(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return graph.crossing(tables.edges(spark, d), labels).orderBy("n", "ca", "cb").limit(10).select("ca", "cb")


@query(
    "OP-22",
    f"""WITH {KNN}, {GRAPH}, {BOTH}, k AS (SELECT ask AS a, id AS b FROM knn WHERE rank <= 5 AND score >= 0.1),
        s AS (SELECT a, b, 'name_overlap' AS sign FROM k JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b WHERE translate(lower(p.p_name), '-_./ ', '') = translate(lower(q.p_name), '-_./ ', '')
              UNION SELECT a, b, 'shared_episode' FROM k JOIN mentions x ON x.entity = a JOIN mentions y ON y.entity = b AND y.episode = x.episode
              UNION SELECT a, b, 'shared_neighbor' FROM k JOIN both_ways x ON x.node = a AND x.n >= 2 JOIN both_ways y ON y.node = b AND y.other = x.other AND y.n >= 2)
        SELECT a AS src, b AS dst, string_agg(sign, ',' ORDER BY sign) AS seconds FROM s GROUP BY 1, 2""",
)
def op_22(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by vector that share an episode, a neighbour (over edges of two episodes or more) or a name."""
    near = knn(spark, d, 5, 0.1).select(F.col("ask").alias("a"), F.col("id").alias("b"))
    both = tables.both_ways(tables.edges(spark, d).filter("n >= 2")).select("node", "other")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return upkeep.second_signals(staging.stage(near, "near"), tables.mentions(spark, d), both, names).select(F.col("a").alias("src"), F.col("b").alias("dst"), "seconds")


@query("OP-23", f"WITH {_G0}, {_REDIR}, m AS (SELECT canonical, count(*) FILTER (id <> canonical) AS merged FROM canon GROUP BY 1), e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, type FROM moved GROUP BY ALL), k AS (SELECT x AS canonical, count(*) AS edges FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) GROUP BY 1) SELECT m.canonical, merged, coalesce(edges, 0) AS edges FROM m LEFT JOIN k USING (canonical) WHERE merged > 0")
def op_23(spark: SparkSession, d: str) -> DataFrame:
    """Automatic merges of equal squashed names into the most mentioned one, with the edges that it has after the cascade."""
    canon = staging.stage(entities.canonical(_entities(spark, d), "squash"), "canonical")
    moved = entities.redirect(tables.edges(spark, d), canon)
    k = moved.select(F.explode(F.array("src", "dst")).alias("canonical")).groupBy("canonical").agg(N().alias("edges"))
    m = canon.groupBy("canonical").agg(F.count_if(F.col("id") != F.col("canonical")).alias("merged")).filter("merged > 0")
    return m.join(k, "canonical", "left").na.fill(0, ["edges"])


@query("OP-24", f"WITH {RESTATED}, p AS (SELECT ask, id, (ask % 3)::BIGINT AS ask_at, 1::BIGINT AS id_at FROM restated WHERE rank = 1 AND score >= 0.73) SELECT CASE WHEN (ask_at, ask) < (id_at, id) THEN id ELSE ask END AS dropped, CASE WHEN (ask_at, ask) < (id_at, id) THEN ask ELSE id END AS kept FROM p")
def op_24(spark: SparkSession, d: str) -> DataFrame:
    """Claim dedup: of a claim and its nearest neighbour at a cosine of 0.73 or more the later one goes, the older survives.
    Every third restatement is taken to have been said before."""
    v = tables.vectors(spark, d)
    near = retrieval.knn(tables.restated(v), v, 1, 0.73).select("ask", "id", (F.col("ask") % 3).alias("ask_at"), F.lit(1).cast("long").alias("id_at"))
    a, b = F.struct(F.col("ask_at").alias("at"), F.col("ask").alias("id")), F.struct(F.col("id_at").alias("at"), F.col("id").alias("id"))
    return near.select(F.greatest(a, b)["id"].alias("dropped"), F.least(a, b)["id"].alias("kept"))


@query("OP-25", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def op_25(spark: SparkSession, d: str) -> DataFrame:
    decided = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct().join(decided, "id", "left_anti")


@query("OP-26")
def op_26(spark: SparkSession, d: str) -> DataFrame:
    """Recall probe: asks answered by the whole recall; a hit has the item that was asked about in its pack, a served
    reference one that shares an episode of mentions with it."""
    asks = table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("ask"))
    got = staging.stage(_recall(spark, d).select("ask", "id"), "probe")
    m = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    known = m.filter("l_partkey % 100 = 0").select("l_orderkey", F.col("l_partkey").alias("ask")).join(m.select("l_orderkey", F.col("l_partkey").alias("id")), "l_orderkey").filter("ask <> id").select("ask", "id").distinct()
    per = got.join(known.withColumn("served", F.lit(1)), ["ask", "id"], "left").groupBy("ask").agg(F.max((F.col("ask") == F.col("id")).cast("int")).alias("hit"), F.coalesce(F.max("served"), F.lit(0)).alias("served"))
    per = asks.join(per, "ask", "left").fillna(0, ["hit", "served"])
    return per.agg(N().alias("probes"), F.sum("hit").alias("hits"), F.sum("served").alias("served"), r6(F.avg("hit")).alias("hit_rate"), r6(F.avg("served")).alias("served_rate"))


@query("OP-27", f"WITH {CLAIMS} SELECT id, CASE WHEN forgotten_at IS NOT NULL THEN 'stale' WHEN valid_until IS NOT NULL THEN 'closed' ELSE 'open' END AS resolution FROM claims")
def op_27(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("forgotten_at").isNotNull(), "stale").when(F.col("valid_until").isNotNull(), "closed").otherwise("open")
    return tables.claims(spark, d).select("id", state.alias("resolution"))


@query("OP-28", "SELECT user_id, CASE WHEN d < 7 THEN 'fresh' WHEN d < 30 THEN 'aging' ELSE 'stale' END AS age FROM (SELECT user_id, floor((epoch_us(TIMESTAMP '2024-02-10') - epoch_us(max(ts))) / 86400000000.0) AS d FROM events GROUP BY 1)")
def op_28(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return e.select("user_id", dates.age_class(dates.whole_days(F.col("ts"), F.to_timestamp(F.lit("2024-02-10")))).alias("age"))


_HEALTH = f"""WITH {CLAIMS} SELECT (SELECT count(*) FROM claims WHERE valid_until IS NULL AND forgotten_at IS NULL) AS population,
    (SELECT round(count(e.vec_id) / count(*)::DOUBLE, 6) FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id) AS parity,
    (SELECT round(count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem)) / count(*)::DOUBLE, 6) FROM part) AS orphans,
    (SELECT round(avg((event_type = 'error')::INT), 6) FROM events) AS degraded, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM part) AS nodes,
    (SELECT count(*) FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unlinked"""


def health(spark: SparkSession, d: str) -> DataFrame:
    """One row of health metrics."""
    pop = tables.claims(spark, d).filter(bitemporal.current()).agg(N().alias("population"))
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v"))
    parity = table(spark, d, "documents").select("doc_id").join(vecs, "doc_id", "left").agg(r6(F.count("v") / F.count(F.lit(1))).alias("parity"), N().alias("expected"))
    used = table(spark, d, "lineitem").select("l_partkey").distinct().select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("u"))
    orphans = table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left").agg(r6(F.count_if(F.col("u").isNull()) / F.count(F.lit(1))).alias("orphans"), N().alias("nodes"))
    degraded = table(spark, d, "events").agg(r6(F.avg((F.col("event_type") == "error").cast("int"))).alias("degraded"))
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    unlinked = table(spark, d, "orders").join(sessions, "o_custkey", "left_anti").agg(N().alias("unlinked"))
    return scheduling.side_by_side(pop, parity, orphans, degraded, unlinked)


@query("OP-S_health", _HEALTH)
def op_s_health(spark: SparkSession, d: str) -> DataFrame:
    return health(spark, d)


@query(
    "OP-S",
    f"""WITH h AS ({_HEALTH}), st AS (SELECT event_type, count(*) AS runs, count(*) FILTER (value >= 10) / count(*)::DOUBLE AS eff, avg(value) * 100 AS ms, date_diff('day', max(ts)::DATE, DATE '2024-02-05') AS waiting FROM events GROUP BY 1),
        c AS (SELECT 'vector_backfill' AS operation, 'view' AS kind, 1 - parity AS relevance, expected >= 20 AND parity < 0.8 AS hit FROM h UNION ALL SELECT 'orphan_cleanup', 'click', orphans, nodes >= 20 AND orphans > 0.3 FROM h UNION ALL SELECT 'backbone_repair', 'purchase', least(1, unlinked / 100.0), unlinked > 0 FROM h UNION ALL SELECT 'dead_letter', 'error', degraded, false FROM h),
        u AS (SELECT c.*, runs, eff, coalesce(waiting, 0) AS waiting, relevance * CASE WHEN eff < 0.5 THEN 0.5 ELSE 1 END * (1 + greatest(0, coalesce(waiting, 0)) / 8.0::DOUBLE) / CASE WHEN ms > 1000 THEN 1 + least(3, log10(ms / 1000)) / 3 ELSE 1 END AS urgency FROM c LEFT JOIN st ON event_type = kind),
        t AS (SELECT operation, waiting, relevance, urgency, CASE WHEN relevance > 0 AND hit AND (coalesce(runs, 0) < 3 OR eff IS NULL OR eff >= 0.5) THEN 1 WHEN relevance > 0 AND urgency >= 0.2 THEN 2 END AS tier FROM u),
        b AS (SELECT operation, tier, CASE tier WHEN 1 THEN relevance ELSE urgency END AS urgency FROM t WHERE tier IS NOT NULL ORDER BY tier, 3 DESC, waiting DESC, operation LIMIT 1)
        SELECT operation, coalesce(tier, 3) AS tier, round(urgency, 6) AS urgency FROM (SELECT 1) LEFT JOIN b ON true""",
)
def op_s(spark: SparkSession, d: str) -> DataFrame:
    """The scheduler's decision over four operations; the events stand for their runs."""
    h = staging.stage(health(spark, d), "health")
    rules = [("vector_backfill", "vector_parity", "view", 1 - F.col("parity")), ("orphan_cleanup", "orphan_share", "click", F.col("orphans")), ("backbone_repair", "missing_backbone_links", "purchase", F.least(F.lit(1.0), F.col("unlinked") / 100.0)), ("dead_letter", "", "error", F.col("degraded"))]
    work = F.array(*[F.struct(F.lit(o).alias("operation"), F.lit(a).alias("answers"), F.lit(k).alias("event_type"), r.cast("double").alias("relevance")) for o, a, k, r in rules])
    runs = table(spark, d, "events").groupBy("event_type").agg(N().alias("runs"), (F.count_if(F.col("value") >= 10) / N()).alias("effectiveness"), (F.avg("value") * 100).alias("mean_ms"), F.date_diff(F.lit("2024-02-05").cast("date"), F.to_date(F.max("ts"))).alias("waiting"))
    c = h.select(F.inline(work)).join(runs, "event_type", "left")
    return scheduling.decide(scheduling.scored(c), scheduling.critical_conditions(h)).withColumn("urgency", r6("urgency"))


@query("OP-S2", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'reject' WHEN value IS NULL OR value < 10 THEN 'reject' WHEN user_id % 2 = 0 THEN 'downgrade' ELSE 'accept' END AS verdict FROM events")
def op_s2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("degraded"), (F.coalesce("value", F.lit(0.0)) >= 10).alias("has_work"), (F.col("user_id") % 2 == 1).alias("allowed"))
    return scheduling.guard(e).select("event_id", "verdict")


@query("OP-S3", f"WITH {GRAPH} SELECT type, ceil(0.05 * count(*))::BIGINT AS quota FROM edges GROUP BY 1")
def op_s3(spark: SparkSession, d: str) -> DataFrame:
    return tables.edges(spark, d).groupBy("type").agg(F.ceil(F.lit(0.05) * N()).cast("long").alias("quota"))


@query("OP-S4", "SELECT user_id, count(*) AS runs, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0)::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def op_s4(spark: SparkSession, d: str) -> DataFrame:
    good, tried = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "error"))
    return table(spark, d, "events").groupBy("user_id").agg(N().alias("runs"), r6(F.when(tried > 0, good / tried)).alias("rate"))


@query(
    "OP-S5",
    f"""WITH n AS (SELECT DISTINCT lower(CASE p_partkey % 7 WHEN 0 THEN p_name || 's' WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name || ' ' || p_partkey % 3 ELSE p_name END) AS f FROM part),
        s AS ({_SHAPE} n), p AS (SELECT x.f AS a, y.f AS b, CASE WHEN x.s = y.s THEN 'squash' WHEN {_LONG} AND {_OVERLAP} >= 0.85 THEN 'bigram' END AS relation FROM s x JOIN s y ON x.f < y.f)
        SELECT a, b, relation, CASE WHEN relation = 'squash' THEN 'auto_merge' ELSE 'propose' END AS state, (count(*) FILTER (relation = 'squash') OVER ())::BIGINT AS auto_merges FROM p WHERE relation IS NOT NULL""",
)
def op_s5(spark: SparkSession, d: str) -> DataFrame:
    """The merge shadow: pairs of names that the cascade would merge, those of one squashed form by itself, and how many."""
    k, n = F.col("p_partkey") % 7, F.col("p_name")
    said = F.when(k == 0, F.concat(n, F.lit("s"))).when(k == 1, F.replace(n, F.lit(" "), F.lit("-"))).when(k == 2, F.concat(n, F.lit(" "), (F.col("p_partkey") % 3).cast("string"))).otherwise(n)
    pairs = staging.stage(names.merge_pairs(table(spark, d, "part").select(said.alias("name"))), "merge-shadow")
    auto = pairs.filter("relation = 'squash'").count()
    return pairs.select("a", "b", "relation", F.when(F.col("relation") == "squash", "auto_merge").otherwise("propose").alias("state"), F.lit(auto).cast("long").alias("auto_merges"))

