"""Queries on aggregations, windows, orders and sets: AGG-*, WIN-*, SORT-*, SET-*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates, hashing, weights
from palimpsest.operators import queues, retrieval
from palimpsest.operators.quantiles import quantiles
from palimpsest.plans.registry import query
from palimpsest.sources import tables
from palimpsest.sources.tables import BOTH, CLAIMS, GRAPH, MENTIONS, table


def r6(c) -> F.Column:
    return F.round(c, 6)


def N() -> F.Column:  # noqa: N802
    return F.count(F.lit(1))


@query("AGG-1", "SELECT unnest(string_split(p_type, ' ')) AS label, count(*) AS n FROM part GROUP BY 1")
def agg_1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("label")).groupBy("label").agg(N().alias("n"))


@query("AGG-2", "SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1")
def agg_2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))


@query("AGG-3", f"WITH {GRAPH} SELECT type, round(min(strength), 6) AS least, round(quantile_cont(strength, 0.1), 6) AS p10, round(quantile_cont(strength, 0.5), 6) AS p50, round(quantile_cont(strength, 0.9), 6) AS p90, round(max(strength), 6) AS most FROM edges GROUP BY 1")
def agg_3(spark: SparkSession, d: str) -> DataFrame:
    names = ["least", "p10", "p50", "p90", "most"]
    q = quantiles(tables.edges(spark, d), "type", "strength", [0.0, 0.1, 0.5, 0.9, 1.0])
    return q.select("type", *[r6(f"q{i}").alias(n) for i, n in enumerate(names)])


@query("AGG-4", f"WITH {GRAPH} SELECT count(*) FILTER (strength >= 0.5) AS at_floor, count(*) FILTER (strength < 0.5) AS below FROM edges")
def agg_4(spark: SparkSession, d: str) -> DataFrame:
    return tables.edges(spark, d).agg(F.count_if(F.col("strength") >= 0.5).alias("at_floor"), F.count_if(F.col("strength") < 0.5).alias("below"))


@query("AGG-5", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def agg_5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(N().alias("n")).filter("n > 1")


@query("AGG-6", "SELECT round(count(e.vec_id) / count(*)::DOUBLE, 6) AS parity FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def agg_6(spark: SparkSession, d: str) -> DataFrame:
    has = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    whole = table(spark, d, "documents").select("doc_id").join(has, "doc_id", "left")
    return whole.agg(r6(F.when(N() == 0, F.lit(1.0)).otherwise(F.count("has") / N())).alias("parity"))


@query("AGG-7", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 500 GROUP BY 1")
def agg_7(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of each kind's last 500 samples, interpolated."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("back", F.row_number().over(w)).filter("back <= 500").groupBy("event_type").agg(r6(F.percentile("value", 0.95)).alias("p95"))


@query("AGG-8", f"WITH {MENTIONS}, s AS (SELECT entity, count(*) AS n FROM mentions GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS total FROM s) SELECT greatest(max(n) FILTER (i = ceil(0.75 * total)), 2) AS density_floor FROM r")
def agg_8(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank 75th percentile of sizes, by counts of each size instead of a sort of all."""
    sizes = tables.mentions(spark, d).groupBy("entity").agg(N().alias("n")).groupBy("n").agg(N().alias("k"))
    w = Window.orderBy("n")
    run = sizes.withColumns({"upto": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return run.filter(F.col("upto") >= F.ceil(F.lit(0.75) * F.col("total"))).agg(F.greatest(F.min("n"), F.lit(2)).alias("density_floor"))


@query("AGG-9", "SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(N().alias("runs"), r6(F.avg("value")).alias("mean"))


@query("AGG-10", "WITH l AS (SELECT DISTINCT l_partkey AS id, l_returnflag AS method FROM lineitem), k AS (SELECT id, count(*) AS kinds FROM l GROUP BY 1) SELECT method, count(*) FILTER (kinds = 1) AS sole, count(*) FILTER (kinds > 1) AS shared FROM l JOIN k USING (id) GROUP BY 1")
def agg_10(spark: SparkSession, d: str) -> DataFrame:
    methods = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_returnflag").alias("m"))
    return methods.select(F.explode("m").alias("method"), F.size("m").alias("kinds")).groupBy("method").agg(F.count_if(F.col("kinds") == 1).alias("sole"), F.count_if(F.col("kinds") > 1).alias("shared"))


@query("AGG-11", "SELECT event_type AS lane, count(*) AS depth, epoch_us(min(ts)) AS oldest, count(*) FILTER (event_id % 7 >= 5) AS exhausted FROM events GROUP BY 1")
def agg_11(spark: SparkSession, d: str) -> DataFrame:
    return queues.depth(table(spark, d, "events").select(F.col("event_type").alias("lane"), F.col("ts").alias("enqueued_at"), (F.col("event_id") % 7).alias("attempts")), 5)


@query(
    "AGG-12",
    f"""WITH {MENTIONS}, size AS (SELECT episode, count(*) AS k FROM mentions GROUP BY 1),
        p AS (SELECT a.entity AS src, b.entity AS dst, 1.0 / (k - 1) AS signal FROM mentions a JOIN mentions b ON a.episode = b.episode AND a.entity < b.entity JOIN size s ON s.episode = a.episode)
        SELECT src, dst, round(0.1 * least(1.0, sum(signal)), 6) AS eta FROM p GROUP BY 1, 2""",
)
def agg_12(spark: SparkSession, d: str) -> DataFrame:
    m = tables.mentions(spark, d).select("episode", "entity")
    return queues.reinforcement_fold(m, 0.1).select("src", "dst", r6("eta").alias("eta"))


@query("AGG-13", "WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 5 > 0), s AS (SELECT label, i, sum(x * (vec_id % 5)) / sum(vec_id % 5) AS m FROM v GROUP BY 1, 2) SELECT label, round(sum(m), 4) AS total, round(max(m), 5) AS most FROM s GROUP BY 1")
def agg_13(spark: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(spark, d).withColumn("weight", F.col("id") % 5)
    m = retrieval.mean_vector(v, "label", 64)
    return m.select("label", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max("vec"), 5).alias("most"))


@query("AGG-17", "SELECT event_id, round(avg((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 499 PRECEDING), 6) AS rate FROM events")
def agg_17(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-499, 0)
    return table(spark, d, "events").select("event_id", r6(F.avg((F.col("event_type") == "error").cast("int")).over(w)).alias("rate"))


@query("AGG-18", "WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, n * 100 + CASE event_type WHEN 'view' THEN 9 WHEN 'click' THEN 8 WHEN 'purchase' THEN 7 WHEN 'signup' THEN 6 ELSE 5 END) AS type FROM v GROUP BY 1")
def agg_18(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent type of each user; the incumbent 'view' wins ties, then the order of the list."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(N().alias("n"))
    place = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase", "signup", "error"))), F.col("event_type"))
    return v.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -place)).alias("type"))


@query("AGG-19", "SELECT l_partkey AS src, l_suppkey AS dst, round(max(l_discount), 6) AS strength, list_sort(list(DISTINCT l_returnflag)) AS signals, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(r6(F.max("l_discount")).alias("strength"), F.sort_array(F.collect_set("l_returnflag")).alias("signals"), N().alias("n"))


@query("AGG-20", "SELECT user_id, epoch_us(min(ts)) AS first_served FROM events GROUP BY 1")
def agg_20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.unix_micros(F.min("ts")).alias("first_served"))


@query("AGG-21", f"WITH {MENTIONS} SELECT count(DISTINCT entity) AS population, greatest(1, least(32, round(10 + 2 * ln(count(DISTINCT entity)))))::INT AS budget FROM mentions")
def agg_21(spark: SparkSession, d: str) -> DataFrame:
    return tables.mentions(spark, d).agg(F.count_distinct("entity").alias("population")).withColumn("budget", weights.seed_budget(F.col("population")))


@query("WIN-1", "SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def win_1(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("WIN-2", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1")
def win_2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))


@query("WIN-3", "SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)::INT AS lane_seq FROM events")
def win_3(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("lane"), F.col("user_id").alias("session_id"), F.col("ts").alias("enqueued_at"))
    return queues.sequenced(q).select(F.col("id").alias("event_id"), "lane_seq")


@query("WIN-4", "SELECT o_orderkey, round(1.0 / (1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)), 6) AS recency FROM orders")
def win_4(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", r6(1 / (1 + F.row_number().over(w))).alias("recency"))


@query("WIN-5", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events) SELECT event_id, turn::INT AS turn, row_number() OVER (PARTITION BY turn ORDER BY event_type)::INT AS place FROM r WHERE turn <= 20")
def win_5(spark: SparkSession, d: str) -> DataFrame:
    """Round robin: each cue deals one item a round."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    r = table(spark, d, "events").withColumn("turn", F.row_number().over(w)).filter("turn <= 20")
    return r.select("event_id", "turn", F.row_number().over(Window.partitionBy("turn").orderBy("event_type")).alias("place"))


@query("WIN-6", "SELECT strftime(o_orderdate, '%G-W%V') AS week, strftime(min(date_trunc('day', o_orderdate)), '%Y-%m-%d') AS first_day, count(*) AS n, max(date_trunc('week', o_orderdate)) + INTERVAL 7 DAY <= TIMESTAMP '2001-01-01' AS closed FROM orders GROUP BY 1")
def win_6(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    end = F.max(F.date_trunc("week", o)) + F.expr("INTERVAL 7 DAYS")
    return table(spark, d, "orders").groupBy(dates.week_key(o).alias("week")).agg(dates.day_key(F.min(o)).alias("first_day"), N().alias("n"), (end <= F.to_timestamp(F.lit("2001-01-01"))).alias("closed"))


@query("WIN-7", "SELECT user_id, (epoch_us(max(ts)) - epoch_us(max(prev))) AS gap FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1")
def win_7(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("prev", F.lag("ts").over(w))
    return e.groupBy("user_id").agg((F.unix_micros(F.max("ts")) - F.unix_micros(F.max("prev"))).alias("gap"))


@query("WIN-8", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def win_8(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("next"))


@query("WIN-9", "SELECT o_orderkey, version::INT AS version, version = max(version) OVER (PARTITION BY o_custkey) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)")
def win_9(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    v = table(spark, d, "orders").withColumn("version", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")))
    return v.select("o_orderkey", "version", (F.col("version") == F.max("version").over(w)).alias("latest"))


@query("WIN-10", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations), c AS (SELECT *, ceil(k / 3.0)::BIGINT AS chunks FROM n) SELECT conv_id, turn, CASE WHEN r <= (k % chunks) * (k // chunks + 1) THEN (r - 1) // (k // chunks + 1) + 1 ELSE (k % chunks) + (r - 1 - (k % chunks) * (k // chunks + 1)) // (k // chunks) + 1 END AS chunk FROM c")
def win_10(spark: SparkSession, d: str) -> DataFrame:
    return queues.balanced_chunks(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


@query("WIN-11", "SELECT epoch_us(ts) // 900000000 * 900 AS quarter, count(*) AS n FROM events GROUP BY 1")
def win_11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.unix_seconds(dates.quarter_hour(F.col("ts"))).alias("quarter")).agg(N().alias("n"))


@query("WIN-12", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events), l AS (SELECT user_id, max(cycle) AS now FROM r GROUP BY 1) SELECT r.user_id, r.event_type, any_value(l.now) - max(r.cycle) AS waited FROM r JOIN l ON r.user_id = l.user_id GROUP BY 1, 2")
def win_12(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    r = table(spark, d, "events").withColumn("cycle", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("now", F.count(F.lit(1)).over(w))
    return r.groupBy("user_id", "event_type").agg((F.max("now") - F.max("cycle")).alias("waited"))


@query("SORT-1", f"WITH {CLAIMS} SELECT id FROM claims ORDER BY valid_until DESC NULLS LAST, tx_from DESC, id LIMIT 100")
def sort_1(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).orderBy(F.desc_nulls_last("valid_until"), F.desc("tx_from"), "id").limit(100).select("id")


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
KNN = f"knn AS (SELECT * FROM (SELECT a.vec_id AS ask, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10)"


def knn(spark: SparkSession, d: str, k: int = 10, floor: float = -1.0) -> DataFrame:
    """Neighbours of every hundredth vector among all."""
    v = tables.vectors(spark, d).select("id", "vec")
    return retrieval.knn(v.filter("id % 100 = 0"), v, k, floor)


@query("SORT-2", f"WITH {KNN} SELECT ask, id, rank::INT AS rank, round((1 + score) / 2, 5) AS index_score FROM knn")
def sort_2(spark: SparkSession, d: str) -> DataFrame:
    return knn(spark, d).select("ask", "id", "rank", F.round((1 + F.col("score")) / 2, 5).alias("index_score"))


@query("SORT-3", f"WITH {CLAIMS} SELECT id, row_number() OVER (PARTITION BY subject ORDER BY round(value) DESC, valid_until IS NULL DESC, id)::INT AS place FROM claims")
def sort_3(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("subject").orderBy(F.desc(F.round("value")), F.desc(F.col("valid_until").isNull()), "id")
    return tables.claims(spark, d).select("id", F.row_number().over(w).alias("place"))


@query("SORT-4", "SELECT l_partkey AS id, count(*) AS provenance, round(max(l_discount), 6) AS score FROM lineitem GROUP BY 1 ORDER BY max(l_discount) DESC, count(*) DESC, 1 LIMIT 50")
def sort_4(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(N().alias("provenance"), F.max("l_discount").alias("score"))
    return s.orderBy(F.desc("score"), F.desc("provenance"), "id").limit(50).select("id", "provenance", r6("score").alias("score"))


@query("SORT-5")
def sort_5(spark: SparkSession, d: str) -> DataFrame:
    """Packing of each conversation's turns into a token budget."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("pack"), F.col("turn").alias("id"), (F.length("text") % 97 / 97.0).alias("score"), F.col("role").alias("bucket"), F.col("turn").alias("episode"), F.ceil(F.length("text") / 4).cast("long").alias("tokens"))
    return retrieval.pack(t, 300, {"user": 3, "assistant": 3, "system": 1})


@query("SORT-6", f"WITH {CLAIMS} SELECT id FROM claims ORDER BY valid_until ASC NULLS FIRST, valid_from, id LIMIT 100")
def sort_6(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).orderBy(F.asc_nulls_first("valid_until"), "valid_from", "id").limit(100).select("id")


@query("SORT-7", "SELECT p_partkey FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 25")
def sort_7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey > 100").orderBy("p_partkey").limit(25).select("p_partkey")


@query("SORT-8", f"WITH {KNN} SELECT ask, id FROM (SELECT ask, id, row_number() OVER (PARTITION BY ask ORDER BY rank) AS r FROM knn WHERE id % 3 <> 0) WHERE r <= 3")
def sort_8(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("ask").orderBy("rank")
    return knn(spark, d).filter("id % 3 <> 0").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("ask", "id")


@query("SET-1", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def set_1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).union(table(spark, d, "part").filter("p_size > 40").select("p_partkey")).distinct()


@query("SET-2", "SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40)")
def set_2(spark: SparkSession, d: str) -> DataFrame:
    return set_1(spark, d).agg(N().alias("n"))


@query("SET-3", f"WITH {MENTIONS}, s AS (SELECT episode, list(entity) AS e FROM mentions GROUP BY 1) SELECT a.episode, len(list_intersect(a.e, b.e)) AS shared, round(len(list_intersect(a.e, b.e)) / (len(a.e) + len(b.e) - len(list_intersect(a.e, b.e)))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON b.episode = a.episode + 1")
def set_3(spark: SparkSession, d: str) -> DataFrame:
    s = tables.mentions(spark, d).groupBy("episode").agg(F.collect_set("entity").alias("e"))
    n = s.select((F.col("episode") - 1).alias("episode"), F.col("e").alias("f"))
    both = F.size(F.array_intersect("e", "f"))
    return s.join(n, "episode").select("episode", both.cast("long").alias("shared"), r6(both / (F.size("e") + F.size("f") - both)).alias("jaccard"))


@query("SET-4", f"WITH {GRAPH}, {BOTH}, seeds AS (SELECT DISTINCT entity AS id FROM mentions WHERE entity % 50 = 0) SELECT DISTINCT other AS id FROM both_ways WHERE node % 50 = 0 EXCEPT SELECT id FROM seeds")
def set_4(spark: SparkSession, d: str) -> DataFrame:
    e = tables.both_ways(tables.edges(spark, d))
    seeds = tables.mentions(spark, d).filter("entity % 50 = 0").select(F.col("entity").alias("id")).distinct()
    return e.filter("node % 50 = 0").select(F.col("other").alias("id")).distinct().join(seeds, "id", "left_anti")


@query("SET-5", "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY 2")
def set_5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(hashing.vector_input_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("SET-6", "WITH served AS (SELECT doc_id AS id, sha256(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS fp FROM documents WHERE doc_id % 2 = 0) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM served s WHERE s.id = d.doc_id AND s.fp = sha256(d.text))")
def set_6(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    served = docs.filter("doc_id % 2 = 0").select("doc_id", hashing.vector_input_hash(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))).alias("fp"))
    return docs.select("doc_id", hashing.vector_input_hash(F.col("text")).alias("fp")).join(served, ["doc_id", "fp"], "left_anti").select("doc_id")
