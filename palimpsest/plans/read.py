"""Queries on sources and read modes: SRC-*, FLT-*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import hashing, text
from palimpsest.operators import bitemporal, staging, upkeep
from palimpsest.operators.bitemporal import ReadMode
from palimpsest.plans.registry import query
from palimpsest.sources import intake, tables
from palimpsest.sources.tables import CLAIMS, MENTIONS, table
from palimpsest.streaming import sessions

T1, T2, NOW = "1998-06-01 00:00:00", "1999-01-01 00:00:00", "2001-01-01 00:00:00"


def r6(c) -> F.Column:
    return F.round(c, 6)


@query("SRC-1", f"WITH {CLAIMS} SELECT id, subject, value FROM claims WHERE forgotten_at IS NULL AND aspect = '1-URGENT'")
def src_1(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).filter((F.col("aspect") == "1-URGENT") & bitemporal.readable(ReadMode())).select("id", "subject", "value")


@query("SRC-2", f"WITH {CLAIMS} SELECT id, aspect, value FROM claims WHERE id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 100 = 0) AND forgotten_at IS NULL")
def src_2(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").filter("o_custkey % 100 = 0").select(F.col("o_orderkey").alias("id"))
    return tables.claims(spark, d).filter("forgotten_at is null").join(ids, "id", "left_semi").select("id", "aspect", "value")


@query("SRC-3", "SELECT vec_id AS id, label, len(embedding) AS dims, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def src_3(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return tables.vectors(spark, d).join(ids, "id", "left_semi").select("id", "label", F.size("vec").cast("long").alias("dims"), F.round(F.col("vec")[0].cast("double"), 5).alias("first"))


@query(
    "SRC-4",
    """WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), r AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'not-json' WHEN conv_id % 11 = 0 THEN 'no-turns' WHEN conv_id % 13 = 0 THEN 'bad-turn' END AS reason FROM c)
       SELECT CASE WHEN reason IS NULL THEN 'stored' ELSE 'quarantined' END AS state, reason, count(*) AS n, coalesce(sum(CASE WHEN reason IS NULL THEN turns END), 0)::BIGINT AS turns FROM r GROUP BY 1, 2
       UNION ALL SELECT 'after repair', NULL, count(*), sum(turns)::BIGINT FROM c""",
)
def src_4(spark: SparkSession, d: str) -> DataFrame:
    """Intake as a stream of JSON lines, some of them planted broken: what is stored, what is in quarantine and why, and what is
    stored after a second run over all lines repaired."""
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = lambda role: F.to_json(F.struct(F.transform("t", lambda x: F.struct(role(x).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias("turns"), F.col("conv_id").cast("string").alias("session_id"), F.lit("interactive").alias("lane")))
    right, k = lines(lambda x: x["role"]), F.col("conv_id")
    wrong = F.when(k % 7 == 0, F.substring(right, 1, 30)).when(k % 11 == 0, F.to_json(F.struct(k.cast("string").alias("session_id"), F.array().alias("turns")))).when(k % 13 == 0, lines(lambda x: F.lit(None).cast("string"))).otherwise(right)
    box, out, done = (staging.new_path(spark, x) for x in ("lines", "intake", "intake-state"))
    docs = staging.stage(docs, "conversations")
    for value in (wrong, right):
        docs.select(value.alias("value")).write.mode("append").text(box)
        intake.take_in(spark.readStream.text(box), out, done).awaitTermination()
        if value is wrong:
            stored, held = (staging.stage(spark.read.parquet(f"{out}/{x}").drop("epoch"), x) for x in ("stored", "quarantine"))
    none = F.lit(None).cast("string")
    first = stored.agg(F.count(F.lit(1)).alias("n"), F.sum("n_turns").alias("turns")).select(F.lit("stored").alias("state"), none.alias("reason"), "n", "turns")
    rest = held.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("quarantined").alias("state"), "reason", "n", F.lit(0).cast("long").alias("turns"))
    last = spark.read.parquet(f"{out}/stored").agg(F.count(F.lit(1)).alias("n"), F.sum("n_turns").alias("turns")).select(F.lit("after repair").alias("state"), none.alias("reason"), "n", "turns")
    return first.unionByName(rest).unionByName(last)


@query(
    "SRC-5",
    """SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text, min(turn) AS first_turn, count(*) AS turns,
              sha256(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id""",
)
def src_5(spark: SparkSession, d: str) -> DataFrame:
    return intake.episodes(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))


@query(
    "SRC-6",
    """WITH s AS (SELECT source, sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL)
       SELECT min(doc_id) AS doc_id, source, sha256(text) AS content_hash FROM documents n WHERE doc_id % 2 = 1
       AND NOT EXISTS (SELECT 1 FROM s WHERE s.source = n.source AND s.h = sha256(n.text)) GROUP BY source, sha256(text)""",
)
def src_6(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", hashing.vector_input_hash(F.col("text")).alias("content_hash"))
    return intake.new_only(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), ["source", "content_hash"], "doc_id")


@query("SRC-7", "SELECT sha256(source || chr(0) || sha256(text) || chr(0) || 'v1') AS idempotency_key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def src_7(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    key = hashing.derived_id(F.col("source"), hashing.vector_input_hash(F.col("text")), F.lit("v1"))
    return docs.groupBy(key.alias("idempotency_key")).agg(F.min("doc_id").alias("doc_id"))


@query("SRC-8", "SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0) AND event_type = 'purchase' ORDER BY ts, event_id LIMIT 50")
def src_8(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    e = table(spark, d, "events").filter(((F.col("ts") > at) | ((F.col("ts") == at) & (F.col("event_id") > 0))) & (F.col("event_type") == "purchase"))
    return e.orderBy("ts", "event_id").limit(50).select("event_id", "user_id", F.unix_micros("ts").alias("at"))


@query("SRC-9", "SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY md5(event_id || ':7'), event_id LIMIT 20")
def src_9(spark: SparkSession, d: str) -> DataFrame:
    """A random sample before a date: the order of seeded hashes, the same however the rows are dealt."""
    return table(spark, d, "events").filter("ts < timestamp'2024-01-15'").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7"))), "event_id").limit(20).select("event_id", "event_type")


@query("SRC-10", "SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events GROUP BY event_type")
def src_10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query("SRC-11", "SELECT event_id, event_type AS kind, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def src_11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_id > 500").orderBy("event_id").limit(100).select("event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SRC-12", "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value, epoch_us(max(ts)) AS at FROM events GROUP BY user_id")
def src_12(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"key": F.col("user_id"), "value": F.col("event_type"), "at": F.unix_micros("ts")})
    return bitemporal.latest(e, ["key"], [F.col("at"), F.col("event_id")], ["value", "at"])


@query("SRC-13", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'PROMO')")
def src_13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_type").startswith("PROMO")).select("p_partkey", "p_name")


@query("SRC-14", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS dump FROM part")
def src_14(spark: SparkSession, d: str) -> DataFrame:
    """All properties of type string, in the schema's order."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat_ws(" ", *[f.name for f in p.schema if f.dataType.typeName() == "string"]).alias("dump"))


@query("SRC-15", "SELECT l_orderkey AS episode, count(*) AS turns, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1")
def src_15(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return lines.groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(ordered, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SRC-16", "SELECT conv_id, turn, role, length(text)::BIGINT AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3")
def src_16(spark: SparkSession, d: str) -> DataFrame:
    """Transcript lines (JSON objects) with the last turns of each session."""
    lines = table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    return intake.transcript_tail(lines, 3)


@query("SRC-17")
def src_17(spark: SparkSession, d: str) -> DataFrame:
    """A pluggable embedding provider; without a model it is a hash of words, for offline use."""
    return table(spark, d, "benchmark").select("item_id", intake.hashed_embedding(F.col("text")).alias("vec"))


@query(
    "SRC-18",
    "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g), t AS (SELECT user_id AS member, min(event_id) AS id, arg_min(event_id % 3, (ts, event_id)) AS workspace, min(ts) AS began FROM s GROUP BY user_id, session) SELECT member, workspace, id, lag(id) OVER (PARTITION BY member, workspace ORDER BY began, id) AS follows FROM t",
)
def src_18(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a member in a workspace, each following the one before it there."""
    s = sessions.sessionise(table(spark, d, "events"))
    t = s.groupBy(F.col("user_id").alias("member"), "session").agg(F.min("event_id").alias("id"), F.min_by(F.col("event_id") % 3, F.struct("ts", "event_id")).alias("workspace"), F.min("ts").alias("at"))
    follows = F.lag("id").over(Window.partitionBy("member", "workspace").orderBy("at", "id"))
    return t.select("member", "workspace", "id", follows.alias("follows"))


@query("SRC-19", "SELECT c.c_custkey AS member, n.n_name AS workspace, r.r_name AS substrate FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def src_19(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    backbone = n.join(r, n.n_regionkey == r.r_regionkey)
    return table(spark, d, "customer").join(backbone, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("member"), F.col("n_name").alias("workspace"), F.col("r_name").alias("substrate"))


_CUR = "CASE WHEN valid_until <= {t} THEN 'superseded' WHEN valid_horizon <= {t} THEN 'expired' ELSE 'current' END AS currency"
_MODES = {
    "default": (ReadMode(), "forgotten_at IS NULL", NOW),
    "as_of": (ReadMode(as_of=T1), f"valid_from <= TIMESTAMP '{T1}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{T1}')", T1),
    "knew_at": (ReadMode(knew_at=T2), f"tx_from <= TIMESTAMP '{T2}' AND (tx_until IS NULL OR tx_until > TIMESTAMP '{T2}')", T2),
    "both": (
        ReadMode(as_of=T1, knew_at=T2),
        f"valid_from <= TIMESTAMP '{T1}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{T1}') AND tx_from <= TIMESTAMP '{T2}' AND (tx_until IS NULL OR tx_until > TIMESTAMP '{T2}')",
        T1,
    ),
}


def _mode(name: str):
    mode, where, at = _MODES[name]
    cur = _CUR.format(t=f"TIMESTAMP '{at}'")

    @query(f"FLT-1_{name}", f"WITH {CLAIMS} SELECT id, subject, aspect, {cur} FROM claims WHERE {where}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return bitemporal.read(tables.claims(spark, d), mode, NOW).select("id", "subject", "aspect", "currency")

    return run


for _name in _MODES:
    _mode(_name)


@query("FLT-2", f"WITH {CLAIMS}, c AS (SELECT {_CUR.format(t=f'''TIMESTAMP '{T2}' ''')} FROM claims) SELECT currency, count(*) AS n FROM c GROUP BY 1")
def flt_2(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).groupBy(bitemporal.currency(F.to_timestamp(F.lit(T2))).alias("currency")).agg(F.count(F.lit(1)).alias("n"))


@query("FLT-3", f"WITH {CLAIMS} SELECT c.id, min(s.id) AS superseded_by FROM claims c LEFT JOIN claims s ON c.superseded_by = s.id AND s.tx_from <= TIMESTAMP '{T2}' GROUP BY c.id")
def flt_3(spark: SparkSession, d: str) -> DataFrame:
    c = tables.claims(spark, d)
    known = c.filter(F.col("tx_from") <= F.to_timestamp(F.lit(T2))).select(F.col("id").alias("superseded_by"), F.col("id").alias("head"))
    return c.select("id", "superseded_by").join(known, "superseded_by", "left").groupBy("id").agg(F.min("head").alias("superseded_by"))


_BY_MODE = ["default", "as_of", "knew_at", "both"]


@query("FLT-4", "SELECT l_orderkey AS recall, l_partkey AS id, count(*) AS accesses FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1, 2")
def flt_4(spark: SparkSession, d: str) -> DataFrame:
    """The writes after recalls: orders as recalls in one mode or another, lines as what they served. Recalls of another time
    leave no access behind."""
    writes = F.array(*[F.lit(not _MODES[m][0].time_travel) for m in _BY_MODE])
    served = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recall"), F.col("l_partkey").alias("id"))
    return served.filter(F.element_at(writes, (F.col("recall") % 4 + 1).cast("int"))).groupBy("recall", "id").agg(F.count(F.lit(1)).alias("accesses"))


@query("FLT-5", f"WITH {CLAIMS} SELECT id, subject FROM claims WHERE valid_until IS NULL AND forgotten_at IS NULL")
def flt_5(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).filter(bitemporal.current()).select("id", "subject")


@query("FLT-6", f"WITH {MENTIONS}, m AS (SELECT entity, count(*) AS mention_count FROM mentions GROUP BY 1) SELECT p_partkey AS id, coalesce(p_name, p_type, '') AS content, coalesce(mention_count, 0) AS mention_count FROM part LEFT JOIN m ON p_partkey = entity")
def flt_6(spark: SparkSession, d: str) -> DataFrame:
    m = tables.mentions(spark, d).groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("mention_count"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce("p_name", "p_type", F.lit("")).alias("content"))
    return p.join(m, "id", "left").na.fill(0, ["mention_count"])


@query("FLT-7", "SELECT p_partkey, list_filter(string_split(p_type, ' '), lambda x: x IN ('PROMO', 'STEEL', 'BRASS'))[1] AS first_label FROM part WHERE list_has_any(string_split(p_type, ' '), ['PROMO', 'STEEL', 'BRASS'])")
def flt_7(spark: SparkSession, d: str) -> DataFrame:
    wanted, labels = F.array(*map(F.lit, ("PROMO", "STEEL", "BRASS"))), F.split("p_type", " ")
    return table(spark, d, "part").filter(F.arrays_overlap(labels, wanted)).select("p_partkey", F.filter(labels, lambda x: F.array_contains(wanted, x))[0].alias("first_label"))


@query(
    "FLT-8",
    """WITH made AS (SELECT vec_id AS id, md5(regexp_replace(text, '[0-9]', '', 'g')) AS h FROM embeddings JOIN documents ON doc_id = vec_id)
       SELECT d.doc_id, m.id IS NULL AS missing FROM documents d LEFT JOIN made m ON m.id = d.doc_id WHERE trim(d.text) <> '' AND m.h IS DISTINCT FROM md5(d.text)""",
)
def flt_8(spark: SparkSession, d: str) -> DataFrame:
    """Texts without a vector of their present state; vectors are planted as made before digits came into the texts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    made = docs.withColumn("text_hash", F.md5(F.regexp_replace("text", "[0-9]", "").cast("binary")))
    made = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).join(made.select("id", "text_hash"), "id")
    return upkeep.pending_vectors(docs, made).withColumnRenamed("id", "doc_id")


@query("FLT-9", f"WITH {CLAIMS} SELECT count(*) FILTER (valid_until = valid_horizon) AS at_horizon, count(*) FILTER (valid_until > valid_horizon) AS after_horizon, count(*) AS n FROM claims")
def flt_9(spark: SparkSession, d: str) -> DataFrame:
    return tables.claims(spark, d).agg(F.count_if(F.col("valid_until") == F.col("valid_horizon")).alias("at_horizon"), F.count_if(F.col("valid_until") > F.col("valid_horizon")).alias("after_horizon"), F.count(F.lit(1)).alias("n"))


@query("FLT-10", "SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> 'system'")
def flt_10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("role") != "system")).select("conv_id", "turn")


#: SQL for a name's shape.
SHAPE = r"""CASE WHEN regexp_full_match(lower(name), '[0-9a-f]{40}|[0-9a-f]{64}') THEN 'sha' WHEN regexp_full_match(lower(name), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'uuid'
            WHEN regexp_full_match(lower(name), 'code-na[0-9a-f]{6,}') THEN 'agent_id' WHEN len(regexp_extract_all(name, '[/\\]')) >= 2 AND NOT regexp_matches(name, '\s') THEN 'path' END"""


@query(
    "FLT-11",
    f"""WITH n AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN upper(substr(sha256(event_id::VARCHAR), 1, 40)) WHEN 1 THEN 'code-Na' || lpad(event_id::VARCHAR, 6, '0') WHEN 2 THEN '/var/' || event_type WHEN 3 THEN event_type
            WHEN 4 THEN sha256(event_id::VARCHAR) WHEN 5 THEN substr(md5(event_id::VARCHAR), 1, 12) WHEN 6 THEN event_type || '/or' WHEN 7 THEN 'a/b, c/' || event_type || ' d' ELSE '123e4567-e89b-12d3-a456-42661417' || lpad((event_id % 10000)::VARCHAR, 4, '0') END AS name FROM events)
        SELECT event_id, name, {SHAPE} AS shape FROM n""",
)
def flt_11(spark: SparkSession, d: str) -> DataFrame:
    """Names of every shape, and some that only look like one: a short digest, one separator, prose with slashes."""
    i, kind = F.col("event_id"), F.col("event_type")
    key = i.cast("string").cast("binary")
    named = [
        F.upper(F.substring(F.sha2(key, 256), 1, 40)), F.concat(F.lit("code-Na"), F.lpad(i.cast("string"), 6, "0")), F.concat(F.lit("/var/"), kind), kind,
        F.sha2(key, 256), F.substring(F.md5(key), 1, 12), F.concat(kind, F.lit("/or")), F.concat(F.lit("a/b, c/"), kind, F.lit(" d")),
        F.concat(F.lit("123e4567-e89b-12d3-a456-42661417"), F.lpad((i % 10000).cast("string"), 4, "0")),
    ]
    name = F.element_at(F.array(*named), (i % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", name.alias("name")).withColumn("shape", text.identifier_shape(F.col("name")))


@query(
    "FLT-12",
    """WITH routes AS (SELECT 'entity' AS kind, l_partkey AS id, o_custkey AS session FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'source', l_suppkey, o_custkey FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'claim', o_orderkey, o_custkey FROM orders)
       SELECT kind, id, bool_or(session IS NOT DISTINCT FROM 7) AS own, bool_or(session IS DISTINCT FROM 7) AS other FROM routes GROUP BY 1, 2""",
)
def flt_12(spark: SparkSession, d: str) -> DataFrame:
    """Items of the asking session (customer 7) and of others: by mentions, by sources and by an item's own session."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("session"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey").join(orders, "o_orderkey", "left")
    items = F.inline(F.array(F.struct(F.lit("entity").alias("kind"), F.col("l_partkey").alias("id")), F.struct(F.lit("source").alias("kind"), F.col("l_suppkey").alias("id"))))
    claims = orders.select(F.lit("claim").alias("kind"), F.col("o_orderkey").alias("id"), "session")
    return upkeep.origins(lines.select(items, "session").unionByName(claims), ["kind", "id"], 7)
