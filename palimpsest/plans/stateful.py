"""Queries on streams, sessions and queues: STR-S*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import queues, upkeep
from palimpsest.plans.aggregate import N, r6
from palimpsest.plans.registry import query
from palimpsest.sources import schemas
from palimpsest.sources.tables import table
from palimpsest.streaming import sessions


@query(
    "STR-S1",
    """WITH a AS (SELECT event_id, user_id, epoch_us(ts) // 600 AS us, CASE event_id % 50 WHEN 0 THEN 'bulk' WHEN 1 THEN 'interactive' END AS requested FROM events),
        c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS in_session, count(*) OVER (ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS everywhere FROM a),
        r AS (SELECT *, CASE WHEN requested = 'bulk' THEN 'requested' WHEN in_session > 10 THEN 'session-rate' WHEN everywhere > 120 AND in_session > 3 THEN 'global-rate' ELSE 'default' END AS reason FROM c)
       SELECT event_id, in_session, everywhere, CASE WHEN reason = 'default' THEN 'interactive' ELSE 'bulk' END AS lane, reason FROM r""",
)
def str_s1(spark: SparkSession, d: str) -> DataFrame:
    """Lanes by arrival rate, of the session and of all sessions; a month of events is taken to have come within 72 minutes."""
    requested = F.when(F.col("event_id") % 50 == 0, "bulk").when(F.col("event_id") % 50 == 1, "interactive")
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.expr("unix_micros(ts) div 600").alias("us"), requested.alias("requested"))
    return sessions.lanes(e).withColumnRenamed("seq", "event_id")


_SESS = "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"


@query("STR-S2", f"{_SESS} SELECT user_id, session::BIGINT AS session, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM s GROUP BY 1, 2")
def str_s2(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessionise(table(spark, d, "events"))
    return s.groupBy("user_id", "session").agg(N().alias("n"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"))


@query("STR-S2_window", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) + 1800000000 AS closes, count(*) AS n FROM s GROUP BY user_id, session")
def str_s2_window(spark: SparkSession, d: str) -> DataFrame:
    """The same events through session_window, which merges gaps of exactly 30 minutes."""
    w = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(N().alias("n"))
    return w.select("user_id", F.unix_micros("s.start").alias("first"), F.unix_micros("s.end").alias("closes"), "n")


@query(
    "STR-S3",
    """WITH r AS (SELECT user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            s AS (SELECT user_id AS session, count(*) FILTER (event_type = 'error') AS uncovered, max(gap) FILTER (back = 1) AS gap FROM r GROUP BY 1)
       SELECT session, uncovered, uncovered >= 12 OR (uncovered > 0 AND coalesce(gap, 0) >= 600000000) AS boundary FROM s""",
)
def str_s3(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries inside a session; the standing narrative is taken to hold all but its errors."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "event_type")
    covered = e.filter("event_type <> 'error'").groupBy("session").agg(N().alias("covered"))
    return upkeep.mid_session(e, covered)


@query("STR-S4", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str_s4(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling days of a stream with a watermark, run to its end."""
    stream = spark.readStream.schema(schemas.EVENTS).parquet(f"{d}/events.parquet*")
    out = sessions.run_once(sessions.tumbling_days(stream), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("STR-S5", "WITH ledger AS (SELECT o_orderkey AS id, o_orderkey % 3 AS version FROM orders WHERE o_orderstatus = 'F') SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_id NOT IN (SELECT id FROM ledger WHERE version >= 2)")
def str_s5(spark: SparkSession, d: str) -> DataFrame:
    """Replay of what the ledger doesn't hold at this version of the pipeline, in order of occurrence and id by user."""
    ledger = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("version"))
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at"))
    return sessions.to_replay(e, ledger, 2, "user_id").select(F.col("id").alias("event_id"), "user_id", "place")


@query("STR-S6", "WITH e AS (SELECT user_id, list(CASE WHEN event_type IN ('click', 'purchase') THEN 1.0 WHEN event_type = 'error' THEN 2.0 ELSE 0.0 END::DOUBLE ORDER BY ts, event_id) AS steps, count(*) FILTER (event_type = 'view') AS accesses FROM events GROUP BY 1) SELECT user_id, round(list_reduce(list_concat([0.5::DOUBLE], steps), lambda w, x: CASE WHEN x = 1.0 THEN w + 0.1 * (1 - w) WHEN x = 2.0 THEN greatest(0.1, w * 0.95) ELSE w END), 6) AS weight, accesses FROM e")
def str_s6(spark: SparkSession, d: str) -> DataFrame:
    """Usage replay in order: access, reinforcement and decay change a weight step by step, by user."""
    return sessions.replay(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")).select("user_id", r6("weight").alias("weight"), "accesses")


@query("STR-S7", "SELECT conv_id, max(turn) AS covered, count(*) AS turns FROM conversations GROUP BY 1")
def str_s7(spark: SparkSession, d: str) -> DataFrame:
    """Late turns: coverage grows whatever the order of arrival."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("covered"), N().alias("turns"))


#: Events as a queue's log (a job is a user's week): the state of each job at noon of 30 January.
JOBS = """log AS (SELECT user_id * 10 + (day(ts) - 1) // 7 AS job, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'error' THEN 'release' WHEN 'purchase' THEN 'done' ELSE 'claim' END AS event, ts, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00'),
    last AS (SELECT job, arg_max(event, (ts, event_id)) AS event, max(ts) AS seen, count(*) FILTER (event = 'release') AS attempts FROM log GROUP BY 1),
    jobs AS (SELECT job, CASE WHEN event = 'claim' AND seen >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 MINUTE THEN 'held' WHEN attempts >= 5 THEN 'dead' ELSE 'waiting' END AS state, attempts FROM last WHERE event <> 'done')"""


def job_log(spark: SparkSession, d: str) -> DataFrame:
    e = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "error", "release").when(F.col("event_type") == "purchase", "done").otherwise("claim")
    job = F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)
    return table(spark, d, "events").filter("ts <= timestamp'2024-01-30 12:00:00'").select(job.alias("job"), e.alias("event"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query("STR-S8", f"WITH {JOBS} SELECT job, state, attempts FROM jobs")
def str_s8(spark: SparkSession, d: str) -> DataFrame:
    """Leases: stale claims return to the pool, jobs that failed too often are dead, completed ones are gone."""
    return queues.leases(job_log(spark, d), F.to_timestamp(F.lit("2024-01-30 12:00:00")))


@query("STR-S9", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 100")
def str_s9(spark: SparkSession, d: str) -> DataFrame:
    return queues.newest(table(spark, d, "events"), ["event_type"], 100, [F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("STR-S10", "WITH b AS (SELECT user_id, event_type, epoch_us(min(ts)) AS lo, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY lo, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT user_id, event_type AS burst, n FROM r WHERE before < 30")
def str_s10(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("burst")).agg(F.unix_micros(F.min("ts")).alias("lo"), N().alias("n"))
    return queues.whole_bursts(b, ["user_id"], 30).select("user_id", "burst", "n")


@query("STR-S12", "SELECT moment, kind, id FROM (SELECT epoch_us(o_orderdate) AS moment, 'episode' AS kind, o_orderkey AS id FROM orders WHERE o_custkey = 7 UNION ALL SELECT epoch_us(l_shipdate), 'mention', l_orderkey FROM lineitem WHERE l_suppkey = 7 UNION ALL SELECT epoch_us(ts), 'usage', event_id FROM events WHERE user_id = 7)")
def str_s12(spark: SparkSession, d: str) -> DataFrame:
    """A timeline over several stores, by time and kind."""
    o = table(spark, d, "orders").filter("o_custkey = 7").select(F.unix_micros("o_orderdate").alias("moment"), F.lit("episode").alias("kind"), F.col("o_orderkey").alias("id"))
    m = table(spark, d, "lineitem").filter("l_suppkey = 7").select(F.unix_micros("l_shipdate").alias("moment"), F.lit("mention").alias("kind"), F.col("l_orderkey").alias("id"))
    u = table(spark, d, "events").filter("user_id = 7").select(F.unix_micros("ts").alias("moment"), F.lit("usage").alias("kind"), F.col("event_id").alias("id"))
    return o.unionByName(m).unionByName(u).orderBy("moment", "kind", "id")
