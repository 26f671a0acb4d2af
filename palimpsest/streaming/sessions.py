"""Sessions by idleness, arrival lanes, tumbling days and replay, in batch and as Structured Streaming."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import weights
from palimpsest.operators import staging

IDLE_US = 30 * 60 * 1_000_000


def sessionise(events: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """events with a session number by user: a gap of idle or more begins a new one (STR-S2)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    return events.withColumn("new", F.when(gap.isNull() | (gap >= idle_us), 1).otherwise(0)).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


@dataclass(frozen=True)
class Rates:
    """Arrivals within the window, which doesn't hold its lower bound, from which a session's work goes to the bulk lane: of
    the session itself, or of all sessions together where the session has some part in it."""

    window_us: int = 5 * 60 * 1_000_000
    session: int = 10
    everywhere: int = 120
    hot_session: int = 3


def arrivals(events: DataFrame, window_us: int) -> DataFrame:
    """(seq, everywhere): events of all sessions within the window up to each event, events of the same instant included.

    events: seq (unique), us. Sums of each second are added up over the whole seconds of the window, in partitions of an
    hour that hold the window before them; the parts of its two end seconds are counted within those seconds. So no task
    gets more than an hour's seconds or a second's events.
    """
    million, w = 1_000_000, window_us // 1_000_000
    if window_us % million:
        raise ValueError("the window is of whole seconds")
    second = lambda c: F.floor(c / million).cast("long")
    ends = F.explode(F.array(F.struct(F.col("us").alias("at"), F.lit(1).alias("own")), F.struct((F.col("us") - window_us).alias("at"), F.lit(0).alias("own")))).alias("e")
    rows = events.select("seq", ends).select("seq", "e.at", "e.own", second(F.col("e.at")).alias("s"))
    upto = F.sum("own").over(Window.partitionBy("s").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.select("seq", "own", "s", upto.alias("upto"), F.sum("own").over(Window.partitionBy("s")).alias("of"))
    # in the first second what comes after the bound counts, in the last one what comes up to the event
    part = rows.groupBy("seq").agg(F.sum(F.when(F.col("own") == 1, F.col("upto")).otherwise(F.col("of") - F.col("upto"))).alias("part"), F.max("s").alias("s"))
    counts = events.groupBy(second(F.col("us")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    hours = F.explode(F.sequence(F.floor(F.col("s") / 3600), F.floor((F.col("s") + w) / 3600))).alias("hour")
    between = F.sum("n").over(Window.partitionBy("hour").orderBy("s").rangeBetween(-(w - 1), -1))
    whole = counts.select("s", "n", hours).withColumn("between", F.coalesce(between, F.lit(0))).filter(F.floor(F.col("s") / 3600) == F.col("hour")).select("s", "between")
    return part.join(whole, "s").select("seq", (F.col("part") + F.col("between")).alias("everywhere"))


def lanes(events: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """(seq, in_session, everywhere, lane, reason) of each arrival (STR-S1). events: seq (unique), session, us, requested.

    bulk where it was asked for, where a session's own rate is too high, or where all sessions' is and the session isn't
    idle; asking for the interactive lane changes nothing.
    """
    w = Window.partitionBy("session").orderBy("us").rangeBetween(-(rates.window_us - 1), 0)
    rows = events.withColumn("in_session", F.count(F.lit(1)).over(w)).join(arrivals(events, rates.window_us), "seq")
    reason = F.when(F.col("requested") == "bulk", "requested").when(F.col("in_session") > rates.session, "session-rate")
    reason = reason.when((F.col("everywhere") > rates.everywhere) & (F.col("in_session") > rates.hot_session), "global-rate").otherwise("default")
    return rows.select("seq", "in_session", "everywhere", F.when(reason == "default", "interactive").otherwise("bulk").alias("lane"), reason.alias("reason"))


def tumbling_days(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of each day and kind; the watermark only lets old state go (STR-S4)."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def streamed_sessions(stream: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def distinct_within(stream: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't come within the watermark: an idempotent intake (SRC-6)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def append_once(stream: DataFrame, out: str, key: list[str], checkpoint: str):
    """A sink that a repeated batch doesn't change: each batch overwrites its own folder (STR-S5)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and gives the last state of its result table, from the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = staging.new_path(spark, "stream"), staging.new_path(spark, "stream-state")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    schema = stream.schema
    q = stream.writeStream.queryName(f"once_{uuid.uuid4().hex[:8]}").outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _after(f: tuple[float, float, float], g: tuple[float, float, float]) -> tuple[float, float, float]:
    """g after f."""
    return max(g[0], g[1] * f[0] + g[2]), g[1] * f[1], g[1] * f[2] + g[2]


#: What each kind of event makes of a weight w, as max(floor, scale x w + shift).
STEPS = {
    **dict.fromkeys(("click", "purchase"), (-math.inf, 1 - weights.REINFORCE_RATE, weights.REINFORCE_RATE)),
    "error": (weights.STRENGTH_FLOOR, 1 - weights.DECAY_RATE, 0.0),
}
_STAY = (-math.inf, 1.0, 0.0)


def replay(events: DataFrame, start: float = 0.5) -> DataFrame:
    """The weight and accesses of each user after its events in order (STR-S6).

    Steps don't commute, but they compose to functions of the same form: a user's events of each day are folded to one
    function as they stream by in order, and the few functions of a user are put one after the other. So no task gets a
    busy user's whole history, and none holds more than one function.
    """
    names = ["user_id", "day", "floor", "scale", "shift", "accesses"]
    kinds = [pa.int64(), pa.timestamp("us", "UTC"), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, accesses = None, _STAY, 0
        for b in batches:
            out = []
            for user, day, kind in zip(*[b.column(c).to_pylist() for c in ("user_id", "day", "event_type")], strict=True):
                if (user, day) != key:
                    if key is not None:
                        out.append((*key, *f, accesses))
                    key, f, accesses = (user, day), _STAY, 0
                f, accesses = _after(f, STEPS.get(kind, _STAY)), accesses + (kind == "view")
            yield _rows(out, names, kinds)
        if key is not None:
            yield _rows([(*key, *f, accesses)], names, kinds)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, f, accesses = None, _STAY, 0
        last = lambda: (user, max(f[0], f[1] * start + f[2]), accesses)
        to = (["user_id", "weight", "accesses"], [pa.int64(), pa.float64(), pa.int64()])
        for b in batches:
            out = []
            for u, *g, n in zip(*[b.column(c).to_pylist() for c in ("user_id", "floor", "scale", "shift", "accesses")], strict=True):
                if u != user:
                    if user is not None:
                        out.append(last())
                    user, f, accesses = u, _STAY, 0
                f, accesses = _after(f, tuple(g)), accesses + n
            yield _rows(out, *to)
        if user is not None:
            yield _rows([last()], *to)

    days = events.filter("user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.date_trunc("day", "ts").alias("day"), "ts", "event_id", "event_type")
    folded = days.repartition("user_id", "day").sortWithinPartitions("user_id", "day", "ts", "event_id").select("user_id", "day", "event_type")
    folded = folded.mapInArrow(fold, "user_id long, day timestamp, floor double, scale double, shift double, accesses long")
    return folded.repartition("user_id").sortWithinPartitions("user_id", "day").mapInArrow(chain, "user_id long, weight double, accesses long")


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def to_replay(episodes: DataFrame, ledger: DataFrame, version: int, by: str) -> DataFrame:
    """Episodes that a replay at a version of the pipeline goes through, with their place (STR-S5). episodes: id, at, by;
    ledger: id, version.

    The ledger's key is an id with the version that processed it: what an older version did is replayed, so that a second
    run of the same version does nothing. Places are by occurrence, then id, within each group.
    """
    done = ledger.filter(F.col("version") >= version).select("id")
    return episodes.join(done, "id", "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("at", "id")))
