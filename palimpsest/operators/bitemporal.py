"""Reads over two times: validity and transaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReadMode:
    """Now, as of a valid time, as known at a transaction time, or both. Instants are text or timestamps."""

    as_of: str | None = None
    knew_at: str | None = None

    @property
    def time_travel(self) -> bool:
        """Reads of another time have no side effects (FLT-4)."""
        return self.as_of is not None or self.knew_at is not None


def _holds(start: str, end: str, at: str) -> Column:
    t = F.to_timestamp(F.lit(at))
    return (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))


def readable(mode: ReadMode) -> Column:
    """Which rows a mode sees (FLT-1); intervals hold their start and not their end."""
    if not mode.time_travel:
        return F.col("forgotten_at").isNull()
    out = F.lit(True)
    if mode.as_of is not None:
        out &= _holds("valid_from", "valid_until", mode.as_of)
    if mode.knew_at is not None:
        out &= _holds("tx_from", "tx_until", mode.knew_at)
    return out


def currency(reference: Column) -> Column:
    """superseded, expired or current at an instant (FLT-2)."""
    return F.when(F.col("valid_until") <= reference, "superseded").when(F.col("valid_horizon") <= reference, "expired").otherwise("current")


def current() -> Column:
    """Neither closed nor forgotten (FLT-5)."""
    return F.col("valid_until").isNull() & F.col("forgotten_at").isNull()


def read(nodes: DataFrame, mode: ReadMode, now: str) -> DataFrame:
    """Rows that a mode sees, with their currency at its reference instant."""
    at = F.to_timestamp(F.lit(mode.as_of or mode.knew_at or now))
    return nodes.filter(readable(mode)).withColumn("currency", currency(at))


def latest(events: DataFrame, key: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The last state of each key of an append-only table, by one aggregation without a sort (SRC-12, WR-1)."""
    newest = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(v) for v in values])).alias("newest")
    return events.groupBy(*key).agg(newest).select(*key, *[F.col(f"newest.{v}").alias(v) for v in values])


def close(nodes: DataFrame, closures: DataFrame) -> DataFrame:
    """nodes with valid_until set by the earliest closure (id, at), if they were open (WR-3)."""
    first = closures.groupBy("id").agg(F.min("at").alias("closed_at"))
    return nodes.join(first, "id", "left").withColumn("valid_until", F.coalesce("valid_until", "closed_at")).drop("closed_at")


def forget(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """nodes with forgotten_at set by the earliest event (id, at), if there was none (WR-8)."""
    first = events.groupBy("id").agg(F.min("at").alias("gone_at"))
    return nodes.join(first, "id", "left").withColumn("forgotten_at", F.coalesce("forgotten_at", "gone_at")).drop("gone_at")


def unsupersede(claims: DataFrame, undone: DataFrame) -> DataFrame:
    """Superseded claims after their supersession has been taken back (WR-7): id, superseded_by, valid_until, and the lineage
    edge: lineage, edge_from, edge_until.

    claims: id, superseded_by, valid_until, superseded_at; undone: id, at. The first event at or after the supersession was
    written takes the stamps off. The edge to the successor stays with the time at which it ceased to be believed, so
    that a read of an earlier transaction time still finds it.
    """
    first = claims.join(undone, "id").filter(F.col("at") >= F.col("superseded_at")).groupBy("id").agg(F.min("at").alias("undone_at"))
    c = claims.join(first, "id", "left")
    open_ = F.col("undone_at").isNotNull()
    return c.select("id", F.when(~open_, F.col("superseded_by")).alias("superseded_by"), F.when(~open_, F.col("valid_until")).alias("valid_until"), F.col("superseded_by").alias("lineage"), F.col("superseded_at").alias("edge_from"), F.col("undone_at").alias("edge_until"))
