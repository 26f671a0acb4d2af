"""Intake of reflection documents, episodes and transcripts; idempotent appends; a pluggable embedding provider."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import hashing, redaction
from palimpsest.sources import schemas


def parse(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines as reflection documents; what doesn't parse has null fields and is told by the column broken."""
    doc = F.from_json(value, schemas.REFLECTION)
    return raw.select(doc.alias("d")).select("d.*", F.col("d.turns").isNull().alias("broken"))


def sorted_out(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines as reflection documents with what is wrong with each: value, the document's fields, reason (null: nothing).

    not-json, no-session, no-turns or bad-turn (one without a role or a text), the first that holds.
    """
    schema = T.StructType([*schemas.REFLECTION.fields, T.StructField("palimpsest_corrupt", T.StringType())])
    doc = F.from_json(value, schema, {"columnNameOfCorruptRecord": "palimpsest_corrupt"})
    rows = raw.select(F.col(value).alias("value"), doc.alias("d")).select("value", "d.*")
    reason = F.when(F.col("palimpsest_corrupt").isNotNull() | (F.trim("value") == "") | F.col("value").isNull(), "not-json").when(F.col("session_id").isNull(), "no-session")
    reason = reason.when(F.col("turns").isNull() | (F.size("turns") == 0), "no-turns").when(F.exists("turns", lambda t: t.isNull() | t["role"].isNull() | t["text"].isNull()), "bad-turn")
    return rows.withColumn("reason", reason).drop("palimpsest_corrupt")


def take_in(stream: DataFrame, out: str, checkpoint: str):
    """Takes in a stream of JSON lines (value): what is right goes to out/stored, shaped and redacted, the rest with its reason
    to out/quarantine (SRC-4). Returns the running query.

    Each batch writes folders of its own, which a repeated batch overwrites, and stores no content that an earlier one has
    stored; so neither a restart nor a second run over the same or repaired lines stores anything twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = sorted_out(batch)
        fresh = shape(rows.filter("reason is null").withColumn("broken", F.lit(False)).drop("value", "reason")).dropDuplicates(["session_id", "content_hash"])
        try:
            stored = spark.read.parquet(f"{out}/stored").filter(F.col("epoch") != epoch)
            fresh = fresh.join(stored.select("session_id", "content_hash"), ["session_id", "content_hash"], "left_anti")
        except AnalysisException as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{out}/stored/epoch={epoch}")
        rows.filter("reason is not null").select("value", "reason").write.mode("overwrite").parquet(f"{out}/quarantine/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shape(docs: DataFrame) -> DataFrame:
    """One row a document with its text after redaction, the number of turns and a content hash (SRC-4)."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit(""))))
    shaped = docs.filter("not broken").select("session_id", "lane", F.size("turns").cast("long").alias("n_turns"), redaction.redact(F.array_join(lines, "\n")).alias("text"))
    return shaped.withColumn("content_hash", hashing.content_hash(F.col("text")))


def episodes(turns: DataFrame) -> DataFrame:
    """conv_id, text, first_turn, turns, content_hash of each conversation in the order of its turns (SRC-5)."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    e = turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"))
    return e.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))


def new_only(rows: DataFrame, stored: DataFrame, key: list[str], id_: str) -> DataFrame:
    """The first row of each key that the store doesn't hold yet (SRC-6): an anti join, then one aggregation."""
    return rows.join(stored.select(*key), key, "left_anti").groupBy(*key).agg(F.min(id_).alias(id_))


def append(rows: DataFrame, path: str, key: list[str], id_: str) -> None:
    """Appends to a Parquet folder what it doesn't hold; run again it adds nothing."""
    spark = rows.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # the first append finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.groupBy(*key).agg(F.min(id_).alias(id_)).write.parquet(path)
        return
    new_only(rows, stored, key, id_).write.mode("append").parquet(path)


def transcript_tail(lines: DataFrame, last: int) -> DataFrame:
    """The last turns of each conversation from JSON lines (SRC-16)."""
    t = lines.select(F.from_json("value", "conv_id long, turn long, role string, text string").alias("t")).select("t.*").filter("conv_id is not null")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= last).select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))


def hashed_embedding(c: Column, size: int = 32) -> Column:
    """An offline embedding provider (SRC-17): signed word hashes summed to a vector of length 1."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        def one(x):
            v = np.zeros(size)
            for w in (x or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1 if h >> 63 else -1
            return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32).tolist()

        return s.map(one)

    return embed(c)
