"""Operator 7: token ids in binary segments whose document boundaries are Elias-Fano coded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common, elias_fano
from palimpsest.llm.tokenizing import encoder

#: Ids after which a segment is closed; a longer document has one of its own.
SEGMENT = 1 << 19
#: Text bytes of a shard, about, and the most shards that the driver names bounds of.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 20_000
_LEAST_ID = -(1 << 63)
#: Text bytes and rows that are encoded at a time, about: a part is looked up once in each of these stretches.
PIECE_BYTES, PIECE_ROWS = 8 << 20, 1 << 14
#: Documents whose boundaries are selected at a time when a segment is read through.
RUN = 4096
#: magic, version, bytes an id, leading documents without doc_id, documents, ids, base of doc_ids, bytes of each sequence
_HEAD = struct.Struct("<4sBBIQQqQQ")
_MAGIC = b"PLTK"


def pack(doc_ids: list[int | None], ids: list[np.ndarray], kind: np.dtype) -> bytes:
    """One segment: header, boundaries and doc_ids in Elias-Fano form, then the concatenated ids."""
    none = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[none:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = elias_fano.encode(np.cumsum([0, *map(len, ids)]))
    names = elias_fano.encode((known - base).astype(np.uint64))
    total = sum(map(len, ids))
    return b"".join([_HEAD.pack(_MAGIC, 2, kind.itemsize, none, len(ids), total, base, len(ends), len(names)), ends, names, *[x.astype(kind, copy=False).tobytes() for x in ids]])


class Segment:
    """Reads a segment; document i's ids are between the i-th and the next boundary."""

    def __init__(self, blob: bytes | memoryview):
        magic, version, width, self.none, self.n_docs, self.n_ids, self.base, a, b = _HEAD.unpack_from(blob)
        if (magic, version) != (_MAGIC, 2):
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.bounds = elias_fano.Sequence(memoryview(blob)[at : at + a])
        self.names = elias_fano.Sequence(memoryview(blob)[at + a : at + a + b])
        self.ids = np.frombuffer(blob, f"<u{width}", self.n_ids, at + a + b)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.none else self.base + self.names.select(i - self.none)

    def runs(self, size: int = RUN) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """(doc_ids, boundaries) of so many documents at a time; there is one boundary more than documents."""
        for i in range(0, self.n_docs, size):
            z = min(self.n_docs, i + size)
            known = self.names.select_run(max(0, i - self.none), max(0, z - self.none) - max(0, i - self.none))
            yield [None] * max(0, min(z, self.none) - i) + (known + self.base).tolist(), self.bounds.select_run(i, z - i + 1)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _boundaries(docs: DataFrame) -> np.ndarray:
    """doc_ids that part the rows into shards of about SHARD_BYTES of text; one that fills several shards repeats."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = min(MOST_SHARDS, -(-size // SHARD_BYTES))
    if shards < 2:
        return np.empty(0, np.int64)
    found = docs.select(F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("k")).approxQuantile("k", [i / shards for i in range(1, shards)], 0.2 / shards)
    return np.sort(np.clip(np.array(found), -(2.0**63), 2.0**63 - 1024).astype(np.int64))


def encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """(doc_id, tie, shard, ids): each document's ids and the end id, as little-endian numbers of the tokenizer's width,
    their hash, and the shard between whose bounds the doc_id lies. Of a doc_id that is a bound itself, the hash tells which
    of the shards that meet there; so shards follow the order of (doc_id, tie)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(tokenizer)
        last = np.array([end_id], use.kind).tobytes()
        for whole in batches:
            for b in common.pieces(whole, PIECE_ROWS, most=PIECE_BYTES):
                line, sizes = use.ids(b.column("text"))
                found = [x.astype(use.kind, copy=False).tobytes() + last for x in np.split(line, np.cumsum(sizes)[:-1])]
                tie = np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64)
                key = b.column("doc_id").fill_null(_LEAST_ID).to_numpy()
                left, right = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                shard = left + np.minimum((tie / 2.0**64 * (right - left + 1)).astype(np.int64), right - left)
                tie = (tie ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the same order
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tie), pa.array(shard.astype(np.int32)), pa.array(found, pa.binary())], names=["doc_id", "tie", "shard", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tie long, shard int, ids binary")


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, segment: int = SEGMENT) -> None:
    """Encodes the documents and writes segments under the folder out in ascending doc_id order (nulls first).

    Texts are encoded where they are read; only ids go through the shuffle, dealt by range of doc_id and sorted. Documents
    of one doc_id go by the hash of their ids, so the order is defined, and one doc_id may fill several shards. A shard
    is a partition. Segments are rows of a Parquet folder, so that any store Spark reaches holds them and a lost task is
    simply run again: (shard, segment, start_in_shard, n_docs, n_ids, blob). Null texts are empty: their only id is
    end_id. Repeated doc_ids stay, next to each other. A very long text's ids are one document of one segment. Other columns
    are ignored. An empty table writes no segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, shard = encoder(tokenizer).kind, TaskContext.get().partitionId()
        names, ids, held, number, start = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, ids, held, number, start
            row = [[shard], [number], [start], [len(names)], [held], [pack(names, ids, kind)]]
            start, number, names, ids, held = start + held, number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["shard", "segment", "start_in_shard", "n_docs", "n_ids", "blob"])

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                one = np.frombuffer(x.as_buffer(), kind)
                if names and held + len(one) > segment:
                    yield close()
                names.append(d)
                ids.append(one)
                held += len(one)
        if names:
            yield close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = _boundaries(source)
    dealt = encoded(source, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie").asc()).select("doc_id", "ids")
    ordered.mapInArrow(run, "shard int, segment long, start_in_shard long, n_docs long, n_ids long, blob binary").write.option("compression", "uncompressed").parquet(out)


def read(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: start counts all ids before it.

    Boundaries come by select, a run of documents at a time. Only one row a shard (its sum of ids) is brought together to number the shards' first ids.
    """
    files = spark.read.parquet(out)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sums.select("shard", (F.sum(F.col("n")).over(_running()) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, blob in zip(b.column("first").to_pylist(), b.column("blob"), strict=True):
                s = Segment(memoryview(blob.as_buffer()))
                for names, bounds in s.runs():
                    crc = [zlib.crc32(s.ids[a:z].astype("<u4")) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    placed = files.join(F.broadcast(before), "shard").select((F.col("start_in_shard") + F.col("before")).alias("first"), "blob")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _running():
    from pyspark.sql import Window

    return Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
