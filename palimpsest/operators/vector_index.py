"""An index of vectors in inverted lists: a partitioned table that searches read a few lists of, with an exact mode."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import retrieval, staging

#: Rows, chosen by hash of the id, from which centroids are learnt at most, about; rounds of learning.
SAMPLE, ROUNDS = 20_000, 8
#: Rows that a list has on average, lists at most, and rows that one file of a list holds, about.
LIST_ROWS, MOST_LISTS, FILE_ROWS = 1024, 4096, 1 << 16


@dataclass(frozen=True)
class Index:
    """Where the lists lie, their centroids (unit vectors, a row each) and the angle from each to its farthest member."""

    path: str
    centroids: np.ndarray
    reach: np.ndarray

    @property
    def size(self) -> int:
        return self.centroids.shape[1]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _centroids(rows: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Directions to which the rows are near (k-means on the sphere), from rows as far apart in order as may be."""
    c = rows[np.linspace(0, len(rows) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(rows[i : i + 4096] @ c.T, axis=1) for i in range(0, len(rows), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, rows)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def build(vectors: DataFrame, size: int, lists: int | None = None, path: str | None = None) -> Index:
    """Writes the index of vectors (id, vec) of so many places, with every row in the list of its nearest centroid.

    Centroids are learnt on the driver from about SAMPLE rows, whatever the table; all else is done where rows lie. Lists
    are partitions of the written table; one of many rows is dealt to several files, so no task writes a hot list alone.
    Vectors that are null, zero or of another size have the cosine 0 to all and are in list -1.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("id is not null").select(F.col("id").cast("long").alias("id"), "vec")
    n = rows.count()
    lists = lists or int(max(1, min(MOST_LISTS, n // LIST_ROWS)))
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.filter((F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)) & (F.size("vec") == size)).orderBy(F.xxhash64("id", F.lit(6))).select("vec").toArrow()
    sample = retrieval._matrix(drawn.column("vec"), size)
    sample = sample[(sample != 0).any(1)]
    centroids = _centroids(sample, min(lists, len(sample)), ROUNDS) if len(sample) else np.eye(1, size)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                m = retrieval._matrix(b.column("vec"), size)
                cos = m @ c.T
                near = np.argmax(cos, axis=1)
                real = (m != 0).any(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(np.where(real, near, -1).astype(np.int32)), pa.array(np.where(real, _angles(cos[np.arange(len(m)), near]), 0.0))], names=["id", "vec", "list", "angle"])

    out = path or staging.new_path(spark, "vector-index")
    kind = dict(vectors.dtypes)["vec"]
    dealt = staging.stage(rows.mapInArrow(assign, f"id long, vec {kind}, list int, angle double"), "vector-lists")
    sizes = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach"))
    known = sizes.collect()  # a row a list
    files = F.create_map(*[F.lit(int(x)) for r in known for x in (r["list"], -(-r["n"] // FILE_ROWS))]) if known else F.create_map(F.lit(-1), F.lit(1))
    part = F.pmod(F.xxhash64("id"), F.coalesce(files[F.col("list")], F.lit(1))).cast("int")
    total = max(1, sum(-(-r["n"] // FILE_ROWS) for r in known))
    dealt.withColumn("part", part).repartition(total, "list", "part").sortWithinPartitions("list", "id").drop("part").write.partitionBy("list").parquet(out)
    reach = np.zeros(len(centroids))
    for r in known:
        if r["list"] >= 0:
            reach[r["list"]] = r["reach"]
    return Index(out, centroids, reach)


def _table(spark: SparkSession, index: Index, kind: str) -> DataFrame:
    return spark.read.schema(f"id long, vec {kind}, angle double, list int").parquet(index.path)


def _search(rows: DataFrame, index: Index, names: np.ndarray, asked: np.ndarray, wanted: np.ndarray, k: int, floor: float) -> DataFrame:
    """The k best of the wanted lists for each ask: ask, id, score. wanted: asks x lists."""
    spark = rows.sparkSession
    lists = np.flatnonzero(wanted.any(0))
    sent = spark.sparkContext.broadcast((names, asked, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, wanted = sent.value
        least = np.full(len(names), floor)
        for whole in batches:
            at = whole.column("list").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == z:
                    continue
                own = np.flatnonzero(wanted[:, at[a]])
                for i in range(a, z, 1024):
                    b = whole.slice(i, min(1024, z - i))
                    cos = np.clip(retrieval._matrix(b.column("vec"), asked.shape[1]) @ asked[own].T, -1, 1)
                    ids = b.column("id").to_numpy()
                    if len(ids) > k:
                        least[own] = np.maximum(least[own], np.partition(cos, len(ids) - k, axis=0)[len(ids) - k])
                    r, c = np.nonzero((cos >= least[own][None, :] - 1e-12) & (cos >= floor))
                    yield pa.RecordBatch.from_arrays([pa.array(names[own[c]]), pa.array(ids[r]), pa.array(cos[r, c])], names=["ask", "id", "score"])

    near = rows.filter(F.col("list").isin([int(x) for x in lists])).select("id", "vec", "list")
    found = near.mapInArrow(run, "ask long, id long, score double")
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def search(index: Index, asks: DataFrame, k: int, probes: int = 8, exact: bool = False, floor: float = 0.0) -> DataFrame:
    """The k nearest indexed vectors of each asked one by cosine above floor: ask, id, score, rank. asks: id, vec.

    Asks are a stated set, taken in blocks of retrieval.ASK_BYTES. Each reads the lists of its probes nearest centroids,
    compared exactly; Spark reads no other partition. exact goes on with every list that may hold a nearer vector: one
    whose centroid is no farther than its reach and the k-th best angle together (the triangle inequality), so that the
    result is that of a comparison with all. floor must be 0 or more: vectors of cosine 0 to all aren't searched. Ties go
    to the smaller id.
    """
    spark = asks.sparkSession
    kind = asks.schema["vec"].dataType.simpleString()
    rows = _table(spark, index, kind)
    blocks = max(1, -(-asks.count() * index.size * 8 // retrieval.ASK_BYTES))
    out = None
    for b in range(blocks):
        held = asks.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vec").toArrow()
        names, asked = held.column("id").to_numpy(), retrieval._matrix(held.column("vec"), index.size)
        angles = _angles(asked @ index.centroids.T)
        wanted = np.zeros(angles.shape, bool)
        if len(names):
            np.put_along_axis(wanted, np.argsort(angles, axis=1, kind="stable")[:, :probes], True, axis=1)
        found = _search(rows, index, names, asked, wanted, k, floor)
        if exact and len(names):
            found = staging.stage(found, "vector-first")
            got = found.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect()  # a row an ask of the block
            bound = np.full(len(names), np.arccos(floor))
            place = {int(x): i for i, x in enumerate(names)}
            for r in got:
                if r["n"] >= k:
                    bound[place[r["ask"]]] = _angles(np.array(r["least"]))
            more = (angles - index.reach[None, :] <= bound[:, None] + 1e-9) & ~wanted
            if more.any():
                w = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
                both = found.unionByName(_search(rows, index, names, asked, more, k, floor))
                found = both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id")))


def measured_recall(index: Index, asks: DataFrame, vectors: DataFrame, k: int, probes: int) -> float:
    """The share of the true k nearest (by comparison with all) that a search of so many probes finds."""
    true = retrieval.knn(asks, vectors, k, 1e-12, skip_self=False).select("ask", "id")
    got = search(index, asks, k, probes, floor=1e-12).select("ask", "id")
    n = true.count()
    return true.join(got, ["ask", "id"], "left_semi").count() / n if n else 1.0
