"""Operator 5: SimHash fingerprints linked within a Hamming radius through sharded BK-trees."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common
from palimpsest.llm.bktree import Forest, Union
from palimpsest.operators.components import components

#: Fixed by the contract of the query: words of a shingle, seed of XXH64, radius.
WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints that a shard holds, about, and that one tree holds at most; a larger shard is sharded again.
TARGET, TREE = 1024, 4096
#: Times that large shards are sharded again before they are cut into several trees.
REFINEMENTS = 2
#: Rows of whole shards whose trees are built together.
SLAB = 1 << 15
#: Salts over which the members of a class are dealt to learn its name.
CLASS_SALTS = 16

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def split_words(text: str) -> list[str]:
    """Runs without ASCII white space, A-Z in lower case."""
    text = (text.lower() if text.isascii() else text.translate(_LOWER)).translate(_SPACE)
    return [w for w in text.split(" ") if w]


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of so many words, repeats included; fewer words are one run; none give an empty array."""
    found = [w.encode("utf-8", "surrogatepass") for w in split_words(text)]
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half of the hashes; no hashes give zero."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with fp as a signed long. A null text counts as empty; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole):
                fp = np.array([majority(shingle_hashes(t, words)) for t in common.strings(b)], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]))


def shard_masks(count: int, radius: int, target: int = TARGET, least: int = 0) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree under one mask at least.

    64 bits are cut into radius + k blocks; within the radius k blocks are alike, so every choice of k blocks is a
    mask. k is the least that can part count fingerprints into shards of about target, and of each block only as
    many bits are taken as that needs: shards hold about target, whatever the count. least is the least k.
    """
    need = max(0.0, np.log2(max(1, count) / target))
    k = next(k for k in range(least, 9) if k == 8 or need <= k * (64 // (radius + k)))
    if k == 0:
        return [0]
    width = min(64 // (radius + k), max(1, int(np.ceil(need / k)))) if not least else 64 // (radius + k)
    block = [((1 << width) - 1) << (64 * i // (radius + k)) for i in range(radius + k)]
    return [sum(c) for c in itertools.combinations(block, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sharded(rows: DataFrame, masks: list[int], within: list[str]) -> DataFrame:
    """(shard, fp) of every fingerprint under every mask; within names columns that part shards further."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("s")
    return rows.select("fp", *within, keys).select(F.xxhash64(*within, "s.m", "s.k").alias("shard"), "fp")


def link(prints: DataFrame, radius: int = RADIUS, tree: int = TREE, target: int = TARGET) -> DataFrame:
    """Edges (u, v) that connect the fingerprints as all links within the radius would.

    prints: (fp) without repeats. Shards share the bits of a mask. A shard larger than tree is sharded again by more
    blocks of bits, which loses no pair either; what is still larger is cut into several trees, each asked for its
    own members and those of every later cut, so one task holds two cuts at most. Every shard's BK-tree is built in
    the task that its members are dealt to, and they ask it there. Only a path through each class that a shard finds
    goes out, never all pairs.
    """
    masks = shard_masks(prints.count(), radius, target)
    k = next(k for k in range(9) if len(masks) == math.comb(radius + k, k))
    rows, done = _sharded(prints, masks, []), []
    for more in range(1, REFINEMENTS + 1):
        big = common.stage(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree).select("shard"), "simhash-large")
        n = big.count()
        if not n:
            break
        side = common.small_side(big, n, 8)
        done.append(rows.join(side, "shard", "left_anti").select("shard", F.lit(0).alias("part"), "fp"))
        rows = _sharded(rows.join(side, "shard", "left_semi"), shard_masks(0, radius, least=min(8, k + more)), ["shard"])
    else:
        done.append(cut_shards(rows, tree).select("shard", "part", "fp"))
        rows = None
    parts = rows.select("shard", F.lit(0).alias("part"), "fp") if rows is not None else done.pop()
    for d in done:
        parts = parts.unionByName(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fps in _slabs(batches):
            seen = Union(len(fps))
            for a, b in Forest(fps, group).near(radius):
                seen.join(a, b)
            a, b = seen.chain()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["u", "v"])

    dealt = parts.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def cut_shards(rows: DataFrame, tree: int, by: str = "fp") -> DataFrame:
    """rows (shard, ...) of shards with two members at least, with a column part.

    A shard larger than tree is cut by hash of the column by into cuts of about tree members; a part stands for a
    pair of cuts.
    """
    sizes = common.stage(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shards")
    big = sizes.filter(F.col("n") > tree).withColumn("cuts", F.ceil(F.col("n") / tree).cast("int"))
    n_big, n_all = big.count(), sizes.count()
    small = rows.join(common.small_side(sizes.filter(F.col("n") <= tree).select("shard"), n_all, 24), "shard", "left_semi")
    out = small.select("*", F.lit(0).alias("part"))
    if n_big:
        cut = F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.col("cuts")).cast("int")
        hot = rows.join(common.small_side(big.select("shard", "cuts"), n_big, 24), "shard").withColumn("cut", cut)
        other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
        hot = hot.select("*", other).withColumn("part", F.least("cut", "other") * F.col("cuts") + F.greatest("cut", "other"))
        out = out.unionByName(hot.drop("cuts", "cut", "other"))
    return out


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the shard, fingerprint) of a partition sorted by shard, part and fingerprint: whole shards, about SLAB
    rows at a time, repeats left out."""
    held: list[np.ndarray] = []
    rows = 0
    for b in batches:
        new = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        edge = np.flatnonzero((new[0, 1:] != new[0, :-1]) | (new[1, 1:] != new[1, :-1]))
        begins = bool(held) and new.shape[1] > 0 and not (held[-1][:2, -1] == new[:2, 0]).all()
        if rows >= SLAB and (begins or len(edge)):
            at = 0 if begins else int(edge[0]) + 1
            yield _numbered([*held, new[:, :at]])
            held, rows, new = [], 0, new[:, at:]
        if new.shape[1]:
            held.append(new)
            rows += new.shape[1]
    if held:
        yield _numbered(held)


def _numbered(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    shard, part, fp = np.concatenate(held, axis=1)
    new = np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])]
    keep = new | np.r_[True, fp[1:] != fp[:-1]]
    return np.cumsum(new)[keep], fp[keep].view(np.uint64)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints within the radius, over any number of links.

    component_id is the least doc_id of the class. Nulls: a null text has fingerprint zero like an empty one; a null
    doc_id is a row of its own that never names a class unless no member has a doc_id. Repeated rows stay repeated. Very
    long texts are hashed whole where they are read. Other columns are ignored. An empty table gives an empty result.
    """
    rows = common.stage(fingerprints(docs, words), "simhash").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(common.SALTS)))
    part = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("first"))
    each = common.stage(part.groupBy("fp").agg(F.min("first").alias("first")), "simhash-distinct")
    root = common.stage(components(link(each.select("fp"), radius)), "simhash-roots")
    # a class may hold most of the corpus: its members learn its name by (root, slot)
    tied = each.join(root.withColumnRenamed("node", "fp"), "fp").withColumn("slot", F.pmod(F.xxhash64("fp"), F.lit(CLASS_SALTS)).cast("int"))
    least = tied.groupBy("root", "slot").agg(F.min("first").alias("first")).groupBy("root").agg(F.min("first").alias("component_id"))
    least = least.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))))
    found = tied.select("fp", "root", "slot").join(least, ["root", "slot"]).select("fp", "component_id")
    named = each.join(found, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    spread = part.select("fp", "salt").join(named, "fp")
    return rows.join(spread, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def hex_print(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
