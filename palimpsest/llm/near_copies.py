"""Operator 5 as a filter: near copies by SimHash in sharded BK-trees, confirmed by exact similarity of word shingles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common, exact_dedup
from palimpsest.llm.bktree import Forest, Union
from palimpsest.llm.simhash import CLASS_SALTS, majority, shingle_hashes
from palimpsest.operators.components import components

#: Words of a shingle, least Jaccard similarity of shingle sets.
WORDS, SIMILARITY = 5, 0.8
#: Pairs of least hashes that name a document's shards: with similarity s two documents share none with
#: (1 - s * s) ** SHARDS. A pair, since one shingle of a passage that many documents hold would make a large shard.
SHARDS = 8
#: Differing bits up to which a shard's tree gives a pair; at the least similarity about 10 of 64 differ.
RADIUS = 20
#: Documents that one tree, and one comparison, holds.
TREE = 2048
#: Rows of whole shards whose trees are built together.
SLAB = 1 << 14
_MIX = np.random.default_rng(20).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes of shingle sets that one comparison holds, about, beside a single set of any size.
SET_BYTES = 16 << 20
#: Documents of a large shard, nearest to the majority of its fingerprints, that all its others are compared with first.
LEADERS = 32
#: Shards of the first pass; the classes that it finds spare the second the comparisons within them.
FIRST = 2


def _sketch(text: str, words: int, shards: int, seed: int) -> tuple[int, int, int, list[int], int]:
    """Of a text's different shingles, as similarity counts none twice: two hashes of the set, the fingerprint, the names
    of its shards, their number."""
    h = np.unique(shingle_hashes(text, words))
    own = xxhash.xxh128_intdigest(h.tobytes(), seed)
    node, check = (x - (1 << 64) if x >> 63 else x for x in (own >> 64, own & (1 << 64) - 1))
    if not len(h):
        return node, check, 0, [0] * shards, 0
    least = []
    for i in range(2 * shards):
        m = h * _MIX[i]
        least.append((m ^ (m >> np.uint64(32))).min())
    two = np.array(least, np.uint64).reshape(shards, 2)
    fp = majority(h)
    return node, check, fp - (1 << 64) if fp >> 63 else fp, (two[:, 0] * _MIX[-1] ^ two[:, 1]).view(np.int64).tolist(), len(h)


def sketches(docs: DataFrame, words: int, shards: int, seed: int = 0) -> DataFrame:
    """(doc_id, a, b, node, check, fp, keys, n) of each row; a, b name the row, node and check its set of shingles."""
    names = ["node", "check", "fp", "keys", "n"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for whole in batches:
            for b in common.pieces(whole):
                found = [_sketch(t, words, shards, seed) for t in common.strings(b)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "a", "b")), *(pa.array([f[i] for f in found], t) for i, t in enumerate(types))], names=["doc_id", "a", "b", *names])

    ident = exact_dedup.identity(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ident["a"].alias("a"), ident["b"].alias("b"), "text")
    return rows.mapInArrow(run, "doc_id long, a long, b long, node long, check long, fp long, keys array<long>, n long")


def _shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(a, b, shingles): each row's different shingles as sorted 64-bit hashes. rows: a, b, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole):
                sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in common.strings(b)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sets, pa.binary())], names=["a", "b", "shingles"])

    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long, shingles binary")


def _edges(b: pa.RecordBatch) -> np.ndarray:
    """Whether each row after the first is of another (shard, part) than the one before."""
    shard, part = b.column("shard").to_numpy(zero_copy_only=False), b.column("part").to_numpy(zero_copy_only=False)
    return (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of a sorted partition, about SLAB rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for g in _groups(batches):
        held.append(g)
        rows += g.num_rows
        if rows >= SLAB:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (shard, part) of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        shard, part = b.column("shard").to_numpy(zero_copy_only=False), b.column("part").to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(_edges(b)) + 1, len(shard)]
        for a, z in itertools.pairwise(cuts.tolist()):
            k = (shard[a], part[a])
            if k != key and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = k
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Sets:
    """Sets of hashes with an index of who holds each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        run = np.r_[0, np.flatnonzero(np.diff(flat[order])) + 1, len(flat)] if len(flat) else np.zeros(1, np.int64)
        self.run, self.lengths, self.holders = run, np.diff(run), owner[order]
        self.group = np.empty(len(flat), np.int64)
        self.group[order] = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.at = np.r_[0, np.cumsum(self.sizes)]

    def close(self, i: int, least: float) -> np.ndarray:
        """The other sets whose similarity to set i is at least so much; that of two empty ones is 1."""
        if not self.sizes[i]:
            found = np.flatnonzero(self.sizes == 0)
            return found[found != i]
        g = self.group[self.at[i] : self.at[i + 1]]
        g = g[self.lengths[g] > 1]
        if not len(g):
            return g
        n = self.lengths[g]
        places = np.repeat(self.run[g] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(self.holders[places], minlength=len(self.sizes))
        found = np.flatnonzero((shared > 0) & (shared >= least * (self.sizes + self.sizes[i] - shared) - 1e-9))
        return found[found != i]


def similar(sets: list[np.ndarray], least: float, known: np.ndarray | None = None, asked: np.ndarray | None = None) -> Union:
    """Classes of sets linked by a Jaccard similarity of at least so much; two empty sets are alike.

    known: a number for each set; sets of one number are of one class already. Sets of one class are never compared.
    While classes grow fast by it, a set without a class asks all others; then all but the largest class ask, so that a
    class of many alike sets costs a pass over them and not one for each. asked: where given, only those ask.
    """
    index, out = Sets(sets), Union(len(sets))
    if known is not None and len(sets):
        order = np.argsort(known, kind="stable")
        same = known[order][1:] == known[order][:-1]
        out.join(order[:-1][same], order[1:][same])

    def ask(i: int) -> int:
        found = index.close(i, least)
        before = len(np.unique(out.label[found])) if len(found) else 0
        if len(found):
            out.join(np.full(len(found), i), found)
        return before

    done = np.zeros(len(sets), bool)
    if asked is not None:
        for i in np.flatnonzero(asked).tolist():
            ask(i)
        return out
    while len(sets):
        # a set that is a class by itself asks; if many follow it, so does the next
        size = np.bincount(out.label, minlength=len(sets))
        alone = np.flatnonzero((size[out.label] == 1) & ~done)
        if not len(alone):
            break
        done[alone[0]] = True
        if ask(int(alone[0])) < max(2, len(alone) // 32):
            break
    largest = np.argmax(np.bincount(out.label)) if len(sets) else 0
    for i in np.flatnonzero((out.label != largest) & ~done).tolist():
        ask(i)
    return out


def _parts(rows: DataFrame, tree: int, set_bytes: int) -> DataFrame:
    """rows (shard, node, fp, n, root) of shards that hold several roots, with part and asks.

    A shard of more than tree documents or set_bytes of shingles is cut by hash of the node. Members of its largest root
    needn't be compared with each other: a part is a cut of all of them beside one of the others, which alone ask.
    """
    size = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    cuts = F.greatest(F.ceil(F.col("m") / tree), F.ceil(F.col("shingles") * 8 / set_bytes)).cast("int")
    sizes = common.stage(size.select("shard", cuts.alias("cuts")), "near-shard-sizes")
    n = sizes.count()
    sized = rows.join(common.small_side(sizes, n, 16), "shard")
    small = sized.filter("cuts = 1").select("shard", F.lit(0).alias("part"), F.lit(True).alias("asks"), "node", "fp", "root")
    large = sized.filter("cuts > 1")
    if large.isEmpty():
        return small
    most = large.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("shard").agg(F.max(F.struct("m", "root")).alias("x")).select("shard", F.col("x.root").alias("most"))
    large = large.join(common.small_side(most, n, 16), "shard").withColumn("asks", F.col("root") != F.col("most"))
    few = large.filter("asks").groupBy("shard").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("k_shingles"))
    large = large.join(common.small_side(few, n, 16), "shard").withColumn("few", F.greatest(F.ceil(F.col("k") / tree), F.ceil(F.col("k_shingles") * 8 / set_bytes)).cast("int"))
    cut = lambda c: F.pmod(F.xxhash64("node", F.lit(7)), c).cast("int")
    # part (i, j): cut i of all is asked by cut j of those that ask
    held = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: F.struct((cut(F.col("cuts")) * F.col("few") + j).alias("part"), F.lit(False).alias("asks")))
    asking = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.struct((i * F.col("few") + cut(F.col("few"))).alias("part"), F.lit(True).alias("asks")))
    both = large.withColumn("p", F.explode(F.when(F.col("asks"), F.concat(held, asking)).otherwise(held)))
    # a row that is held and asks in one part is there once
    both = both.groupBy("shard", F.col("p.part").alias("part"), "node").agg(F.max("p.asks").alias("asks"), F.first("fp").alias("fp"), F.first("root").alias("root"))
    return small.unionByName(both.select(*small.columns))


def _leaders(rows: DataFrame, tree: int, leaders: int) -> DataFrame | None:
    """Of shards of more than tree documents parts of about tree, each with the shard's leaders, which ask; None without such."""
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]).filter(F.col("m") > tree)
    bits = [F.when(F.col(f"b{i}") * 2 > F.col("m"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    middle = bits[0]
    for b in bits[1:]:
        middle = middle.bitwiseOR(b)
    large = common.stage(sizes.select("shard", F.ceil(F.col("m") / tree).cast("int").alias("cuts"), middle.alias("middle")), "near-large")
    n = large.count()
    if not n:
        return None
    mine = rows.join(common.small_side(large, n, 32), "shard").withColumn("away", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))))
    # the nearest of each of some salts, then of all
    order = Window.partitionBy("shard", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(common.SALTS))).orderBy("away", "node")
    some = mine.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= leaders)
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy("away", "node"))).filter(F.col("r") <= leaders).select("shard", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), F.lit(True).alias("asks"), "node", "fp", "root")
    rest = mine.select("shard", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int").alias("part"), F.lit(False).alias("asks"), "node", "fp", "root")
    return rest.unionByName(first).groupBy("shard", "part", "node").agg(F.max("asks").alias("asks"), F.first("fp").alias("fp"), F.first("root").alias("root")).select("shard", "part", "asks", "node", "fp", "root")


class _Finder:
    """Compares the members of parts: trees choose who has another within the radius, sets of shingles confirm."""

    def __init__(self, docs: DataFrame, sets: DataFrame, words: int, similarity: float, radius: int):
        self.docs, self.sets, self.words, self.similarity, self.radius = docs, sets, words, similarity, radius

    def links(self, parts: DataFrame) -> DataFrame:
        """(u, v): a path through each class that a part finds. parts: shard, part, asks, node, fp, root."""
        radius, similarity = self.radius, self.similarity

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.let_go()
            for b in _slabs(batches):
                group = np.cumsum(np.r_[True, _edges(b)])
                fp = b.column("fp").to_numpy().view(np.uint64)
                # equal fingerprints of a part are one node of its tree; they are near each other anyway
                order = np.lexsort((fp, group))
                new = np.r_[True, (group[order][1:] != group[order][:-1]) | (fp[order][1:] != fp[order][:-1])]
                node = np.empty(len(fp), np.int64)
                node[order] = np.cumsum(new) - 1
                asks = np.bincount(node, b.column("asks").to_numpy(zero_copy_only=False)) > 0
                has = (np.bincount(node) > 1) & asks
                for x, y in Forest(fp[order][new], group[order][new]).near(radius):
                    one = asks[x] | asks[y]
                    has[x[one]] = has[y[one]] = True
                if has.any():
                    yield b.filter(pa.array(has[node])).select(["shard", "part", "asks", "node", "root"])

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.let_go()
            for b in _groups(batches):
                asks, root, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "root", "node"))
                found = similar([np.frombuffer(x.as_py(), np.uint64) for x in b.column("shingles")], similarity, root, None if asks.all() else asks)
                u, v = found.chain()
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

        dealt = parts.repartition("shard", "part").sortWithinPartitions("shard", "part")
        kept = common.stage(dealt.mapInArrow(near, "shard long, part int, asks boolean, node long, root long"), "near-kept")
        wanted = common.stage(kept.select("node").distinct().join(self.sets.select("node", "carrier").hint("merge"), "node").select("node", F.col("carrier.a").alias("a"), F.col("carrier.b").alias("b")), "near-wanted")
        # texts never move: those that a sieve of the wanted lets through become sets, and the wanted ones of these are joined
        ident = exact_dedup.identity(F.col("doc_id"), F.col("text"))
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(ident["a"].alias("a"), ident["b"].alias("b"), "text")
        some = common.sifted(rows, F.xxhash64("a", "b"), wanted, F.xxhash64("a", "b")).filter("maybe")
        found = _shingle_sets(some, self.words).join(wanted, ["a", "b"]).dropDuplicates(["node"]).select("node", "shingles")
        sets = common.stage(found, "near-sets")
        filled = kept.join(sets.hint("merge"), "node").select("shard", "part", "asks", "node", "root", "shingles")
        return filled.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(confirm, "u long, v long").distinct()


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of each node, a node without links being its own."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links; only what joins different roots is worked on."""
    links = common.stage(links, "near-links")
    if roots is None:
        return common.stage(components(links), "near-roots")
    ends = _rooted(links.select(F.col("u").alias("node"), "v"), roots).select(F.col("root").alias("u"), F.col("v").alias("node"))
    ends = common.stage(_rooted(ends, roots).filter("u <> root").select("u", F.col("root").alias("v")).distinct(), "near-root-links")
    if ends.isEmpty():
        return roots
    over = common.stage(components(ends), "near-root-roots")
    known = roots.unionByName(over.select("node", F.col("node").alias("root")).join(roots.select("node").hint("merge"), "node", "left_anti"))
    return common.stage(known.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "near-roots")


def _classes(docs: DataFrame, words: int, similarity: float, shards: int, radius: int, tree: int, set_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, root) of the sets of shingles that are linked to another."""
    for seed in itertools.count():
        rows = common.stage(sketches(docs, words, shards, seed), "near-sketches")
        keys = [F.min(F.col("keys")[i]).alias(f"k{i}") for i in range(shards)]
        sets = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min(F.struct("a", "b")).alias("carrier"), (F.min("check") != F.max("check")).alias("clash"), *keys)
        sets = common.stage(sets, "near-nodes")
        if sets.filter("clash").isEmpty():  # else two sets have one name: others are given
            break
    named = sets.select("node", "fp", "n", F.posexplode(F.array(*[f"k{i}" for i in range(shards)])).alias("i", "k")).select("i", F.xxhash64("i", "k").alias("shard"), "node", "fp", "n")
    several = named.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("shard")
    named = common.stage(named.join(several.hint("merge"), "shard"), "near-shards")
    finder = _Finder(docs, sets, words, similarity, radius)
    roots = None
    if (first := _leaders(_rooted(named, None), tree, LEADERS)) is not None:
        roots = _joined(roots, finder.links(first))
    for passed in (F.col("i") < FIRST, F.col("i") >= FIRST):
        roots = _joined(roots, finder.links(_parts(_rooted(named.filter(passed), roots), tree, set_bytes)))
    return rows, roots  # type: ignore[return-value]


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, a, b, root, best): the rows of classes of several rows, with the row of each that is to stay.

    A set of shingles, and a class of sets, may hold most of the rows: both are dealt over salts to learn the best row.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    dealt = rows.select("doc_id", "a", "b", "node", F.pmod(F.xxhash64("a", "b"), F.lit(common.SALTS)).cast("int").alias("salt"))
    part = dealt.groupBy("node", "salt").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("m"))
    part = common.stage(_rooted(part, roots), "near-class-parts").withColumn("slot", F.pmod(F.xxhash64("node", "salt"), F.lit(CLASS_SALTS)).cast("int"))
    whole = part.groupBy("root", "slot").agg(F.min("best").alias("best"), F.sum("m").alias("m")).groupBy("root").agg(F.min("best").alias("best"), F.sum("m").alias("m")).filter("m > 1")
    whole = whole.select("root", "best", F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))).alias("slot"))
    tied = part.select("node", "salt", "root", "slot").join(whole, ["root", "slot"]).select("node", "salt", "root", "best")
    return dealt.join(tied, ["node", "salt"]).select("doc_id", "a", "b", "root", "best")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, shards: int = SHARDS, radius: int = RADIUS, tree: int = TREE, set_bytes: int = SET_BYTES) -> DataFrame:
    """(doc_id, component_id) of rows that have a near copy: classes over links of at least the similarity.

    Rows with equal sets of shingles are one node. A node is in the shards that pairs of its least shingle hashes name. A
    BK-tree over each shard's fingerprints gives the nodes with another one within the radius; only their sets, of 64-bit
    hashes, are gathered, and sets of a shard are compared exactly. In a shard larger than tree all are first compared
    with its leaders; then members of one class need no comparison, so that a large class costs work in proportion to it,
    and cuts of the others are compared with cuts of all, which leaves no pair out. A second pass over the other shards
    skips those whose members are of one class by then.

    Null texts count as empty; empty texts are copies of each other. Rows are named by doc_id and text: rows of one
    doc_id with other texts are told apart, rows without a doc_id take part and name a class only where no other does.
    Repeated rows stay repeated. Very long texts are sketched whole where they are read; a comparison holds set_bytes of
    shingles beside a single set. Other columns are ignored. An empty table gives an empty result.
    """
    rows, roots = _classes(docs, words, similarity, shards, radius, tree, set_bytes)
    return _named(rows, roots).select("doc_id", F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, shards: int = SHARDS, radius: int = RADIUS, tree: int = TREE, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs with one row of each class of near copies, that of the least doc_id; all columns stay.

    Rows are named by doc_id and text together, as exact_dedup.keep_one() does. Of rows alike in both, one stays.
    """
    rows, roots = _classes(docs, words, similarity, shards, radius, tree, set_bytes)
    found = _named(rows, roots).withColumn("kept", (F.col("best.a") == F.col("a")) & (F.col("best.b") == F.col("b")))
    return exact_dedup.without_copies(docs, common.stage(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")), "near-idents"))
