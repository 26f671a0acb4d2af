"""Retrieval legs, seed merge, spreading activation, fusion, admission, clustering and packing."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors, weights
from palimpsest.operators import quantiles, staging
from palimpsest.operators.activation import MOST_BROADCAST, TYPED, Budget, edge_weight, prepared, spread  # noqa: F401  (part of this module)
from palimpsest.operators.components import components

#: Bytes of asked vectors in one pass, about: bounds what is broadcast.
ASK_BYTES = 32 << 20


def asked_pairs(asks: DataFrame, corpus: DataFrame, skip_self: bool = True) -> list[DataFrame]:
    """Cosines of a stated set of vectors with the whole corpus, in blocks: ask, id, score and the corpus's other columns.

    Asked vectors are broadcast, at most about ASK_BYTES of them at a time, so a task holds a bounded block whatever
    their number; the corpus is never shuffled. asks and corpus: id, vec.
    """
    size = asks.agg(F.sum(16 + 8 * F.coalesce(F.size("vec"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // ASK_BYTES))
    rest = [c for c in corpus.columns if c not in ("id", "vec")]
    corpus = corpus.withColumn("nv", vectors.norm(F.col("vec")))
    asked = asks.select(F.col("id").alias("ask"), F.col("vec").alias("ask_vec"), vectors.norm(F.col("vec")).alias("na"))
    cos = vectors.cosine(F.col("ask_vec"), F.col("vec"), F.col("na"), F.col("nv"))
    out = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == b) if blocks > 1 else asked
        near = corpus.join(F.broadcast(part), F.col("id") != F.col("ask") if skip_self else F.lit(True))
        out.append(near.select("ask", "id", cos.alias("score"), *rest))
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of unit length; null ones, ones of another size and zero ones are zero rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), size))
    flat = column.filter(pa.array(fits)).flatten()
    out[fits] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def knn(asks: DataFrame, corpus: DataFrame, k: int, floor: float = -1.0, skip_self: bool = True) -> DataFrame:
    """The k nearest corpus vectors of each asked vector by cosine at or above floor: ask, id, score, rank (JOIN-8, SORT-2).

    Asked vectors go to the tasks as matrices of ASK_BYTES at most, those of one size together, one pass over the corpus for
    each. A task
    multiplies a stretch of its rows with them and sends on only what reaches the k-th best so far, so the shuffle holds
    little more than k rows of each task and ask, and the corpus itself is never shuffled. Ties go to the smaller id; the
    cosine of null vectors and those of another size is 0. asks and corpus: id (long), vec.
    """
    spark = asks.sparkSession
    length = F.coalesce(F.size("vec"), F.lit(0))
    kinds = asks.groupBy(length.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    w, out = Window.partitionBy("ask").orderBy(F.desc("score"), "id"), []
    passes = [(r["size"], max(1, -(-r["n"] * max(1, r["size"]) * 8 // ASK_BYTES)), b) for r in kinds for b in range(max(1, -(-r["n"] * max(1, r["size"]) * 8 // ASK_BYTES)))]
    for size, blocks, b in passes or [(0, 1, 0)]:
        held = asks.filter((length == size) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select("id", "vec").toArrow()
        size = max(1, size)
        sent = spark.sparkContext.broadcast((held.column("id").to_numpy(), _matrix(held.column("vec"), size), size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, asked, size = sent.value
            least = np.full(len(names), floor)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids, rows = part.column("id").to_numpy(), _matrix(part.column("vec"), size)
                    for i in range(0, len(names), 1024):
                        cos = np.clip(rows @ asked[i : i + 1024].T, -1, 1)
                        if skip_self:
                            cos[ids[:, None] == names[None, i : i + 1024]] = -2
                        if len(ids) > k:
                            least[i : i + 1024] = np.maximum(least[i : i + 1024], np.partition(cos, len(ids) - k, axis=0)[len(ids) - k])
                        # what is equal to the k-th best but for rounding stays for the smaller id to win
                        r, c = np.nonzero((cos >= least[None, i : i + 1024] - 1e-12) & (cos >= floor))
                        if len(r):
                            yield pa.RecordBatch.from_arrays([pa.array(names[i + c]), pa.array(ids[r]), pa.array(cos[r, c])], names=["ask", "id", "score"])

        found = corpus.select(F.col("id").cast("long").alias("id"), "vec").filter("id is not null").mapInArrow(run, "ask long, id long, score double")
        out.append(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
    return functools.reduce(DataFrame.unionByName, out)


#: Bins of cosines.
COSINE_BINS = 1 << 16


def cosine_quantiles(asks: DataFrame, corpus: DataFrame, shares: list[float]) -> DataFrame:
    """(same, n, q0, q1, ...): quantiles of the cosines of asked vectors with all others, by whether their labels are equal
    (MATH-2). asks and corpus: id, vec, label; a null label gives a null same.

    Cosines are never rows: as in knn() asked vectors go to the tasks as matrices, and a task counts what they give with its
    rows by bin. A second pass sends on the different values of the few bins that hold the wanted places, with their counts.
    """
    spark = asks.sparkSession
    length = F.coalesce(F.size("vec"), F.lit(0))
    sent = []
    for r in asks.groupBy(length.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect():
        blocks = max(1, -(-r["n"] * max(1, r["size"]) * 8 // ASK_BYTES))
        for b in range(blocks):
            held = asks.filter((length == r["size"]) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select("id", "vec", "label").toArrow().combine_chunks()
            sent.append(spark.sparkContext.broadcast((held.select(["id", "label"]), _matrix(held.column("vec"), max(1, r["size"])), max(1, r["size"]))))
    rows = corpus.select(F.col("id").cast("long").alias("id"), "vec", "label").filter("id is not null")
    union = lambda schema, wanted: functools.reduce(DataFrame.unionByName, [rows.mapInArrow(_cosines(s, wanted), schema) for s in sent] or [rows.select(F.lit(True).alias("k"), F.lit(0).alias("bin"), F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("m")).filter("false")])
    counts = staging.stage(union("k boolean, bin int, x double, m long", None).groupBy("k", "bin").agg(F.sum("m").alias("m")), "cosine-counts")
    wanted = staging.stage(quantiles.places(counts, shares), "cosine-places")
    bins = {(r["k"], r["bin"]) for r in wanted.select("k", "bin").distinct().collect()}  # two a quantile and group
    return quantiles.between(union("k boolean, bin int, x double, m long", bins), wanted, "same", shares)


def _cosines(sent, wanted: set | None):
    """For mapInArrow: counts of cosines by group and bin, or, with wanted bins, the values in these and how often each occurs."""
    kinds = [False, True, None]
    keys = np.array(sorted(kinds.index(k) * COSINE_BINS + b for k, b in wanted)) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrix, size = sent.value
        names, label = asked.column("id").to_numpy(), asked.column("label")
        different = pc.unique(label.filter(pc.is_valid(label)))
        mine = pc.fill_null(pc.index_in(label, value_set=different), -2).to_numpy()
        total = np.zeros(3 * COSINE_BINS, np.int64)

        def rows(key, x, m) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kinds[k] for k in (key // COSINE_BINS).tolist()], pa.bool_()), pa.array((key % COSINE_BINS).astype(np.int32)), pa.array(x, pa.float64()), pa.array(m)], names=["k", "bin", "x", "m"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, vecs, own = part.column("id").to_numpy(), _matrix(part.column("vec"), size), part.column("label")
                theirs = np.where(pc.is_valid(own).to_numpy(zero_copy_only=False), pc.fill_null(pc.index_in(own, value_set=different), -1).to_numpy(zero_copy_only=False), -2)
                for i in range(0, len(names), 1024):
                    cos = np.clip(vecs @ matrix[i : i + 1024].T, -1, 1)
                    a, b = theirs[:, None], mine[None, i : i + 1024]
                    group = np.where((a == -2) | (b == -2), 2, a == b)
                    other = ids[:, None] != names[None, i : i + 1024]
                    cos = cos[other]
                    key = group[other] * COSINE_BINS + np.minimum(COSINE_BINS - 1, ((cos + 1) * (COSINE_BINS / 2)).astype(np.int64))
                    if keys is None:
                        total += np.bincount(key, minlength=len(total))
                        continue
                    near = np.isin(key, keys, kind="table")
                    pairs, m = np.unique(np.stack([key[near].astype(float), cos[near]]), axis=1, return_counts=True)
                    yield rows(pairs[0].astype(np.int64), pairs[1], m)
        if keys is None:
            key = np.flatnonzero(total)
            yield rows(key, np.zeros(len(key)), total[key])

    return run


#: Asked terms that go to the tasks as one set; more are asked for in several passes.
TERMS = 1 << 18


def term_hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term, tf, dl) of the asked terms in each document, and rows without a doc_id that sum up lengths: tf holds
    the documents with words of a batch, dl their words. docs: doc_id, text.

    Words are runs of a-z and 0-9 of the lower-case text, split where the text is read; only words that are asked for
    leave a task, counted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, split = sent.value, re.compile("[a-z0-9]+").findall
        for batch in batches:
            ids, found, tf, dl, held, size = [], [], [], [], 0, 0
            for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = split(text) if text else ()
                if not words:
                    continue
                held, size = held + 1, size + len(words)
                for term, n in Counter(filter(asked.__contains__, words)).items():
                    ids.append(id_), found.append(term), tf.append(n), dl.append(len(words))
            ids.append(None), found.append(None), tf.append(held), dl.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], names=["doc_id", "term", "tf", "dl"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, term string, tf long, dl long")


#: Asks, pairs of an ask and a term, and scores of asks and documents that a task holds at once.
ASKS, POSTINGS, SCORES = 1 << 12, 1 << 22, 1 << 22


def bm25(docs: DataFrame, asked: DataFrame, k1: float = 1.2, b: float = 0.75, best: int | None = None) -> DataFrame:
    """BM25 of documents for asked terms: ask, doc_id, score (RET-4). docs: doc_id, text; asked: ask, term (a stated set).

    One pass over the texts for each TERMS of the asked terms; nothing but counted hits is shuffled. Documents without
    words count neither for the mean length nor for their number. With best only so many documents of each ask are given,
    ties to the smaller id: hits are dealt by document, blocks of asks go to the tasks with their terms, and a task sends on
    only what reaches the best scores so far, so pairs of asks and documents are never rows.
    """
    asked = staging.stage(asked.distinct(), "asked-terms")
    terms = staging.stage(asked.select("term").filter("term is not null").distinct(), "terms")
    blocks = max(1, -(-terms.count() // TERMS))
    found = None
    for i in range(blocks):
        some = terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i) if blocks > 1 else terms
        hits = staging.stage(term_hits(docs, [r[0] for r in some.collect()]), "hits")
        found = hits if found is None else found.unionByName(hits.filter("doc_id is not null"))
    sizes = found.filter("doc_id is null").agg(F.sum("tf").alias("docs"), F.sum("dl").alias("words")).first()
    n, mean = sizes["docs"] or 0, (sizes["words"] or 0) / (sizes["docs"] or 1) or 1.0
    hits = found.filter("doc_id is not null")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = asked.count()
    weighed = asked.join(df, "term")
    if best is not None:
        return _bm25_best(staging.stage(hits, "counted-hits") if blocks > 1 else hits, staging.stage(weighed, "weighed-terms"), n, mean, k1, b, best)
    scored = hits.join(F.broadcast(weighed) if rows <= MOST_BROADCAST else weighed, "term")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    return scored.groupBy("ask", "doc_id").agg(F.sum(part).alias("score"))


def _bm25_best(hits: DataFrame, weighed: DataFrame, n: int, mean: float, k1: float, b: float, best: int) -> DataFrame:
    """bm25() of each ask's best documents. hits: doc_id, term, tf, dl; weighed: ask, term, df."""
    spark, out = hits.sparkSession, None
    weighed = weighed.filter("ask is not null").select(F.col("ask").cast("long").alias("ask"), "term", "df")
    size = weighed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ask").alias("asks")).first()
    blocks = max(1, -(-size["rows"] // POSTINGS), -(-size["asks"] // ASKS))
    dealt = hits.repartition("doc_id").sortWithinPartitions("doc_id", "term")
    for i in range(blocks):
        sent = spark.sparkContext.broadcast(weighed.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == i).toArrow().combine_chunks())
        part = dealt.mapInArrow(_scoring(sent, n, mean, k1, b, best), "ask long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= best).drop("r")


def _scoring(sent, n: int, mean: float, k1: float, b: float, best: int):
    """For mapInArrow over hits in the order of documents: (ask, doc_id, score) of what is among the best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        if not asked.num_rows:
            return
        asks, ask = np.unique(asked.column("ask").to_numpy(), return_inverse=True)
        terms = pc.unique(asked.column("term"))
        of = pc.index_in(asked.column("term"), value_set=terms).to_numpy()
        order = np.argsort(of, kind="stable")
        ask, size = ask[order], np.bincount(of, minlength=len(terms))
        start, df = np.cumsum(size) - size, np.zeros(len(terms))
        df[of] = asked.column("df").to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        least = np.zeros(len(asks))
        some = max(1, SCORES // len(asks))

        def scored(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, doc = np.unique(t.column("doc_id").to_numpy(), return_inverse=True)
            term, tf, dl = pc.index_in(t.column("term"), value_set=terms), t.column("tf").to_numpy(), t.column("dl").to_numpy()
            known = pc.is_valid(term).to_numpy()
            term = pc.fill_null(term, 0).to_numpy()
            part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
            for first in range(0, len(ids), some):
                a, z = np.searchsorted(doc, (first, first + some))
                held = min(some, len(ids) - first)
                score = np.zeros(held * len(asks))
                rows = a + np.flatnonzero(known[a:z])
                upto = np.cumsum(size[term[rows]])
                for cut in np.split(rows, np.searchsorted(upto, np.arange(POSTINGS, upto[-1], POSTINGS))) if len(rows) else ():
                    many = size[term[cut]]
                    at = np.repeat(start[term[cut]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    np.add.at(score, np.repeat(doc[cut] - first, many) * len(asks) + ask[at], np.repeat(part[cut], many))  # in order: equal documents have equal sums
                score = score.reshape(held, len(asks))
                if held > best:
                    np.maximum(least, np.partition(score, held - best, axis=0)[held - best], out=least)
                # what is equal to the k-th best but for rounding stays for the smaller id to win
                r, c = np.nonzero((score > 0) & (score >= least[None, :] * (1 - 1e-12)))
                yield pa.RecordBatch.from_arrays([pa.array(asks[c]), pa.array(ids[first + r]), pa.array(score[r, c])], names=["ask", "doc_id", "score"])

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            doc = batch.column("doc_id").to_numpy()
            if sum(t.num_rows for t in held) < 1 << 17 or doc[0] == doc[-1]:
                continue
            t = pa.concat_tables(held).combine_chunks()
            last = int(np.searchsorted(t.column("doc_id").to_numpy(), doc[-1]))  # it may go on in the next batch
            yield from scored(t.slice(0, last))
            held = [t.slice(last)]
        if held:
            yield from scored(pa.concat_tables(held).combine_chunks())

    return run


def normalise_to_best(scores: DataFrame, by: list[str]) -> DataFrame:
    """score over the best of its group (MATH-9)."""
    best = scores.groupBy(*by).agg(F.max("score").alias("best"))
    return scores.join(best, by).withColumn("score", F.col("score") / F.col("best")).drop("best")


def merge_seeds(legs: DataFrame) -> DataFrame:
    """One row a node: best score, most relevance, its legs (RET-7). legs: id, leg, score, relevance."""
    return legs.groupBy("id").agg(F.max("score").alias("score"), F.max("relevance").alias("relevance"), F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("legs"), F.count(F.lit(1)).alias("provenance"))


def reserve(seeds: pd.DataFrame, budget: int, shares: dict[str, float]) -> pd.DataFrame:
    """Each leg takes its share of the budget from ids not yet chosen, then rank fills up (RET-8): one small list."""
    chosen: list = []
    for leg, share in shares.items():
        own = [i for i in seeds[seeds.leg == leg].sort_values(["score", "id"], ascending=[False, True]).id if i not in chosen]
        chosen += list(dict.fromkeys(own))[: int(budget * share)]
    for i in seeds.sort_values(["score", "id"], ascending=[False, True]).id:
        if len(chosen) >= budget:
            break
        if i not in chosen:
            chosen.append(i)
    return pd.DataFrame({"id": chosen, "place": range(1, len(chosen) + 1)})


def adjacency(edges: DataFrame, frontier: DataFrame, top: int = 64, least: float = 0.1) -> DataFrame:
    """Edges of frontier nodes with their strongest top neighbours and the neighbours' degrees (RET-9, JOIN-1).

    edges: node, other, type, strength, confidence, both ways; frontier: node.
    """
    degree = edges.groupBy(F.col("node").alias("other")).agg(F.count(F.lit(1)).alias("degree"))
    w = Window.partitionBy("node").orderBy(F.desc("strength"), "other", "type")
    near = edges.filter(F.col("strength") >= least).join(frontier.select("node"), "node", "left_semi")
    degree = degree.join(near.select("other").distinct(), "other", "left_semi")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).join(degree, "other")


def activate(seeds: DataFrame, edges: DataFrame, superseded: DataFrame | None = None, budget: Budget = Budget(), typed: tuple[str, ...] = TYPED) -> tuple[DataFrame, str]:
    """activation.spread() of one ask: (node, score, hops, path, typed_edge, typed_gain, superseded), and why it ended.

    seeds: node, score. edges: node, other, type, strength, confidence, both ways. superseded: node.
    """
    found, ended = spread(seeds.withColumn("ask", F.lit(0).cast("long")), prepared(staging.stage(edges, "edges"), superseded, budget), budget, typed)
    first = ended.first()
    old = (superseded if superseded is not None else found.filter("false")).select("node").distinct().withColumn("superseded", F.lit(True))
    return found.drop("ask").join(old, "node", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False))), first["ended"] if first else "frontier_exhausted"


def fuse(lists: DataFrame, k: int = weights.RRF_K, factors: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: id, score (RET-14). lists: id, weight, rank from 0.

    factors: id, factor; boosts above 1, SUPERSEDED_FACTOR for what a later claim has replaced. They multiply.
    """
    if factors is not None:
        whole = factors.groupBy("id").agg(F.product("factor").alias("factor"))
        return fuse(lists, k).join(whole, "id", "left").select("id", (F.col("score") * F.coalesce("factor", F.lit(1.0))).alias("score"))
    return lists.groupBy("id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def admit(evidence: DataFrame, vector_floor: float = 0.35, corroboration: float = 0.33, typed: float = 0.14, by: tuple[str, ...] | list[str] = ("id",)) -> DataFrame:
    """The first rule that lets an item in: vector_floor, exact_match, corroborated, bm25_any, typed_admission or none (RET-15).

    evidence: by, method, cue, relevance, exact, contribution.
    """
    strong = F.when(F.col("relevance") >= corroboration, F.struct("method", "cue"))
    m = evidence.groupBy(*by).agg(
        F.max(F.when(F.col("method") == "vector", F.col("relevance"))).alias("cos"),
        F.max(F.col("exact").cast("int")).alias("exact"),
        F.count_distinct(strong).alias("kinds"),
        F.max((F.col("method") == "bm25").cast("int")).alias("bm25"),
        F.max("contribution").alias("contribution"),
    )
    rule = (
        F.when(F.col("cos") >= vector_floor, "vector_floor")
        .when(F.col("exact") == 1, "exact_match")
        .when(F.col("kinds") >= 2, "corroborated")
        .when(F.col("bm25") == 1, "bm25_any")
        .when((F.col("contribution") >= typed) & (F.col("cos") >= corroboration), "typed_admission")
        .otherwise("none")
    )
    return m.select(*by, rule.alias("rule"))


def admission_report(rules: DataFrame, measured: DataFrame, names: DataFrame, cap: int = 2, prefix: int = 16) -> DataFrame:
    """One row of counts (RET-16): admitted, below_floor and unmeasured among those left out, duplicate and near_duplicate
    among the admitted (equal names; more than cap of one prefix).

    rules: id, rule; measured: id, cos (null: never measured); names: id, name.
    """
    let_in = rules.filter("rule <> 'none'").join(names, "id").withColumn("same", F.row_number().over(Window.partitionBy("name").orderBy("id")))
    first = let_in.filter("same = 1").withColumn("near", F.row_number().over(Window.partitionBy(F.substring(F.lower(F.trim("name")), 1, prefix)).orderBy("id")))
    inside = first.agg(F.count_if(F.col("near") <= cap).alias("admitted"), F.count_if(F.col("near") > cap).alias("near_duplicate"))
    twice = let_in.agg(F.count_if(F.col("same") > 1).alias("duplicate"))
    out = rules.filter("rule = 'none'").join(measured, "id").agg(F.count_if(F.col("cos").isNotNull()).alias("below_floor"), F.count_if(F.col("cos").isNull()).alias("unmeasured"))
    return inside.crossJoin(twice).crossJoin(out)  # three single rows


def cluster_cap(items: DataFrame, links: DataFrame, cap: int = 2) -> DataFrame:
    """The best cap items of each near-duplicate class (RET-17). items: id, score; links: u, v."""
    root = components(links).withColumnRenamed("node", "id")
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "id")
    return items.join(root, "id", "left").withColumn("cluster", F.coalesce("root", "id")).drop("root").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def cap_by_key(items: DataFrame, key: str, cap: int) -> DataFrame:
    """The best cap items of each key; tasks drop the rest of a hot key before the shuffle. items: id, score, key."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def mmr(items: pd.DataFrame, vecs: np.ndarray, trade: float = 0.5) -> list[int]:
    """Places of items in the order of maximal marginal relevance (RET-18): one pack's short list."""
    v = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    cos, rel = v @ v.T, items.score.to_numpy() / items.score.max()
    left, out = list(range(len(items))), []
    while left:
        worth = [trade * rel[i] - (1 - trade) * (cos[i, out].max() if out else 0.0) for i in left]
        out.append(left.pop(int(np.argmax(worth))))
    return out


def mmr_groups(items: DataFrame, trade: float = 0.5) -> DataFrame:
    """mmr within each pack: pack, id, place. items: pack, id, score, vec; a pack is a ranked list of bounded length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        order = mmr(pdf, np.stack(pdf.vec.to_numpy()).astype(float), trade)
        return pd.DataFrame({"pack": pdf.pack, "id": pdf.id.to_numpy()[order], "place": np.arange(1, len(order) + 1)})

    return items.groupBy("pack").applyInPandas(run, "pack long, id long, place int")


def pack(items: DataFrame, budget: int, caps: dict[str, int]) -> DataFrame:
    """Greedy packing within a token budget: pack, id, place (SORT-5). items: pack, id, score, bucket, episode, tokens.

    Items are walked best first; one that exceeds the budget, its bucket's cap or repeats an episode is passed over.
    A pack's rows pass through one task in order, but only its budget, counts and episodes taken are held.
    """
    order = ["pack", "id", "bucket", "episode", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, used, seen, place = None, 0, {}, set(), 0
        for b in batches:
            out = []
            for pack_, id_, bucket, episode, tokens in zip(*[b.column(c).to_pylist() for c in order], strict=True):
                if pack_ != now:
                    now, left, used, seen, place = pack_, budget, dict.fromkeys(caps, 0), set(), 0
                if tokens <= left and used.get(bucket, 0) < caps.get(bucket, 0) and episode not in seen:
                    left, place = left - tokens, place + 1
                    used[bucket] += 1
                    seen.add(episode)
                    out.append((pack_, id_, place))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["pack", "id", "place"])

    ranked = items.repartition("pack").sortWithinPartitions("pack", F.desc("score"), "id").select(*order)
    return ranked.mapInArrow(run, "pack long, id long, place int")


def mean_vector(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Weighted mean vector of each key (AGG-13): key, vec. rows: key, vec, weight; bad weights and sizes are left out.

    One aggregation with a sum for each place, combined before the shuffle: no vector is exploded or collected.
    """
    ok = rows.filter((F.col("weight") > 0) & (F.size("vec") == size))
    sums = ok.groupBy(key).agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.col("vec")[i].cast("double")).alias(f"v{i}") for i in range(size)])
    return sums.select(key, F.array(*[F.col(f"v{i}") / F.col("w") for i in range(size)]).alias("vec"))


def resonance(first: DataFrame, vectors_: DataFrame, size: int, k: int, floor: float = 0.5) -> DataFrame:
    """(ask, id, score): the nearest vectors to what each ask's first pass means as a whole, without that pass (RET-21).

    first: ask, id, weight (the activation); vectors_: id, vec. What a pass holds is bounded by its budget, so as many more
    neighbours are looked for and left out again.
    """
    first = staging.stage(first, "resonance-first")
    most = first.groupBy("ask").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    middle = mean_vector(first.join(vectors_, "id").select("ask", "vec", "weight"), "ask", size)
    near = knn(middle.select(F.col("ask").alias("id"), "vec"), vectors_, k + most, floor, skip_self=False).join(first.select("ask", "id"), ["ask", "id"], "left_anti")
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("ask", "id", "score")
