"""Operator 4: toxicity by class-conditional Kneser-Ney models over the letters of expressions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

#: Longest n-gram, discount, and the longest order whose counts both classes share.
ORDER, DISCOUNT, SHARED = 5, 0.75, 2
#: Labelled rows of each class that are read at most, about: a sample by hash of doc_id.
MAX_PER_CLASS = 20_000
#: Share of the labelled sample whose counts are learnt; the rest sets the weights of the features.
LEARN_OF_TEN = 7
#: Symbols: 0 ends an expression, 1-26 are a-z, other letters are hashed over 1-30, digits are 31.
SYMBOLS = 32
#: Code points of a text that are coded at a time, about.
STRETCH = 1 << 18
FEATURES = 3

_TABLE: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(1 << 16, np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            if c.isdigit():
                t[i] = 31
            elif c.isalpha():
                t[i] = i - 96 if 97 <= i <= 122 else 1 + i * 2654435761 % (1 << 32) % 30
        _TABLE = t
    return _TABLE


@dataclass
class Coded:
    """Texts as one row of symbols; every expression (run of letters and digits) ends with 0."""

    grams: np.ndarray  # of each symbol with the four before it within its expression
    ends: np.ndarray  # place after each expression
    owner: np.ndarray  # text number of each expression


def code(texts: list[str]) -> Coded:
    if not texts:
        return Coded(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
    texts = [t.lower() for t in texts]
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = symbol_table()[np.minimum(points, (1 << 16) - 1)]
    far = np.flatnonzero(points >= 1 << 16)
    if len(far):
        sym[far] = [1 + p % 30 if chr(p).isalpha() else 0 for p in points[far].tolist()]
    keep = sym.astype(bool)
    keep[1:] |= keep[:-1]  # of each run of others only the first
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner_of = np.repeat(np.arange(len(texts)), sizes)
    sym, owner_of = sym[keep], owner_of[keep]
    n = len(sym)
    ends = np.flatnonzero(sym == 0) + 1
    place = np.arange(n) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])) if len(ends) else np.arange(n)
    grams = sym.astype(np.int32)
    for back in range(1, ORDER):
        before = np.zeros(n, np.int32)
        before[back:] = sym[:-back] if back < n else 0
        before[place < back] = 0
        grams += before << (5 * back)
    return Coded(grams, ends, owner_of[ends - 1] if len(ends) else np.empty(0, np.int64))


def _estimates(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted counts of the last symbol after each context (rows), the mass taken away going to lower."""
    total = counts.sum(1, keepdims=True)
    kinds = (counts > 0).sum(1, keepdims=True)
    return np.where(total > 0, (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)


def likelihoods(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Kneser-Ney estimates of both classes: the longest contexts that occur, for each class the probabilities of every
    symbol after them, and for each class a table of them after every shorter context.

    The longest order counts occurrences, the others count the different symbols that stand before an n-gram. Orders up
    to SHARED use the continuation counts of both classes together, so that an expression rare in both is equally
    likely in both. Contexts never seen take the table of the next shorter one.
    """
    levels = []
    for c in (toxic, ordinary):
        g, k, own = grams[c > 0], c[c > 0].astype(np.float64), {}
        for n in range(ORDER, 0, -1):
            own[n] = (g, k)
            g, k = np.unique(g & ((1 << 5 * (n - 1)) - 1), return_counts=True)
        levels.append(own)
    for n in range(1, SHARED + 1):
        u, at = np.unique(np.concatenate([x[n][0] for x in levels]), return_inverse=True)
        levels[0][n] = levels[1][n] = (u, np.bincount(at, np.concatenate([x[n][1] for x in levels]), len(u)))
    prob = [np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)] * 2
    for n in range(1, ORDER + 1):
        contexts = np.unique(np.concatenate([x[n][0] >> 5 for x in levels]))
        rows = []
        for (g, k), low in zip((x[n] for x in levels), prob, strict=True):
            counts = np.zeros((len(contexts), SYMBOLS), np.float32)
            counts[np.searchsorted(contexts, g >> 5), g & 31] = k
            rows.append(_estimates(counts, low[contexts & (len(low) - 1)]))
        if n == ORDER:
            break
        prob = [np.tile(low, (SYMBOLS if n > 1 else 1, 1)) for low in prob]
        for p, r in zip(prob, rows, strict=True):
            p[contexts] = r
    return contexts, rows, prob


def ratios(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log(p toxic / p ordinary) of the last symbol of every n-gram."""
    contexts, rows, prob = likelihoods(grams, toxic, ordinary)
    table = np.tile(np.log(prob[0] / prob[1]).astype(np.float16), (SYMBOLS, 1))
    table[contexts] = np.log(rows[0] / rows[1])
    return table.reshape(-1)


@dataclass
class Model:
    name: str
    grams: np.ndarray
    toxic: np.ndarray
    ordinary: np.ndarray
    weights: np.ndarray  # of the features, the last one alone
    prior: float = 0.5  # share of toxic labels: the score of a text without expressions

    def table(self) -> np.ndarray:
        """The process's table of log ratios: built once by each worker, from the counts."""
        return common.held(("toxicity", self.name), lambda: ratios(self.grams, self.toxic, self.ordinary))


def _inside(c: str) -> bool:
    return c.isalnum()


def long_expressions(table: np.ndarray, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log ratio, symbols) of the expressions of a long text, a stretch at a time; one that a cut parts is summed up."""
    held, size = 0.0, 0
    for piece, before, goes_on in common.stretches(text.lower(), STRETCH, ORDER - 1, _inside):
        c = code([piece])
        if not len(c.ends):
            continue
        each = table[c.grams].astype(np.float64)
        begins = np.r_[0, c.ends[:-1]]
        sums, sizes = np.add.reduceat(each, begins), c.ends - begins
        if before:  # context, and a beginning that is none
            sums[0] += held - each[:before].sum()
            sizes[0] += size - before
        if goes_on:  # an end that is none
            held, size = float(sums[-1] - each[-1]), int(sizes[-1] - 1)
            sums, sizes = sums[:-1], sizes[:-1]
        real = sizes > 1
        yield sums[real], sizes[real]


def long_grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, a stretch at a time."""
    for piece, before, goes_on in common.stretches(text.lower(), STRETCH, ORDER - 1, _inside):
        g = code([piece]).grams
        yield g[before : len(g) - goes_on]


def comparisons(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its log ratio and its symbols; of its most and second most toxic expression, the log ratio over the
    expression's length (the first for the second where there is one only); and its count of expressions."""
    n = len(texts)
    total, top, count = np.zeros((n, 2)), np.full((n, 2), -np.inf), np.zeros(n, np.int64)
    short = np.array([i for i, t in enumerate(texts) if len(t) <= STRETCH], np.int64)
    c = code([texts[i] for i in short])
    work = []
    if len(c.ends):
        begins = np.r_[0, c.ends[:-1]]
        sums, sizes = np.add.reduceat(table[c.grams].astype(np.float64), begins), c.ends - begins
        real = sizes > 1
        work.append((short, sums[real], sizes[real], c.owner[real]))
    # a longer text a stretch at a time: sums add up, and of two stretches' best two the best two stay
    longer = ((np.array([i]), sums, sizes, np.zeros(len(sums), np.int64)) for i, t in enumerate(texts) if len(t) > STRETCH for sums, sizes in long_expressions(table, t))
    for at, sums, sizes, owner in itertools.chain(work, longer):
        if not len(sums):
            continue
        m = len(at)
        k = np.bincount(owner, minlength=m)
        total[at] += np.stack([np.bincount(owner, sums, m), np.bincount(owner, sizes, m)], 1)
        ratio = sums / sizes
        order = np.lexsort((-ratio, owner))
        first = np.r_[0, np.cumsum(k)[:-1]]
        best = np.full((m, 2), -np.inf)
        for j in range(2):
            best[k > j, j] = ratio[order[first[k > j] + j]]
        top[at] = np.sort(np.concatenate([top[at], best], 1), axis=1)[:, :1:-1]
        count[at] += k
    return np.concatenate([total, top], 1), count


def features(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text three length-normalised comparisons of the two likelihoods (the whole text's, and those of its two
    most toxic expressions), and whether it has expressions at all; zeros where not."""
    found, count = comparisons(table, texts)
    have = count > 0
    out = np.zeros((len(texts), FEATURES))
    out[have, 0] = found[have, 0] / found[have, 1]
    out[have, 1] = found[have, 2]
    out[have, 2] = np.where(count[have] > 1, found[have, 3], found[have, 2])
    return out, have


def _logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the features and the intercept; a row counts as so many rows, relative to the others."""
    x = np.c_[x, np.ones(len(x))]
    counts = counts / counts.mean()
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (counts * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (counts * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, label: str = "toxic") -> Model:
    """Learns both models from labelled documents; labels: doc_id and a column of 0 and 1 named by label.

    About max_per_class documents of each class are read, chosen by hash of doc_id with a share that the counts of
    the classes give; this bounds the model, whatever the corpus. Seven tenths of them give n-gram counts, the rest
    the weights by which the three comparisons of likelihoods become a probability (logistic regression), where each row counts for the rows of its class that it was
    drawn from, so that scores keep the labels' own balance of classes whatever the share. The n-gram table goes to the driver: it has 2^25 kinds at
    most. A document with several labels is toxic if one of them says so. Null labels and null texts are left out; without labels of both classes every score is 0.5.
    """
    named = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = np.empty(0, np.int64)
    if not n.get(0) or not n.get(1):
        return Model("none", empty, empty, empty, np.zeros(FEATURES + 1))
    share = F.when(F.col("label") == 1, F.lit(max_per_class / n[1])).otherwise(F.lit(max_per_class / n[0]))
    named = named.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < share * 1_000_000)
    size = min(n[0], max_per_class) + min(n[1], max_per_class)
    sample = docs.select("doc_id", "text").filter("text is not null").join(common.small_side(named, size * 2, 16), "doc_id")
    sample = common.stage(sample.withColumn("learn", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(10)) < LEARN_OF_TEN), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole, 2048):
                texts, mark = common.strings(b), np.array(b.column("label").to_pylist())
                for v in (0, 1):
                    some = [t for t, m in zip(texts, mark, strict=True) if m == v]
                    short = [t for t in some if len(t) <= STRETCH]
                    grams = itertools.chain((code(short[i : i + 512]).grams for i in range(0, len(short), 512)), (g for t in some if len(t) > STRETCH for g in long_grams(t)))
                    found = [np.unique(g, return_counts=True) for g in grams]
                    g, at = np.unique(np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int32), return_inverse=True)
                    k = np.bincount(at, np.concatenate([y for _, y in found]), len(g)).astype(np.int64) if found else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(k * v), pa.array(k * (1 - v))], names=["gram", "toxic", "ordinary"])

    counted = sample.filter("learn").select("label", "text").mapInArrow(count, "gram int, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    found = counted.toArrow()
    order = np.argsort(found.column("gram").to_numpy())
    model = Model(common.new_name(), *(found.column(c).to_numpy()[order] for c in ("gram", "toxic", "ordinary")), np.zeros(FEATURES + 1), n[1] / (n[0] + n[1]))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [(f"f{i}", T.DoubleType()) for i in range(FEATURES)]
    seen = common.add_columns(sample.filter("not learn").select("label", "text"), kinds, lambda: lambda b: list(features(sent.value.table(), common.strings(b))[0].T)).drop("text").toArrow()
    y = seen.column("label").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        stands_for = np.where(y == 1, max(1, n[1] / max_per_class), max(1, n[0] / max_per_class))
        model.weights = _logistic(np.stack([seen.column(f).to_numpy() for f, _ in kinds], 1), y, stands_for)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score is 0.5 or more); no shuffle.

    Null texts and texts without a letter or digit get the share of toxic labels. Other columns, null keys and repeated
    rows pass through; input columns named score or predicted are replaced.
    """
    return _scored(docs, model, "score", "predicted")


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay as they are, whatever their names."""
    given = [F.col(f"`{c}`") for c in docs.columns]
    return _scored(docs, model, "palimpsest_score", "palimpsest_predicted").filter("palimpsest_predicted = 0").select(*given)


def _scored(docs: DataFrame, model: Model, score: str, predicted: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: Model = sent.value
        table = m.table() if len(m.grams) else np.zeros(SYMBOLS**ORDER, np.float16)

        def each(batch):
            x, have = features(table, common.strings(batch))
            p = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ m.weights, -30, 30)))
            p = np.where(have, p, m.prior)
            return [p, pa.array((p >= 0.5).astype(np.int32))]

        return each

    return common.add_columns(docs, [(score, T.DoubleType()), (predicted, T.IntegerType())], make, rows=128)
