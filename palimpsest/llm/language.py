"""Operator 3: language identification by script ranges and Viterbi over per-word scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

#: Labelled rows of each language that are read at most, about: a sample by hash of doc_id.
MAX_PER_LANGUAGE = 4_000
#: Nats that a change of language costs.
SWITCH = 12.0
#: Nats by which a word is less likely under languages that don't use its script than under the worst that does.
OTHER_SCRIPT = 40.0
#: Code points of a text that are scored at a time, about.
STRETCH = 1 << 18
#: Letters are hashed to 1-63; 0 stands before and after a word.
SYMBOLS = 64
UNKNOWN = "und"

#: First code point of each script range; a range ends where the next begins. Fixed values of the Unicode blocks.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF5B, "kana"), (0xFFA0, "hangul"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in RANGES))

_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol (0: no letter) and script of each code point of the basic plane."""
    global _TABLES
    if _TABLES is None:
        symbol, script, at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0
        for i in range(1 << 16):
            if at + 1 < len(RANGES) and RANGES[at + 1][0] <= i:
                at += 1
            script[i] = SCRIPTS.index(RANGES[at][1])
            if chr(i).isalpha():
                symbol[i] = i - 96 if 97 <= i <= 122 else 27 + i * 2654435761 % (1 << 32) % 37
        _TABLES = symbol, script
    return _TABLES


@dataclass
class Words:
    grams: np.ndarray  # of each letter and word end: it and the two symbols before it, within its word
    begins: np.ndarray  # where each word's grams start
    letters: np.ndarray  # letters of each word
    script: np.ndarray  # of its first letter
    owner: np.ndarray  # text number


def code(texts: list[str]) -> Words:
    """Runs of letters of all texts, as symbols."""
    if not texts:
        return Words(*[np.empty(0, np.int64) for _ in range(5)])
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    table, kind = tables()
    base = np.minimum(points, (1 << 16) - 1)
    sym = table[base]
    far = np.flatnonzero(points >= 1 << 16)
    if len(far):
        sym[far] = [27 + p % 37 if chr(p).isalpha() else 0 for p in points[far].tolist()]
    script = np.where(points >= 1 << 16, SCRIPTS.index("other"), kind[base])
    keep = sym.astype(bool)
    keep[1:] |= keep[:-1]
    owner = np.repeat(np.arange(len(low)), np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))[keep]
    sym, script = sym[keep], script[keep]
    lead = 0
    while lead < len(sym) and sym[lead] == 0:  # nothing but a text's end
        lead += 1
    sym, script, owner = sym[lead:], script[lead:], owner[lead:]
    ends = np.flatnonzero(sym == 0) + 1
    begins = np.r_[0, ends[:-1]].astype(np.int64)[: len(ends)]
    place = np.arange(len(sym)) - np.repeat(begins, ends - begins)
    grams = sym.astype(np.int32)
    for back in (1, 2):
        before = np.zeros(len(sym), np.int32)
        before[back:] = sym[:-back] if back < len(sym) else 0
        before[place < back] = 0
        grams += before << (6 * back)
    return Words(grams, begins, ends - begins - 1, script[begins], owner[begins])


@dataclass
class Model:
    name: str
    languages: list[str]
    scores: np.ndarray  # log probability of a trigram's last symbol, a column for each language
    scripts: np.ndarray  # which scripts (rows) each language uses


def scored(model: Model, w: Words) -> np.ndarray:
    """Log probability of each word under each language (a column).

    The script of a word's first letter narrows the candidates: only languages that use it score the word, and the
    others get OTHER_SCRIPT less than the worst of them. A script that no language uses says nothing.
    """
    emit = np.zeros((len(w.begins), len(model.languages)))
    sizes = w.letters + 1
    of_gram = np.repeat(w.script, sizes)
    for script in np.unique(w.script).tolist():
        able = np.flatnonzero(model.scripts[script])
        if not len(able):
            continue
        rows = np.flatnonzero(w.script == script)
        grams = w.grams[of_gram == script]
        begins = np.cumsum(sizes[rows]) - sizes[rows]
        own = np.add.reduceat(model.scores[grams][:, able] if len(able) < len(model.languages) else model.scores[grams], begins, axis=0).astype(np.float64)
        emit[rows] = own.min(1, keepdims=True) - OTHER_SCRIPT
        emit[np.ix_(rows, able)] = own
    return emit


def _is_letter(c: str) -> bool:
    return c.isalpha()


def _row(model: Model, own: np.ndarray, script: int) -> np.ndarray:
    """scored() of one word whose log probabilities under all languages are known."""
    able = np.flatnonzero(model.scripts[script])
    row = np.zeros((1, len(own)))
    if len(able):
        row[:] = own[able].min() - OTHER_SCRIPT
        row[0, able] = own[able]
    return row


def long_scores(model: Model, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(scores, letters) of the words of a long text, a stretch at a time. A word that a cut parts is summed up over its
    stretches, so words of any length are held as their sums only."""
    own, letters, script = np.zeros(len(model.languages)), 0, 0
    for piece, before, goes_on in common.stretches(text.lower(), STRETCH, 2, _is_letter):
        w = code([piece])
        n = len(w.begins)
        after = np.r_[w.begins[1:], len(w.grams)]
        first, last = 0, n
        if before:
            first = 1
            alone = goes_on and n == 1
            own = own + model.scores[w.grams[before : after[0] - alone]].sum(0, dtype=np.float64)
            letters += int(w.letters[0]) - before
            if alone:
                continue
            yield _row(model, own, script), np.array([letters], np.int64)
        if goes_on:
            last = n - 1
            own = model.scores[w.grams[w.begins[last] : after[last] - 1]].sum(0, dtype=np.float64)
            letters, script = int(w.letters[last]), int(w.script[last])
        if last > first:
            a, z = w.begins[first], after[last - 1]
            yield scored(model, Words(w.grams[a:z], w.begins[first:last] - a, w.letters[first:last], w.script[first:last], w.owner[first:last])), w.letters[first:last]


class Path:
    """Viterbi over stretches of one text: fed with the scores of word after word, it gives the most likely languages."""

    def __init__(self, languages: int, switch: float):
        self.k, self.switch, self.best, self.back = languages, switch, None, []

    def feed(self, emit: np.ndarray) -> None:
        back, own = np.empty(emit.shape, np.uint8 if self.k < 256 else np.int32), range(self.k)
        best = self.best
        for t, e in enumerate(emit.tolist()):
            if best is None:
                best, back[t] = e, own
                continue
            top = max(own, key=best.__getitem__)
            over = best[top] - self.switch
            back[t] = [j if best[j] >= over else top for j in own]
            best = [(b if b >= over else over) + x for b, x in zip(best, e, strict=True)]
        self.best = best
        self.back.append(back)

    def labels(self) -> np.ndarray:
        out = np.empty(sum(map(len, self.back)), self.back[0].dtype)
        at, x = len(out), max(range(self.k), key=self.best.__getitem__)
        for back in reversed(self.back):
            for t in range(len(back) - 1, -1, -1):
                at -= 1
                out[at] = x
                x = back[t, x]
        return out


def path_labels(stretches: Callable[[], Iterator[np.ndarray]], k: int, switch: float) -> np.ndarray:
    """The most likely language of each word: Viterbi with a cost for each change.

    stretches() gives the scores of a text's words, a stretch at a time, and may be called again. One language all
    through is proven best without the recursion when no run of words gains as much under others as a change costs: a
    path that leaves it pays for each run at least once.
    """
    total, n = np.zeros(k), 0
    for emit in stretches():
        total += emit.sum(0)
        n += len(emit)
    lead = int(np.argmax(total))
    held = most = 0.0
    if k > 1:
        for emit in stretches():
            gain = emit - emit[:, lead : lead + 1]
            gain[:, lead] = -np.inf
            run = held + np.cumsum(gain.max(1))
            low = np.minimum(np.minimum.accumulate(np.r_[0.0, run]), 0.0)[:-1]  # held starts at its own least, 0
            most = max(most, float((run - low).max()), 0.0)
            held = max(0.0, float(run[-1] - min(0.0, run.min())))
    if most <= switch:
        return np.full(n, lead, np.int64)
    path = Path(k, switch)
    for emit in stretches():
        path.feed(emit)
    return path.labels()


def label(model: Model, texts: list[str], switch: float = SWITCH) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Of each text (language number of each word, letters of each word); None without letters.

    Texts longer than STRETCH are scored a stretch at a time, so that memory holds a word's label and letters, and where a
    text mixes languages its way back under each of them.
    """
    out: list = [None] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= STRETCH]
    w, k = code([texts[i] for i in short]), len(model.languages)
    if len(w.begins):
        emit = scored(model, w)
        cuts = np.r_[0, np.flatnonzero(np.diff(w.owner)) + 1, len(w.owner)]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[short[w.owner[a]]] = (path_labels(lambda a=a, z=z: iter([emit[a:z]]), k, switch), w.letters[a:z])
    for i, t in enumerate(texts):
        if len(t) > STRETCH:
            letters = [n.astype(np.int64) for _, n in long_scores(model, t)]
            if letters:
                out[i] = (path_labels(lambda t=t: (emit for emit, _ in long_scores(model, t)), k, switch), np.concatenate(letters))
    return out


def fit(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """Learns letter trigrams of words and the scripts of each language from documents with text and lang.

    About max_per_language documents of each language are read, chosen by hash of doc_id with a share that the
    language's count gives. Rows without text or lang are left out; without any the model knows no language.
    """
    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").filter("text is not null and lang is not null")
    n = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(n)
    if not names:
        return Model(common.new_name(), [], np.zeros((SYMBOLS**3, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, max_per_language / n[name]))])
    sample = given.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole, 1024):
                langs, texts = b.column("lang").to_pylist(), common.strings(b)
                for lang in dict.fromkeys(langs):
                    w = code([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    for kind, values in (("gram", w.grams), ("script", w.script.astype(np.int32))):
                        v, k = np.unique(values, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array([kind] * len(v)), pa.array(v.astype(np.int32)), pa.array(k)], names=["lang", "kind", "value", "n"])

    found = sample.select("lang", "text").mapInArrow(count, "lang string, kind string, value int, n long").groupBy("lang", "kind", "value").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    counts, scripts = np.zeros((SYMBOLS**3, len(names))), np.zeros((len(SCRIPTS), len(names)))
    for r in found:
        (counts if r["kind"] == "gram" else scripts)[r["value"], names.index(r["lang"])] += r["n"]
    scores = np.empty((SYMBOLS**3, len(names)), np.float32)
    for i in range(len(names)):
        c3 = counts[:, i].reshape(-1, SYMBOLS)
        c2 = c3.reshape(SYMBOLS, SYMBOLS, SYMBOLS).sum(0)
        c1 = c2.sum(0)
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SYMBOLS)
        p2 = (c2 + 8 * p1) / (c2.sum(1, keepdims=True) + 8)
        p3 = (c3 + 8 * np.tile(p2, (SYMBOLS, 1))) / (c3.sum(1, keepdims=True) + 8)
        scores[:, i] = np.log(p3).ravel()
    return Model(common.new_name(), names, scores, scripts >= np.maximum(1, 0.001 * scripts.sum(0)))


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, und: str = UNKNOWN) -> DataFrame:
    """docs with lang_pred, score and spans: the language of most letters after Viterbi, and its share of them.

    spans are (language, first word, word after the last) of each stretch. A null text, one without a letter, or a
    model without languages gives und, score 0 and no spans. Ties go to the language first in order. Other columns,
    null keys and repeated rows pass through; input columns of the three names are replaced. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def make():
        m: Model = sent.value

        def each(batch):
            texts = common.strings(batch)
            found = label(m, texts, switch) if m.languages else [None] * len(texts)
            lang, share, spans = [], [], []
            for x in found:
                if x is None:
                    lang.append(und), share.append(0.0), spans.append([])
                    continue
                path, letters = x
                by = np.bincount(path, letters, len(m.languages))
                top = int(np.argmax(by))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                lang.append(m.languages[top]), share.append(float(by[top] / by.sum()))
                spans.append([{"lang": m.languages[path[a]], "first": a, "last": z} for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
            return [lang, share, pa.array(spans, kind)]

        return each

    return common.add_columns(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("spans", span)], make, rows=128)
