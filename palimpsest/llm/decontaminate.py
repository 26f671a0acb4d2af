"""Operator 10: benchmark passages in documents by CGK embedding, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common, exact_dedup

#: Least similarity, 1 - edits / words of the item.
SIMILARITY = 0.8
#: Random walks, tables of each walk, sampled places of each table.
WALKS, TABLES, PLACES = 4, 16, 5
#: Items of fewer words are looked up as they are, as no edit is allowed in them; as part of a text they are no leak.
LEAST_WORDS = 5
#: Words of a text that an item is aligned with at a time, about.
STRETCH = 1 << 14
#: Words above which an item is looked for by its pieces: embeddings stay near only while edits are few.
PIECE_WORDS = 96
#: Bytes of items that are looked for in one pass over the documents; more are taken in blocks.
BLOCK_BYTES = 4 << 20
#: Groups, by hash of item_id, from which blocks are put together.
GROUPS = 4096
#: Words in more than this share of a block's items are common ones.
COMMON_SHARE = 0.05
#: Starting places that are embedded at once.
AT_ONCE = 1 << 16
#: Text bytes and rows that are searched at a time, about: a different part is looked at once in each of these stretches.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 1 << 13

#: Scripts written without blanks (Thai to Tibetan, Burmese, Khmer, kana, Han): fixed ranges of Unicode blocks.
_UNBROKEN = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_UNBROKEN}]|[^\\W_{_UNBROKEN}]+")
#: Parts between blanks that are one word with ASCII marks around it; letters up to U+024F but U+0130, whose lower case is two.
_PART = "^[!-/:-@\\[-`{-~]*(?P<word>[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)[!-/:-@\\[-`{-~]*$"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case: marks, case and white space don't count as edits. Of scripts that are
    written without blanks each letter is a word of its own."""
    return _WORD.findall((text or "").lower())


def alignment(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the place in region that is nearest to the item in insertions, deletions and substitutions."""
    m = len(region)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    step = np.arange(m + 1)
    for i, w in enumerate(item):
        skip = cost + 1  # item word left out
        take = np.r_[i + 1, cost[:-1] + (region != w)]
        take_start = np.r_[0, start[:-1]]
        best = np.where(take <= skip, take, skip)
        from_ = np.where(take <= skip, take_start, start)
        # region words left out: the least of best + distance over all places before
        low = np.minimum.accumulate(best - step)
        where = np.maximum.accumulate(np.where(best - step == low, step, 0))
        cost, start = low + step, from_[where]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finaliser of a split-mix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _step_number(seed: int, step: int) -> int:
    """63 bits that differ for every seed and step."""
    return int(_mixed(np.array([seed + step * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]) >> 1


@dataclass
class SizeClass:
    """Items of about one length, with the LSH tables of their embeddings and, of each walk, its seed and the sampled
    places of its tables. Coins aren't stored: they are bits of a hash of seed, step and word."""

    members: list[int]
    least: int
    most: int
    need: int = 0
    need_rare: int = 0
    known: np.ndarray | None = None
    rare: np.ndarray | None = None
    seeds: list[int] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray | None = None
    owners: np.ndarray | None = None


class Index:
    """The items of one block: vocabulary, size classes and tables."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, walks: int, tables: int, places: int, least_words: int, seed: int = 17):
        self.similarity, self.vocab, self.items = similarity, {}, []
        # by first word: items whose words must follow each other as they are
        self.short: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        short = []
        for item_id, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            w = words(text)
            if len(w) >= least_words or self.allowed(len(w)):
                self.items.append((item_id, np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int32)))
            elif w:
                short.append((w, item_id))
        # words of short items alone come after the vocabulary
        numbers = dict(self.vocab)
        for w, item_id in short:
            own = np.array([numbers.setdefault(x, len(numbers) + 1) for x in w], np.int32)
            self.short[int(own[0])].append((own, item_id))
        self.numbers, self.names = numbers, pa.array(numbers, pa.string())
        self.leads = np.zeros(len(numbers) + 1, bool)
        self.leads[list(self.short)] = True
        holders = np.bincount(np.concatenate([np.unique(w) for _, w in self.items]), minlength=len(self.vocab) + 1) if self.items else np.zeros(1, int)
        common_word = holders > max(1, COMMON_SHARE * len(self.items))
        rng = np.random.default_rng(seed)
        # (item, place in it, words): within the similarity of the whole, one piece at least is within its own
        self.pieces: list[tuple[int, int, np.ndarray]] = []
        for i, (_, w) in enumerate(self.items):
            edges = np.linspace(0, len(w), -(-len(w) // PIECE_WORDS) + 1).astype(int).tolist()
            self.pieces += [(i, a, w[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        self.classes: list[SizeClass] = []
        for i in sorted(range(len(self.pieces)), key=lambda i: len(self.pieces[i][2])):
            n = len(self.pieces[i][2])
            if not self.classes or n > 1.15 * self.classes[-1].least:
                self.classes.append(SizeClass([], n, n))
            self.classes[-1].members.append(i)
            self.classes[-1].most = n
        for c in self.classes:
            self._prepare(c, common_word, rng, walks, tables, places)

    def allowed(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)

    def _prepare(self, c: SizeClass, common_word: np.ndarray, rng, walks: int, tables: int, places: int) -> None:
        own = [self.pieces[i][2] for i in c.members]
        c.known = np.zeros(len(self.vocab) + 1, bool)
        c.known[np.concatenate(own)] = True
        c.rare = c.known & ~common_word
        # each edit can spoil one word of the item at most
        c.need = min(len(w) - self.allowed(len(w)) for w in own)
        c.need_rare = min(int(c.rare[w].sum()) - self.allowed(len(w)) for w in own)
        steps = 2 * c.least
        keys, owners = [], []
        line = np.concatenate([np.r_[w, np.full(steps, -1, np.int32)] for w in own])
        starts = np.cumsum([0, *[len(w) + steps for w in own[:-1]]])
        for _ in range(walks):
            c.seeds.append(int(rng.integers(0, 1 << 62)))
            c.places.append(np.stack([np.sort(rng.choice(steps, min(places, steps), replace=False)) for _ in range(tables)]))
        for k in self.embed(c, line, starts):
            keys.append(k)
            owners.append(np.array(c.members))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        c.keys, c.owners = keys[order], owners[order]

    def embed(self, c: SizeClass, line: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk and table the keys of the windows that start there: hashes of the sampled places of the walk.

        The walk copies the word it stands on, then a coin of the step and the word says whether it moves on. Two
        windows with few edits soon walk in step again, so they differ in few places.
        """
        for walk, (seed, places) in enumerate(zip(c.seeds, c.places, strict=True)):
            # by word, from -1 on
            at, hashes = starts.copy(), _mixed(np.arange(1, len(self.vocab) + 3).astype(np.uint64) + np.uint64(seed))
            keys = [np.full(len(starts), (walk * 1000 + t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64) for t in range(len(places))]
            wanted = defaultdict(list)
            for t, p in enumerate(places):
                for j in p.tolist():
                    wanted[j].append(t)
            for j in range(max(wanted) + 1):
                mix = hashes[line[np.minimum(at, len(line) - 1)] + 1]
                if j in wanted:
                    for t in wanted[j]:
                        keys[t] = (keys[t] ^ mix) * np.uint64(0x100000001B3)
                        keys[t] ^= keys[t] >> np.uint64(29)
                at += (mix * np.uint64(2 * _step_number(seed, j) + 1) >> np.uint64(63)).astype(np.int64)
            yield from keys

    def _lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words (0: none of the items'), one -1 after each text, and where each text starts."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, _PART)
        number = pc.index_in(pc.utf8_lower(pc.struct_field(cut, "word")), value_set=self.names)
        number = pc.fill_null(pc.if_else(pc.is_valid(cut), number, None), -1).to_numpy(zero_copy_only=False) + 1
        # all other parts may hold any number of words
        other = pc.is_null(cut)
        found = [words(x) for x in coded.dictionary.filter(other).to_pylist()]
        sizes, rest = np.ones(len(number), np.int64), other.to_numpy(zero_copy_only=False)
        sizes[rest] = [len(w) for w in found]
        flat = np.empty(sizes.sum(), np.int32)
        whose = np.repeat(rest, sizes)
        flat[~whose] = number[~rest]
        flat[whose] = [self.numbers.get(x, 0) for w in found for x in w]
        place = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[place]
        before, first = np.cumsum(each) - each, np.cumsum(sizes) - sizes
        inner = flat[np.repeat(first[place] - before, each) + np.arange(each.sum())]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.add.reduceat(each, np.cumsum(counts) - counts)
        line = np.full(len(inner) + len(total), -1, np.int32)
        line[np.arange(len(inner)) + np.repeat(np.arange(len(total)), total)] = inner
        return line, np.r_[0, np.cumsum(total + 1)]

    def _equal(self, line: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """The first place of each short item in each text, as search() gives it."""
        seen = set()
        for k in np.flatnonzero(self.leads[np.maximum(line, 0)]).tolist():
            i = int(np.searchsorted(bounds, k, "right")) - 1
            for own, item in self.short[int(line[k])]:
                if (i, item) not in seen and np.array_equal(line[k : k + len(own)], own):
                    seen.add((i, item))
                    at = k - int(bounds[i])
                    yield i, item, 0, len(own), at, at + len(own), int(bounds[i + 1] - bounds[i]) - 1

    def search(self, texts: list[str] | pa.Array) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text number, item_id, edits, words of the item, first word, word after the last, words of the text), the best
        place of each pair."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else pc.fill_null(texts, "")
        if not len(column):
            return []
        pad = 1
        line, bounds = self._lines(column)
        equal = list(self._equal(line, bounds)) if self.short else []
        if not self.items:
            return equal
        line[line > len(self.vocab)] = 0
        best: dict[tuple[int, int], tuple] = {}
        for c in self.classes:
            for d, a, item in self._pairs(c, line, bounds):
                w = self.items[item][1]
                spare = self.allowed(len(w))
                lo, hi = max(bounds[d], a[0] - spare), min(bounds[d + 1] - pad, a[1] + len(w) + spare)
                if hi <= lo:
                    continue
                for lo_ in range(lo, hi, STRETCH):
                    # stretches overlap by the longest place
                    edits, s, e = alignment(w, line[lo_ : min(hi, lo_ + STRETCH + len(w) + spare)])
                    if edits <= spare:
                        key, row = (d, item), (edits, int(lo_ + s - bounds[d]), int(lo_ + e - bounds[d]))
                        best[key] = min(best.get(key, row), row)
        return equal + [(i, self.items[item][0], edits, len(self.items[item][1]), s, e, int(bounds[i + 1] - bounds[i]) - pad) for (i, item), (edits, s, e) in sorted(best.items())]

    def _pairs(self, c: SizeClass, line: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, tuple[int, int], int]]:
        """(text, (first, last) start, item) of neighbouring places of a text where the item would start, as windows that share
        a key with it or with a piece of it tell."""
        wide = c.most + self.allowed(c.most)

        def within(held: np.ndarray) -> np.ndarray:
            """How many places from each one on, up to wide, are held."""
            total = np.zeros(len(held) + 1, np.int32)
            np.cumsum(held, out=total[1:])
            rest = max(0, len(held) - wide)
            return np.r_[total[wide : wide + rest], np.full(len(held) - rest, total[-1])] - total[:-1]

        # the place after a text, -1, is looked up as the last word's
        known = np.r_[c.known, False][line]
        ok = known & (within(known) >= c.need)
        if c.need_rare > 0:
            ok &= within(np.r_[c.rare, False][line]) >= c.need_rare
        starts = np.flatnonzero(ok)
        hits = set()  # text, item, where the item would start
        for i in range(0, len(starts), AT_ONCE):
            part = starts[i : i + AT_ONCE]
            for keys in self.embed(c, line, part):
                a = np.searchsorted(c.keys, keys, "left")
                for k in np.flatnonzero(c.keys[np.minimum(a, len(c.keys) - 1)] == keys):
                    d = int(np.searchsorted(bounds, part[k], "right")) - 1
                    for o in c.owners[a[k] : np.searchsorted(c.keys, keys[k], "right")].tolist():
                        item, before, _ = self.pieces[o]
                        hits.add((d, item, int(part[k]) - before))
        run: tuple[int, int, int, int] | None = None
        for d, o, s in sorted(hits):
            if run and (run[:2] != (d, o) or s - run[3] > len(self.items[o][1])):
                yield run[0], run[2:], run[1]
                run = None
            run = (d, o, run[2] if run else s, s)
        if run:
            yield run[0], run[2:], run[1]


def _blocks(items: DataFrame, block_bytes: int) -> list[list[int]]:
    """Groups of items put together to blocks of about so many bytes; one empty block if there are none."""
    size = items.groupBy("part").agg(F.sum(F.octet_length("text")).alias("b")).orderBy("part").collect()
    blocks, held = [[]], 0
    for r in size:
        if blocks[-1] and held + r["b"] > block_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(r["part"])
        held += r["b"]
    return blocks


FOUND = {"item_id": pa.int64(), "edits": pa.int32(), "item_words": pa.int32(), "start_word": pa.int32(), "end_word": pa.int32(), "doc_words": pa.int32(), "similarity": pa.float64()}


def find(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """Benchmark items that occur in documents with similarity or more, at any place of the whole text.

    Output: doc_id, item_id, edits, item_words, start_word, end_word (of the nearest place, words as words() counts
    them), doc_words, similarity. A window can hold an item only where enough of the item's words, and of its rarer words,
    are near each other; that test loses nothing. Longer items than PIECE_WORDS are looked for by pieces and then aligned
    whole. The windows left are embedded by random walks and looked up in LSH tables, and the pairs found are aligned
    exactly, a stretch of the text at a time. Items so short that no word may differ are looked up as they are. The
    benchmark is a stated query set: its items go to every task, in blocks of bounded size, each of which is one pass over
    the documents; documents are never shuffled.

    Nulls and texts without words match nothing. Repeated rows give repeated results; a null doc_id stays null. Very long
    texts are searched whole, in memory of some times their words. Other columns are ignored. Empty tables give an empty
    result. params: similarity, walks, tables, places, least_words, block_bytes.
    """
    return _found(docs, benchmark, {"doc_id": F.col("doc_id").cast("long")}, **params)


def _found(docs: DataFrame, benchmark: DataFrame, own: dict[str, Column], similarity: float = SIMILARITY, walks: int = WALKS, tables: int = TABLES, places: int = PLACES, least_words: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """find(), with columns of type long that name the documents."""
    spark, names = docs.sparkSession, list(own)
    source = docs.select(*[c.alias(n) for n, c in own.items()], "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(GROUPS)))
    schema = ", ".join([*(f"{n} long" for n in names), "item_id long, edits int, item_words int, start_word int, end_word int, doc_words int, similarity double"])
    out = None
    for parts in _blocks(items, block_bytes):
        rows = [tuple(r) for r in items.filter(F.col("part").isin(parts)).select("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            common.let_go()
            index = Index(sent.value, similarity, walks, tables, places, least_words)
            for whole in batches:
                for b in common.pieces(whole, PIECE_ROWS, most=PIECE_BYTES):
                    found = index.search(b.column("text")) if index.items or index.short else []
                    at = pa.array([r[0] for r in found], pa.int64())
                    rest = [(*r[1:], 1 - r[2] / r[3]) for r in found]
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(n).take(at) for n in names), *(pa.array([r[k] for r in rest], t) for k, t in enumerate(FOUND.values()))],
                        names=[*names, *FOUND],
                    )

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, **params) -> DataFrame:
    """docs without those in which an item occurs; one of fewer than least_words words must be the whole document.

    Rows are named by doc_id and text together, so rows that share a doc_id are judged each by its own text, and a leak
    without a doc_id goes too. Other columns stay as they are.
    """
    ident = exact_dedup.identity(F.col("doc_id"), F.col("text"))
    hit = common.stage(_found(docs, benchmark, {"a": ident["a"], "b": ident["b"]}, **params).filter((F.col("item_words") >= least_words) | (F.col("item_words") == F.col("doc_words"))).select("a", "b").distinct(), "leaks")
    return exact_dedup.without_copies(docs, hit.withColumns({"n": F.lit(1), "kept": F.lit(False)}))
