"""Operator 9: scores by a word unigram over the whole corpus and by prediction by partial matching over bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from palimpsest.llm import common, ppm

#: Added to every count of the unigram.
ADD = 0.1
#: Rows of one word that a task gets, and of how many blocks one shows which words are common.
ROWS_A_TASK, SAMPLE = 4096, 16
#: Text bytes of a block, about: what one task holds at a time.
BLOCK_BYTES = 16 << 20
#: Bytes of the longest context, and code points that a piece of a very long text repeats of the one before.
ORDER, LEAD = 4, 8
_WHITE = re.compile("[\x20\x09-\x0d]")


def blocks(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row, held_out, text, lead, first, last, block), written to the shared folder: pieces of texts, in blocks of
    neighbouring rows that hold about block_bytes at most, however long the texts are.

    Most texts are one piece. A longer one than block_bytes is cut before white space, or within a word of a quarter of
    that at least: every piece but the first holds in its front some bytes of the one before (lead tells how many), as
    context of what follows. Words that a cut parts (inside: the piece begins in one; goes_on: it ends in one) are counted
    where they end, by a digest of the whole (giant), as are all words of that length. row names the text.
    """
    giant_size = max(1, block_bytes // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        row, block, held, extra = task, task, 0, 0
        names = ["doc_id", "row", "held_out", "text", "lead", "first", "last", "block", "inside", "goes_on", "giant"]
        for whole in batches:
            for b in common.pieces(whole):
                size = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.empty(b.num_rows, np.int64)
                for i, n in enumerate(size.tolist()):
                    if held and held + n > block_bytes:
                        block, held = block + 1, 0
                    at[i], held = block, held + n
                long = np.flatnonzero(size > block_bytes).tolist()
                for i, z in zip([0, *[k + 1 for k in long]], [*long, b.num_rows], strict=True):
                    n = z - i
                    if n:
                        fixed = [np.zeros(n, np.int32), np.ones(n, bool), np.ones(n, bool), at[i:z], np.zeros(n, bool), np.zeros(n, bool), pa.nulls(n, pa.string())]
                        some = b.slice(i, n)
                        yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(row + np.arange(i, z)), some.column("held_out"), some.column("text"), *(x if isinstance(x, pa.Array) else pa.array(x) for x in fixed)], names=names)
                for k in long:
                    one, front = b.slice(k, 1), ""
                    text, inside, word = one.column("text")[0].as_py(), False, None
                    pieces = common.stretches(text, giant_size, 0, lambda c: not _WHITE.match(c), _WHITE)
                    done, i = 0, 0
                    for t, _, goes_on in pieces:
                        done += len(t)
                        # a block of its own for each piece; the text's own number is the first one's
                        where = int(at[k]) if i == 0 else task + (1 << 32) + extra
                        extra += i > 0
                        giant = None
                        if inside:
                            blank = _WHITE.search(t)
                            word.update(_lowered(t[: blank.start()] if blank else t))
                            if blank or not goes_on:
                                giant = f"\x00{word.hexdigest()}"
                        if goes_on and (not inside or giant):
                            word = hashlib.sha256(_lowered(_last_word(t)))
                        rest = [pa.array([len(front.encode("utf-8", "surrogatepass"))], pa.int32()), pa.array([i == 0]), pa.array([done == len(text)]), pa.array([where]), pa.array([inside]), pa.array([goes_on]), pa.array([giant], pa.string())]
                        yield pa.RecordBatch.from_arrays([one.column("doc_id"), pa.array([row + k]), one.column("held_out"), pa.array([front + t]), *rest], names=names)
                        front, inside, i = (front + t)[-LEAD:], goes_on, i + 1
                row += b.num_rows

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    return common.stage(source.mapInArrow(run, "doc_id long, row long, held_out boolean, text string, lead int, first boolean, last boolean, block long, inside boolean, goes_on boolean, giant string"), "lm-blocks")


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # of bytes only A-Z


def _last_word(text: str) -> str:
    """What follows the last blank."""
    return text[max(text.rfind(c) for c in " \t\n\x0b\x0c\r") + 1 :]


def _own_text(b: pa.RecordBatch | pa.Table, giant_size: int) -> pa.Array:
    """The texts of the pieces as far as their words are counted here: without what they repeat of the piece before, without
    parts of words that are cut, words of giant_size code points or more as digests."""
    text = b.column("text")
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    lead, inside, goes_on = (np.asarray(b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(c).to_numpy()) for c in ("lead", "inside", "goes_on"))
    long = pc.fill_null(pc.greater_equal(pc.binary_length(text), giant_size), False).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero((lead > 0) | inside.astype(bool) | goes_on.astype(bool) | long)
    if not len(odd):
        return text
    giants, out, word = b.column("giant").to_pylist(), text.to_pylist(), re.compile("[^\x20\x09-\x0d]{%d,}" % giant_size)
    for i in odd.tolist():
        t = out[i].encode("utf-8", "surrogatepass")[lead[i] :].decode("utf-8", "surrogatepass")
        if inside[i]:
            blank = _WHITE.search(t)
            t = t[blank.start() :] if blank else ""
        if goes_on[i]:
            t = t[: len(t) - len(_last_word(t))]
        t = word.sub(lambda m: "\x00" + hashlib.sha256(_lowered(m[0])).hexdigest(), t)
        out[i] = f"{giants[i]} {t}" if giants[i] else t
    return pa.array(out, pa.string())


def _piece_grams(b: pa.RecordBatch | pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """ppm.grams of the pieces: what a piece repeats is context only, and only a text's last piece has an end."""
    g, begins = ppm.grams(_encoded(common.strings(b)), order)
    lead, last = np.asarray(b.column("lead").to_numpy()), np.asarray(b.column("last").to_numpy(zero_copy_only=False), bool)
    if last.all() and not lead.any():
        return g, begins
    keep, ends = np.ones(len(g), bool), np.r_[begins[1:], len(g)]
    for i in np.flatnonzero((lead > 0) | ~last).tolist():
        keep[begins[i] : begins[i] + lead[i]] = False
        keep[ends[i] - (not last[i]) : ends[i]] = False
    return g[keep], np.r_[0, np.cumsum(keep)][begins]


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, the number of the word at each place, and where each text's places end.

    Words are runs without ASCII white space, A-Z in lower case. All of it is done on Arrow arrays.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    void = pc.index(coded.dictionary, "").as_py()  # white space at the ends of a text leaves empty strings
    if void >= 0:
        keep = place != void
        ends = np.r_[0, np.cumsum(keep)][ends]
        place = place[keep]
    return coded.dictionary, place, ends


def _joined(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Sums of counts by word."""
    coded = pa.concat_arrays(words).dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.concatenate(counts), len(coded.dictionary)).astype(np.int64)


def _encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one block."""
    for whole in batches:
        at = whole.column("block").to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < z:
                yield int(at[a]), whole.slice(a, z - a)


def block_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, gram, own): the different grams of each block's bytes and how often its training rows hold them.

    A gram is a byte or end with the order bytes before it. A block's rows may be read by several tasks, so a gram may
    have more than one row for a block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        held, block = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            (k,), (n,) = _summed(keys, sums)
            keys.clear(), sums.clear()
            line = np.argsort(k)
            for i in range(0, len(k), 1 << 16):
                part = line[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(k[part]), pa.array(n[part])], names=["block", "gram", "own"])

        for at, run in _by_block(batches):
            if at != block:
                yield from close()
                held, block = 0, at
            for b in common.pieces(run):
                g, begins = _piece_grams(b, order)
                learn = np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool) == 0
                code, found = pd.factorize(g)
                keys.append(found), sums.append(np.bincount(code[np.repeat(learn, np.diff(np.r_[begins, len(g)]))], minlength=len(found)))
                held += len(found)
                if held > 1 << 20:
                    keys[:], sums[:] = _summed(keys, sums)
                    held = 0
        yield from close()

    return rows.select("text", "held_out", "block", "lead", "last").mapInArrow(count, "block long, gram long, own long")


def gram_costs(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, cost): log10 of the probability of each gram's last byte after the bytes before it. counted: (gram, n).

    Every context that occurs counts, whatever its share; grams with n = 0 are only asked for. Escape is by method C,
    with exclusion: the escaped mass goes to bytes that the context hasn't shown, in proportion to what the next
    shorter context gives them. Whatever a context has shown its suffix has shown too, so all that is needed of the
    shorter one is in its own rows, and each length is a join with the one before it.
    """
    levels = [counted]
    for n in range(order, 0, -1):
        levels.append(common.stage(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(F.sum("n").alias("n")), "lm-suffixes"))
    context = Window.partitionBy(F.shiftright("gram", 8))
    p = None
    for n, level in enumerate(reversed(levels)):
        if p is None:
            rows = level.withColumn("below", F.lit(1 / 256))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
            rows = level.withColumn("suffix", suffix).join(p.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix").drop("suffix")
        shown = F.col("n") > 0
        rows = rows.withColumns({"of": F.sum("n").over(context), "kinds": F.sum(shown.cast("int")).over(context), "mass": F.greatest(1 - F.sum(F.when(shown, F.col("below")).otherwise(0.0)).over(context), F.lit(1e-15))})
        escape = F.when(F.col("kinds") < 256, F.col("kinds") / (F.col("of") + F.col("kinds"))).otherwise(0.0)
        p = rows.select("gram", F.when(F.col("of") == 0, F.col("below")).when(shown, (1 - escape) * F.col("n") / F.col("of")).otherwise(escape * F.col("below") / F.col("mass")).alias("p"))
    return p.select("gram", F.log10("p").alias("cost"))


def train_ppm(rows: DataFrame) -> ppm.Model:
    """The model of contexts up to ppm.ORDER bytes as one dense table, for corpora whose contexts a process can hold.

    score() doesn't use it: there each block gets the costs of its own grams.
    """
    own = block_grams(rows.filter("not held_out").withColumns({"block": F.lit(0).cast("long"), "lead": F.lit(0), "last": F.lit(True)}), ppm.ORDER)
    found = own.groupBy("gram").agg(F.sum("own").alias("n")).toArrow()
    gram, count = (found.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    tables = []
    for n in range(ppm.ORDER + 1):
        kinds, at = np.unique(gram % (1 << 8 * (n + 1)), return_inverse=True)
        tables.append((kinds, np.bincount(at, count, len(kinds)).astype(np.int64)))
    return ppm.build(common.new_name(), tables)


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    code, found = pd.factorize(np.concatenate(keys))
    return [found], [np.bincount(code, np.concatenate(sums), len(found)).astype(np.int64)]


def word_sums(counted: DataFrame, blocks: int) -> tuple[DataFrame, int, int]:
    """(block, word, total) of every word of a block that other blocks hold too, the sum of all counts, and the words
    counted at all. counted: (block, word, own).

    A word's rows meet in one task, at most one for each block. With more than ROWS_A_TASK blocks common words, as
    every SAMPLE-th block shows them, take another way: their sums are combined before the shuffle, and go back to
    their rows by (word, salt). Which way a word takes changes no result.
    """
    common_sums = None
    if blocks > ROWS_A_TASK:
        counted = common.stage(counted, "lm-block-words")
        some = counted.filter(F.pmod(F.xxhash64("block"), F.lit(SAMPLE)) == 0).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
        often = common.stage(some.filter(F.col("rows") > ROWS_A_TASK // SAMPLE).select("word"), "lm-common-words")
        side = common.small_side(often, often.count(), 40)
        hot = counted.join(side, "word", "left_semi").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(common.SALTS)).cast("int"))
        counted = counted.join(side, "word", "left_anti")
        common_sums = common.stage(hot.groupBy("word").agg(F.sum("own").alias("total")), "lm-common-sums")
    of_word = Window.partitionBy("word")
    seen = Observation("words")
    totals = counted.withColumn("row", F.monotonically_increasing_id()).withColumns({"total": F.sum("own").over(of_word), "first": F.min("row").over(of_word)})
    replies = totals.observe(seen, F.sum("own").alias("n"), F.count(F.when((F.col("row") == F.col("first")) & (F.col("total") > 0), F.col("word"))).alias("v"))
    replies = common.stage(replies.filter("total <> own").select("block", "word", "total"), "lm-replies")
    n, v = seen.get["n"] or 0, seen.get["v"] or 0
    if common_sums is not None:
        more = common_sums.agg(F.sum("total").alias("n"), F.count(F.when(F.col("total") > 0, 1)).alias("v")).first()
        n, v = n + (more["n"] or 0), v + more["v"]
        dealt = common_sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(common.SALTS - 1))))
        replies = replies.unionByName(hot.join(dealt, ["word", "salt"]).filter("total <> own").select("block", "word", "total"))
    return replies, n, v


def score(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """Scores every document by models of those for which held_out is false.

    Output: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Words are counted by block; a
    block sends one row for each of its words, the sums over all blocks come back only for words that another block
    has too, and the block is scored with them, so no table of all words is ever in one place. Bytes go the same way: a
    block sends its different grams and gets back what each of them costs under the contexts of the whole corpus. Null and empty texts
    are an end alone; null doc_ids and repeated rows stay; an empty table gives no rows. Without training rows
    every count is zero and every byte equally likely.
    """
    rows, giant_size = blocks(docs, held_out, block_bytes), max(1, block_bytes // 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        counts: list[np.ndarray] = []
        block = None

        def close() -> Iterator[pa.RecordBatch]:
            if not words:
                return
            w, n = _joined(words, counts)
            keep = w.filter(pc.not_equal(w, "")), n[np.asarray(pc.not_equal(w, ""))]
            words.clear(), counts.clear()
            pa.default_memory_pool().release_unused()
            for i in range(0, len(keep[0]), 1 << 16):
                part = keep[0].slice(i, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), part, pa.array(keep[1][i : i + (1 << 16)])], names=["block", "word", "own"])

        for at, run in _by_block(batches):
            if at != block:
                yield from close()
                block = at
            for b in common.pieces(run, 2048):
                w, place, ends = coded_words(_own_text(b, giant_size))
                learn = ~np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool)
                words.append(w), counts.append(np.bincount(place[np.repeat(learn, np.diff(np.r_[0, ends]))], minlength=len(w)))
        yield from close()

    # a block's rows may be read by several tasks, so a word may have more than one row for a block
    counted = rows.select("text", "held_out", "block", "lead", "inside", "goes_on", "giant").mapInArrow(count, "block long, word string, own long")
    replies, n, v = word_sums(counted, rows.select("block").distinct().count())
    ends = rows.filter("not held_out and last").count()
    train, kinds = n + ends, v + (ends > 0)
    floor = np.log10(train + ADD * (kinds + 1))
    asked = common.stage(block_grams(rows, order), "lm-block-grams")
    costs = gram_costs(common.stage(asked.groupBy("gram").agg(F.sum("own").alias("n")), "lm-grams"), order)
    # one table of replies: a word with its sum, or a gram (word is null) with its cost
    costly = asked.join(costs, "gram").select("block", F.lit(None).cast("string").alias("word"), F.col("gram").alias("n"), "cost")
    answers = replies.select("block", "word", F.col("total").alias("n"), F.lit(None).cast("double").alias("cost")).unionByName(costly)

    def each(texts: pa.Table, sums: pa.Table) -> pa.Table:
        named = pc.is_valid(sums.column("word"))
        grams, sums = sums.filter(pc.invert(named)).select(["n", "cost"]), sums.filter(named)
        keys, first = np.unique(grams.column("n").to_numpy(), return_index=True)
        priced, cost = pd.Index(keys), grams.column("cost").to_numpy()[first]
        del grams
        column = _own_text(texts, giant_size)
        learn = ~np.asarray(texts.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
        words, place, after = coded_words(column)
        sizes = np.diff(np.r_[0, after])
        have = np.bincount(place[np.repeat(learn, sizes)], minlength=len(words)).astype(np.float64)
        at = pc.index_in(sums.column("word").combine_chunks(), words).to_numpy(zero_copy_only=False).astype(np.int64)
        have[at] = sums.column("n").to_numpy()
        logs, known = np.log10(have + ADD), have > 0
        base, n_known = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        for i in range(0, len(sizes), 1024):
            z = after[i : i + 1024]
            k = z - sizes[i : i + 1024] - (first := int(z[0] - sizes[i]))
            part = place[first : z[-1]]
            some = sizes[i : i + 1024] > 0
            base[i : i + 1024] = np.where(some, np.add.reduceat(np.r_[logs[part], 0.0], k), 0.0)
            n_known[i : i + 1024] = np.where(some, np.add.reduceat(np.r_[known[part], False].astype(np.int64), k), 0)
        last = np.asarray(texts.column("last").to_numpy(zero_copy_only=False), bool)
        n_known += last & (ends > 0)
        base += np.log10(ends + ADD) * last - floor * (sizes + last)
        del words, place
        whole = np.zeros(len(sizes))
        for i in range(0, texts.num_rows, 256):
            g, begins = _piece_grams(texts.slice(i, 256), order)
            found = priced.get_indexer(g)
            if (found < 0).any():
                raise ValueError("a gram of the block has no cost")
            whole[i : i + 256] = np.add.reduceat(cost[found], begins) if len(found) else 0
        pa.default_memory_pool().release_unused()
        fixed = {"n_tokens": sizes + last, "n_known": n_known, "base_score": base, "score": whole}
        return pa.table({**{c: texts.column(c) for c in ("doc_id", "row", "held_out", "first", "last")}, **{c: pa.array(v) for c, v in fixed.items()}})

    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, "doc_id long, row long, held_out boolean, first boolean, last boolean, n_tokens long, n_known long, base_score double, score double")
    if rows.filter("not last").isEmpty():
        found = scored.drop("row", "first", "last")
    else:  # texts of several pieces
        scored = common.stage(scored, "lm-scored")
        more = scored.filter("not (first and last)").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        found = scored.filter("first and last").drop("row", "first", "last").unionByName(more.drop("row"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
