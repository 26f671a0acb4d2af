"""Operator 12: how the sources of a language differ in their terms, ranked by radix selection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

#: Documents of a language that a term must be in.
LEAST_DOCUMENTS = 3
#: Ranks that part `term` is cut at: the feature's limit.
TOP = 200
SCALE = 1_000_000_000
#: Bytes of text whose terms are split at a time, and distinct terms that a task holds before it sends them on, about.
STRETCH = 1 << 20
HELD = 1 << 18
#: Sources of a language that are compared with as many others in one task's matrix.
TILE = 512
#: Values are below 2 to this power, as (p - q) squared by q is at most 10^18; they are looked at in digits of so many bits.
VALUE_BITS, DIGIT = 60, 15

# A term's bytes are letters A-Z, a-z and all of code points beyond 0x7F; A-Z are lower-cased, the rest become blanks.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def document_terms(text: memoryview | bytes) -> Counter[bytes]:
    """Occurrences of each term of a text in UTF-8, split a stretch at a time."""
    found: Counter[bytes] = Counter()
    at, rest = 0, b""
    while at < len(text):
        piece = rest + bytes(text[at : at + STRETCH]).translate(_TABLE)
        at += STRETCH
        cut = len(piece) if at >= len(text) else piece.rfind(b" ") + 1
        found.update(piece[:cut].split())
        rest = piece[cut:]
    found.update(rest.split())
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by group, in parts that are yet to be summed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "docs")])
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 1 << 15):
                    some = terms[i : i + (1 << 15)]
                    one = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * one), pa.array([source] * one), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())], schema=arrow)
            held.clear()

        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                if not text.is_valid:
                    continue
                found = document_terms(memoryview(text.as_buffer()))
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(found)
                d.update(found.keys())
                size += len(n) - before
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def share(n: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(10^9 (n + 1) / (total + kept)), without overflow."""
    return 1 + F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")), (total + kept).cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / q), exact in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


class Tables:
    """What both parts are worked out from: groups, and cells, the kept terms that occur in each group."""

    def __init__(self, docs: DataFrame) -> None:
        known = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), "text")
        # dealt by term alone, so that one shuffle serves the sums by group, the documents by language and the language's count
        found = term_counts(known).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        term = Window.partitionBy("lang", "term")
        found = found.withColumns({"in_lang": F.sum("n").over(term), "docs": F.sum("docs").over(term), "first": F.min("source").over(term) == F.col("source")})
        self.counts = common.stage(found.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "divergence-counts")
        langs = self.counts.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("v"), F.sum("n").alias("lang_total"))
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = known.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
        groups = groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))))
        groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        self.groups = common.stage(groups, "divergence-groups")
        near = common.small_side(self.groups, self.groups.count(), 128)
        cells = self.counts.join(near, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("v")))
        self.cells = common.stage(cells.select("lang", "source", "place", "term", "p", "q", "p0"), "divergence-cells")


def _both(cells: DataFrame) -> DataFrame:
    """(lang, g, h, value): over the terms that both groups hold, what f exceeds what the sums of each alone leave it at.

    A language's sources are dealt to tiles of TILE; a task has a matrix for one pair of tiles, to which it adds term by
    term, and sends on its entries once a tile pair. Terms of one source add nothing to it.
    """
    tiles = cells.groupBy("lang").agg((F.max("place") / TILE).cast("int").alias("last"))
    own = (F.col("place") / TILE).cast("int")
    ahead = F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.struct(own.alias("a"), t.alias("b")))
    back = F.transform(F.filter(F.sequence(F.lit(0), F.col("last")), lambda t: t != own), lambda t: F.struct(t.alias("a"), own.alias("b")))
    rows = cells.join(F.broadcast(tiles) if common.fits_broadcast(tiles.count(), 64) else tiles, "lang").withColumn("t", F.explode(F.concat(ahead, back)))
    key = ["lang", "a", "b", "term"]
    rows = rows.select("lang", "t.a", "t.b", "term", "place", "p", "p0").repartition(*key).sortWithinPartitions(*key)
    schema = T.StructType([T.StructField("lang", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("g", "h", "value")])

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: tuple[str, int, int] | None = None
        sums = np.zeros((TILE, TILE), np.int64)
        open_term: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(open_term) > 1:
                at, p, p0 = (np.array(x, np.int64) for x in zip(*open_term, strict=True))
                _, a, b = tile  # type: ignore[misc]
                g, h = at // TILE == a, at // TILE == b
                left, right, own = p[g][:, None], p[h][None, :], p0[g][:, None]
                base = p0[h][None, :]
                sums[np.ix_(at[g] % TILE, at[h] % TILE)] += f(left, right) - f(left, base) - f(own, right) + f(own, base)
            open_term.clear()

        def out() -> Iterator[pa.RecordBatch]:
            lang, a, b = tile  # type: ignore[misc]
            i, j = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + a * TILE), pa.array(j + b * TILE), pa.array(sums[i, j])], names=["lang", "g", "h", "value"])
            sums.fill(0)

        term: str | None = None
        for batch in batches:
            langs, a_, b_, terms, places, ps, p0s = (batch.column(c).to_pylist() for c in ("lang", "a", "b", "term", "place", "p", "p0"))
            for lang, a, b, t, place, p, p0 in zip(langs, a_, b_, terms, places, ps, p0s, strict=True):
                if t != term or (lang, a, b) != tile:
                    close()
                    if tile is not None and (lang, a, b) != tile:
                        yield from out()
                    term, tile = t, (lang, a, b)
                open_term.append((place, p, p0))
        if tile is not None:
            close()
            yield from out()

    return rows.mapInArrow(run, schema).groupBy("lang", "g", "h").agg(F.sum(_exact(F.col("value"))).alias("value"))


def pairs(t: Tables) -> DataFrame:
    """(lang, source, item, value): each group beside each other source of its language, which is what is asked for.

    A term that neither group holds gives every pair the same f(p0, q0), a term of one group a value that depends on its
    p alone. So a pair's sum is V f(p0, q0), and what the few different p of either group add over that, and what the
    terms of both add; no pair is ever summed over its language's terms.
    """
    groups = t.groups.filter("v > 0")
    n = groups.count()
    spread = t.cells.groupBy("lang", "place", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    # different p of all groups, dealt over salts as well as languages, beside the groups of their language
    salts = 1 if common.fits_broadcast(n, 96) else common.SALTS
    other = groups.select("lang", F.col("place").alias("other"), F.col("p0").alias("r0"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    alone = spread.withColumn("salt", F.pmod(F.xxhash64("p", "place"), F.lit(salts)).cast("int")).join(common.small_side(other, n * salts, 96), ["lang", "salt"]).filter("other <> place")
    p, p0, r0, m = (F.col(c) for c in ("p", "p0", "r0", "m"))
    as_g, as_h = m * (excess(p, r0) - excess(p0, r0)), m * (excess(r0, p) - excess(r0, p0))
    alone = alone.groupBy("lang", "place", "other").agg(F.sum(_exact(as_g)).alias("as_g"), F.sum(_exact(as_h)).alias("as_h"))
    one = alone.select("lang", F.col("place").alias("g"), F.col("other").alias("h"), F.col("as_g").alias("value")).unionByName(alone.select("lang", F.col("other").alias("g"), F.col("place").alias("h"), F.col("as_h").alias("value")))
    two = _both(t.cells).filter("g <> h")
    sums = one.unionByName(two.select("lang", F.col("g").cast("int").alias("g"), F.col("h").cast("int").alias("h"), "value")).groupBy("lang", "g", "h").agg(F.sum("value").alias("more"))
    left = t.groups.select("lang", F.col("place").alias("g"), "source", "v", "p0")
    right = t.groups.select("lang", F.col("place").alias("h"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    found = left.join(right, "lang").filter("g <> h").join(sums, ["lang", "g", "h"], "left")
    value = F.coalesce(_exact(F.col("v") * excess(F.col("p0"), F.col("q0"))), _exact(F.lit(0))) + F.coalesce("more", _exact(F.lit(0)))
    return found.select("lang", "source", "item", value.cast("long").alias("value"))


def _place(found: DataFrame, group: list[str], name: str, at_most: int) -> DataFrame:
    """Per group the digit (column name, ascending) that holds the wanted rank, from a histogram of digits.

    found: group, digit, need, m (rows of the digit; combined before the shuffle). Gives group, digit, need (what is
    still wanted of that digit's rows) and all (whether every row of it is). A group has at_most digits at most.
    """
    w = Window.partitionBy(*group)
    upto = F.sum("m").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    ranked = found.withColumns({"upto": upto, "whole": F.sum("m").over(w)}).withColumn("before", F.col("upto") - F.col("m"))
    wanted = F.least(F.col("need"), F.col("whole"))
    return ranked.filter((F.col("before") < wanted) & (F.col("upto") >= wanted)).select(*group, name, (wanted - F.col("before")).alias("need"), (F.col("upto") == wanted).alias("all"))


def _beside(rows: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    return rows.join(common.small_side(state, state.count(), 128), group)


def largest(rows: DataFrame, group: list[str], value: str, item: str, k: int) -> DataFrame:
    """The k rows of the largest values of each group, of equal values those of the least items by their UTF-8 bytes.

    Radix selection: for 15 bits at a time, from the highest, each group's rows are counted by digit among those that
    share the digits found so far, and the digit that holds the k-th value is the next one; a group is done early once
    all rows of a digit are wanted. Ties at the k-th value are then told apart two bytes of the item at a time, after the
    bytes that all of them share. Rows are counted where they lie; only counts of digits move. rows is staged; values
    are from 0 to 2^60 - 1. Rows equal in value and item count one each and are taken together.
    """
    bits = F.col(value)
    state = rows.select(*group).distinct().withColumns({"found": F.lit(0).cast("long"), "known": F.lit(0), "need": F.lit(k).cast("long"), "all": F.lit(False)})
    state = common.stage(state, "radix-state")
    for shift in range(VALUE_BITS - DIGIT, -1, -DIGIT):
        live = _beside(rows.select(*group, value), state.filter("not all").select(*group, "found", "need"), group)
        same = live.filter(F.shiftright(bits, shift + DIGIT) == F.col("found"))
        # descending, so digits are counted from the top
        digit = ((1 << DIGIT) - 1 - F.shiftright(bits, shift).bitwiseAND((1 << DIGIT) - 1)).cast("int")
        counts = same.groupBy(*group, "found", "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("m"))
        step = _place(counts, [*group, "found"], "digit", 1 << DIGIT)
        step = step.select(*group, (F.col("found") * (1 << DIGIT) + (1 << DIGIT) - 1 - F.col("digit")).alias("found"), F.lit(shift).alias("known"), "need", "all")
        state = common.stage(state.filter("all").unionByName(step.select(*state.columns)), "radix-state")
    marked = _beside(rows, state, group)
    high = F.expr(f"shiftright({value}, known)")
    over = marked.filter((high > F.col("found")) | (F.col("all") & (high == F.col("found")))).select(*rows.columns)
    ties = marked.filter(~F.col("all") & (high == F.col("found"))).select(*rows.columns, "need")
    taken = [over]
    text = F.encode(F.col(item), "UTF-8")
    live = common.stage(ties.withColumn("at", F.lit(0)), "radix-ties")
    while not live.isEmpty():
        ends = live.groupBy(*group).agg(F.min(text).alias("least"), F.max(text).alias("most"))
        alike = F.expr("aggregate(sequence(1, length(least)), named_struct('n', 0, 'go', true), (a, i) -> if(a.go and substring(least, i, 1) = substring(most, i, 1), named_struct('n', i, 'go', true), named_struct('n', a.n, 'go', false)), a -> a.n)")
        skip = ends.select(*group, F.when(F.length("least") == 0, 0).otherwise(alike).alias("at"), (F.col("least") == F.col("most")).alias("same"))
        pair = F.rpad(F.hex(F.expr(f"substring(encode({item}, 'UTF-8'), at + 1, 2)")), 4, "-")  # '-' sorts before all hex digits, as a shorter item does before a longer
        rows_at = _beside(live.drop("at"), skip, group).withColumn("digit", pair)
        counts = rows_at.groupBy(*group, "need", "same", "digit").agg(F.count(F.lit(1)).alias("m"))
        step = common.stage(_place(counts.drop("same"), group, "digit", 1 << 16), "radix-step").withColumnsRenamed({"digit": "limit", "need": "left"})
        told = common.stage(_beside(rows_at.drop("need"), step, group), "radix-told")
        done = F.col("all") | F.col("same")
        taken.append(told.filter((F.col("digit") < F.col("limit")) | ((F.col("digit") == F.col("limit")) & done)).select(*rows.columns))
        live = common.stage(told.filter(~done & (F.col("digit") == F.col("limit"))).select(*rows.columns, F.col("left").alias("need"), "at"), "radix-ties")
    found = taken[0]
    for more in taken[1:]:
        found = found.unionByName(more)
    return found


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks a group's other sources, part `term` its own terms.

    docs: text, lang, source. All arithmetic is exact. Null text, lang and source are read as ''; such a group is one like
    any other. Empty texts hold no term, yet their group occurs; a language without a kept term gives pairs of value 0.
    Very long texts are split a stretch at a time. Repeated rows are documents of their own; ties are told apart by the
    item's UTF-8 bytes. Other columns are ignored, whatever their names. No documents give no rows.
    """
    t = Tables(docs)
    own = t.cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    terms = largest(common.stage(own, "divergence-terms"), ["lang", "source"], "value", "item", TOP)
    both = pairs(t).select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.encode("item", "UTF-8")))
    return both.withColumn("rank", rank)
