"""Operator 11: how five filters interact, worked out from a histogram of failure masks."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

#: A filter's bit in a mask is its place here.
FILTERS = "ABCDE"
#: Texts with fewer words fail A.
LEAST_WORDS = 200
#: Texts of which fewer percent of the words are distinct fail B.
LEAST_DISTINCT = 50
#: Texts of which more percent of the code points are A-Z fail C.
MOST_CAPITALS = 3
#: Any of these fails D.
MARKS = "[#$%&*|]"
_CELLS = 1 << len(FILTERS)
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The maximal runs of other characters than blanks, in order, repeats included."""
    return F.array_remove(F.split(F.translate(text, "\t\n\v\f\r", "     "), " ", -1), "")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    n, points = F.size(words(text)), F.length(text)
    fails = [
        n < LEAST_WORDS,
        F.size(F.array_distinct(words(text))) * 100 < n * LEAST_DISTINCT,
        (points - F.length(F.translate(text, _CAPITALS, ""))) * 100 > points * MOST_CAPITALS,
        text.rlike(MARKS),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those labelled good and those labelled toxic, by lang and failure mask.

    Texts are read once and never move: what is staged are doc_id, part, mask and the text's SHA-256 with its length,
    which stands for the text. The first document of each text is found by a grouping that combines before the shuffle,
    so a text that a third of the rows share is one row of each task; rows then look up whether they are such a first
    one by doc_id and digest, a key that no two documents share.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.length("text").alias("points"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = common.stage(rows, "filter-masks")
    first = rows.filter("doc_id is not null").groupBy("digest", "points").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    found = rows.join(first, ["doc_id", "digest", "points"], "left").join(marks, "doc_id", "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(later, F.lit(1 << FILTERS.index("E"))).otherwise(0)
    return found.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _steps() -> list[dict[str, str | int]]:
    """All orders' steps: the order, the step, its bit, the bits of earlier steps."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for i, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            found.append({"filter_order": "".join(order), "step": i + 1, "bit": bit, "before": before})
            before |= bit
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. All counts come from the 32 cells of a part: an order's
    step removes the cells that have its bit and none of the bits before. Of a document that fails k filters each is the
    first in 120 / k of the orders, which sums up shapley without going through them.

    Null text counts as empty, null lang as part ''. A null doc_id comes neither before nor after another, has no label
    and doesn't fail E; rows that repeat doc_id and text don't either, as no smaller doc_id has the text. Of several
    label rows of a doc_id any may give the mark. Empty texts fail A only, and E where an earlier one is empty too. Very
    long texts are split into words where they are read, nothing else. Other columns are ignored, whatever their names.
    No documents give no rows.
    """
    lists = {name: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)) for m in range(_CELLS)]).alias(name) for name in ("n", "good", "toxic")}
    by_part = cells(docs, labels).groupBy("part").agg(*lists.values())
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = by_part.withColumn("s", F.explode(steps)).select("part", "n", "good", "toxic", "s.*")

    def total(of: str, keep: object) -> Column:
        """The sum of a list over the masks that keep(mask) takes."""
        return F.aggregate(F.transform(F.col(of), lambda x, m: F.when(keep(m), x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)  # type: ignore[operator]

    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    orders = factorial(len(FILTERS))
    shares = F.array(*[F.lit(orders // max(1, m.bit_count())).cast("long") for m in range(_CELLS)])
    weighed = F.transform(F.arrays_zip(F.col("n"), shares.alias("share")), lambda x, m: F.when(m.bitwiseAND(bit) != 0, x["n"] * x["share"]).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.element_at("n", bit + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
