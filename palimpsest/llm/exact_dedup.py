"""Operator 1: exact duplicates by progressive refinement (length, then prefix hash, then full hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64
_WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _WHITE, "")


def refine(docs: DataFrame, every_digest: bool = True) -> DataFrame:
    """Finds the groups of equal normalised texts; one output row for each input row.

    Length and prefix hash of every row are grouped first (counts only, combined before the shuffle). Only rows
    whose (length, prefix) occurs again get the hash of their whole text, unless every_digest asks for all.
    Texts never go through a shuffle: the keys that occur again go to the tasks as a bitmap of fixed size, whatever
    their number, and a row that it lets through wrongly is hashed once more than needed and found to be single.

    Nulls: a null text is an empty one; a null doc_id sorts last. Repeated rows (doc_id and text alike) are members
    of one group like others, and exactly one row of a group has kept = true. Very long texts are normalised and hashed whole
    where they are read. An empty table gives an empty result.
    Other columns are ignored. Output: doc_id, keep_id, group_size, kept, text_sha256 (without every_digest null for
    single rows).
    """
    return _refined(docs, every_digest).drop("ident")


def identity(doc_id: Column, text: Column) -> Column:
    """A row's doc_id and text as 128 bits; nulls differ from everything else."""
    null = F.concat_ws(",", doc_id.isNull().cast("string"), text.isNull().cast("string"))
    return F.struct(F.xxhash64(doc_id, text, null).alias("a"), F.xxhash64(F.lit(1), text, null, doc_id).alias("b"))


def _refined(docs: DataFrame, every_digest: bool) -> DataFrame:
    base = docs.select(F.col("doc_id"), F.col("text")).select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("norm"), F.monotonically_increasing_id().alias("row_no"),
        identity(F.col("doc_id"), F.col("text")).alias("ident"),
    )
    keyed = base.withColumns({"norm_len": F.length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, PREFIX))})
    # length first: a length that occurs once ends the matter; the prefix hash refines the rest
    by_prefix = keyed.groupBy("norm_len", "prefix").agg(F.count(F.lit(1)).alias("n"))
    again = common.stage(
        by_prefix.join(by_prefix.groupBy("norm_len").agg(F.sum("n").alias("of_len")).filter("of_len > 1").select("norm_len"), "norm_len", "left_semi").filter("n > 1").select("norm_len", "prefix"),
        "dedup-keys",
    )
    # rows whose key occurs again, and the few others that the keys' sieve lets through, are hashed whole where they are read
    marked = common.sifted(keyed, F.xxhash64("norm_len", "prefix"), again, F.xxhash64("norm_len", "prefix"), "again")
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    rows = common.stage(
        marked.select("doc_id", "points", "row_no", "again", "ident", (digest if every_digest else F.when(F.col("again"), digest)).alias("text_sha256")),
        "dedup-digests",
    )
    # the best of a group in two steps, over salts and then over the group, so that no task gets a hot group's rows
    salted = rows.filter("again").withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(common.SALTS)))
    rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_no").alias("r"))
    part = salted.groupBy("text_sha256", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("best"))
    whole = part.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    best = part.select("text_sha256", "salt").join(whole.filter("group_size > 1"), "text_sha256")
    grouped = salted.join(best, ["text_sha256", "salt"], "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.r") == F.col("row_no"), F.lit(True)).alias("kept"),
        (F.col("text_sha256") if every_digest else F.when(F.col("group_size") > 1, F.col("text_sha256"))).alias("text_sha256"),
        "ident",
    )
    single = rows.filter("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "ident")
    return single.unionByName(grouped)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay.

    Rows are named by doc_id and text together, so rows without a doc_id and several texts of one doc_id are told
    apart. Of rows alike in both, one stays, whatever their other columns hold.
    """
    found = _refined(docs, every_digest=False).filter("group_size > 1")
    counted = found.groupBy("ident").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    named = common.stage(counted.select(F.col("ident.a").alias("a"), F.col("ident.b").alias("b"), "n", "kept"), "dedup-idents")
    return without_copies(docs, named)


def without_copies(docs: DataFrame, named: DataFrame) -> DataFrame:
    """docs without the rows that named gives as not kept, and with one of those that are kept.

    named, staged: a, b (a row's identity), n (rows of that identity), kept.
    """
    gone, repeats = named.filter("not kept").select("a", "b"), named.filter("kept and n > 1").select("a", "b")
    n_gone, n_repeats = gone.count(), repeats.count()
    ident = identity(F.col("doc_id"), F.col("text"))
    out = _without(docs, ident, gone, n_gone)
    if n_repeats:
        given = out.columns
        again = out.withColumn("palimpsest_a", ident["a"]).withColumn("palimpsest_b", ident["b"])
        side = common.small_side(repeats.toDF("palimpsest_a", "palimpsest_b"), n_repeats, 24)
        one = again.join(side, ["palimpsest_a", "palimpsest_b"], "left_semi").dropDuplicates(["palimpsest_a", "palimpsest_b"]).select(*given)
        out = _without(out, ident, repeats, n_repeats).unionByName(one)
    return out


def _without(docs: DataFrame, ident: Column, gone: DataFrame, n: int) -> DataFrame:
    if n == 0:
        return docs
    if not common.fits_broadcast(n, 24):
        return common.anti_join(docs, gone, [ident["a"], ident["b"]], ["a", "b"])
    given = [F.col(f"`{c}`") for c in docs.columns]
    wide = docs.withColumns({"palimpsest_a": ident["a"], "palimpsest_b": ident["b"]})
    return wide.join(F.broadcast(gone.toDF("palimpsest_a", "palimpsest_b")), ["palimpsest_a", "palimpsest_b"], "left_anti").select(*given)
