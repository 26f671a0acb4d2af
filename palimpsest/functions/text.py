"""Text identity: folding, squashing, bigram overlap, guards and small renderings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME_PUNCTUATION = "-_./ "


@F.pandas_udf(T.StringType())
def fold_for_identity(s: pd.Series) -> pd.Series:
    """NFKC, lower case, sharp s and final sigma levelled, NFKC again (STR-1): Spark has no Unicode normaliser."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).lower().replace("ß", "ss").replace("ς", "σ")))


@F.pandas_udf(T.StringType())
def fold_name(s: pd.Series) -> pd.Series:
    """fold_for_identity, trimmed, runs of white space as one blank (STR-2)."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).lower().replace("ß", "ss").replace("ς", "σ")).split()))


def fold_ascii(c: Column) -> Column:
    """What fold_name gives for ASCII, without Python."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def squash(c: Column) -> Column:
    """A name without joining marks and blanks (STR-3)."""
    return F.translate(c, NAME_PUNCTUATION, "")


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, 2))))


def bigram_overlap(a: Column, b: Column, least: int = 4) -> Column:
    """Shared bigrams over those of the smaller side; 0 for names shorter than least (STR-4)."""
    x, y = bigrams(a), bigrams(b)
    return F.when((F.length(a) >= least) & (F.length(b) >= least), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def digit_runs(c: Column) -> Column:
    return F.sort_array(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))


def same_digits(a: Column, b: Column) -> Column:
    """Names that differ in their numbers are not the same thing (STR-5)."""
    return digit_runs(a) == digit_runs(b)


def name_relation(a: Column, b: Column, overlap: float = 0.85) -> Column:
    """fold, squash, bigram or none (STR-6); numbers must agree for the last two."""
    x, y = fold_ascii(a), fold_ascii(b)
    return (
        F.when(x == y, F.lit("fold"))
        .when(squash(x) == squash(y), F.lit("squash"))
        .when(same_digits(x, y) & (bigram_overlap(squash(x), squash(y)) >= overlap), F.lit("bigram"))
        .otherwise(F.lit("none"))
    )


def aspect(c: Column, longest: int = 64) -> Column:
    """The folded aspect of a claim, null when it is empty or too long (STR-7)."""
    f = fold_ascii(c)
    return F.when((F.length(f) > 0) & (F.length(f) <= longest), f)


def claim_text(c: Column) -> Column:
    """Lower case, one blank between words, no closing marks (STR-8)."""
    return F.regexp_replace(fold_ascii(c), r"[.!?;,\s]+$", "")


def query_terms(c: Column) -> Column:
    """Different lower-case terms of letters and digits, in order (STR-9)."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != ""))


def clip(c: Column, longest: int) -> Column:
    """Up to longest code points, cut at a word where one ends, with an ellipsis (STR-10)."""
    head = F.substring(c, 1, longest - 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.rtrim(F.when(word != "", word).otherwise(head)), F.lit("…")))


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded up (STR-11)."""
    return F.ceil(F.length(c) / 4).cast("long")


def cluster_key(c: Column) -> Column:
    """Hash of the first sixteen lower-case code points (STR-12)."""
    return F.sha2(F.substring(F.lower(F.trim(c)), 1, 16).cast("binary"), 256)


def identifier_shape(c: Column) -> Column:
    """sha, uuid, agent_id, path or null (FLT-11), by the whole trimmed name in any case.

    Decay by shape is for good, so only whole digests count (40 or 64 hex digits), and a path has two separators at least
    and no white space. The agents' prefix is a fixed value.
    """
    x = F.regexp_replace(c, r"^\s+|\s+$", "")
    low = F.lower(x)
    separators = F.length(x) - F.length(F.translate(x, "/\\", ""))
    return (
        F.when(low.rlike(r"^[0-9a-f]+$") & F.length(low).isin(40, 64), F.lit("sha"))
        .when(low.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit("uuid"))
        .when(F.startswith(low, F.lit("code-na")) & F.substring(low, 8, 1 << 20).rlike(r"^[0-9a-f]{6,}$"), F.lit("agent_id"))
        .when((separators >= 2) & ~x.rlike(r"\s"), F.lit("path"))
    )
