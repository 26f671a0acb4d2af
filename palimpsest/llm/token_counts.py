"""Operator 2: token counts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm import common
from palimpsest.llm.tokenizing import encoder

LIMIT = 2048


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit; one row in, one row out, no shuffle.

    path: a tokenizers file whose pre-tokenizer drops white space, readable on every executor. A null or empty text
    has no bytes and no tokens. Very long texts are encoded in overlapping windows, in memory of a window's tokens. Other
    columns, null keys and repeated rows pass through; input columns of the three names are replaced. An empty table
    gives an empty result.
    """

    def make():
        use = encoder(path)

        def each(batch):
            texts = common.strings(batch)
            n = use.counts(texts)
            return [[len(t.encode("utf-8", "surrogatepass")) for t in texts], n, [x > limit for x in n]]

        return each

    return common.add_columns(docs, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make)
