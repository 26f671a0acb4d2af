"""Content hashes and derived ids."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with keys sorted at every level and without white space (JSON-1); null where it doesn't parse."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)


def content_hash(c: Column) -> Column:
    """SHA-256 of a string as JSON, quotes and escapes included (JSON-2)."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.sha2(quoted.cast("binary"), 256)


def vector_input_hash(c: Column) -> Column:
    """SHA-256 of the raw text (JSON-3)."""
    return F.sha2(c.cast("binary"), 256)


def derived_id(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them (JSON-4)."""
    return F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]).cast("binary"), 256)


def coverage_key(ids: Column) -> Column:
    """A key of a set of ids that doesn't depend on their order (JSON-7)."""
    return F.sha2(F.concat_ws(",", F.sort_array(F.array_distinct(ids)).cast("array<string>")).cast("binary"), 256)


_MARKS = re.compile(r'[{}\[\]]|"(?:[^"\\]++|\\(?:.|\Z))*+(?:"|\Z)', re.S)


def json_spans(text: str) -> list[str]:
    """The outermost runs of braces or brackets in a text, in order (JSON-8).

    Strings are passed over whole, with their escapes, so what stands in them neither opens nor closes; a string that
    isn't closed reaches to the end. A closing mark without an opening one is ordinary text, one run closes what any
    mark has opened, and a run that stays open is none.
    """
    found, depth, start = [], 0, 0
    for m in _MARKS.finditer(text):
        c = text[m.start()]
        if c in "{[":
            if not depth:
                start = m.start()
            depth += 1
        elif c in "}]" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : m.end()])
    return found


@F.pandas_udf(T.StringType())
def last_json(s: pd.Series) -> pd.Series:
    """The last run of a text that is a whole JSON value (JSON-8); null if none is."""

    def one(x: str | None) -> str | None:
        for span in reversed(json_spans(x or "")):
            try:
                json.loads(span)
            except ValueError:
                continue
            return span
        return None

    return s.map(one)
