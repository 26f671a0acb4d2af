"""What the corpus operators share: reading, staging, size-checked broadcasts and Arrow mapping."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.staging import new_path, stage  # noqa: F401  (the operators stage their tables)

#: Largest table, in bytes by row count times row width, that an operator broadcasts.
BROADCAST_BYTES = 32 << 20
#: Salts over which the rows of one hot key are dealt.
SALTS = 64
#: Text bytes that an Arrow task turns into Python strings at a time, about.
PIECE_BYTES = 1 << 20
#: Words of 64 bits in a sieve.
SIEVE_WORDS = 1 << 19
_BLANK = re.compile(r"\s")


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps between its tasks: the tables of one operator at a time, so that a worker which serves several, as in
    a pipeline, never has more than the largest."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Frees what an earlier operator's tasks have kept in this worker."""
    _HELD.clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_name() -> str:
    return uuid.uuid4().hex


def text_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def fits_broadcast(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether so many rows stay within the limit as a hashed relation, where a row takes 64 bytes at least."""
    return rows * max(64, row_bytes) <= limit


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add, in any letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def pieces(batch: pa.RecordBatch, rows: int = 512, text: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and about most bytes (PIECE_BYTES) of text at most, so that only a slice's texts
    are Python strings at a time. A longer text is a slice of its own."""
    most = most or PIECE_BYTES
    if text not in batch.schema.names:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(size[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(size, before + most, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def stretches(text: str, longest: int, lead: int, inside: Callable[[str], bool], white: re.Pattern[str] = _BLANK) -> Iterator[tuple[str, int, bool]]:
    """A text in stretches of twice so many code points at most, as (stretch, before, goes_on).

    It is cut before white space where there is some, else anywhere. Where a cut parts a run of code points that are
    inside one, goes_on is true and the next stretch has up to lead of the run's last ones in front, before of them, as
    context.
    """
    at = before = 0
    while len(text) - at > longest:
        blank = white.search(text, at + longest, at + 2 * longest)
        end = blank.start() if blank else min(len(text), at + 2 * longest)
        if end == len(text):
            break
        goes_on = blank is None and inside(text[end - 1]) and inside(text[end])
        yield text[at - before : end], before, goes_on
        at, before = end, 0
        while goes_on and before < lead and at - before > 0 and inside(text[at - before - 1]):
            before += 1
    yield text[at - before :], before, False


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column with nulls as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def add_columns(docs: DataFrame, names_types: list[tuple[str, T.DataType]], make: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = 512) -> DataFrame:
    """docs with further columns that make()(batch) gives as arrays, in order. Input columns of those names are replaced.

    make runs once in each task, so that it can set up what all batches use.
    """
    names = [n for n, _ in names_types]
    docs = without(docs, names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in names_types]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for whole in batches:
            for b in pieces(whole, rows):
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) if not isinstance(x, pa.Array) else x for x in each(b)]], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of the keys' hashes, (sieve_word, sieve_bits): SIEVE_WORDS rows at most, however many keys there are."""
    h = F.pmod(F.xxhash64(key), F.lit(SIEVE_WORDS * 64))
    return keys.groupBy(F.shiftright(h, 6).alias("sieve_word")).agg(F.bit_or(_bit(h)).alias("sieve_bits"))


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def sifted(df: DataFrame, key: Column, keys: DataFrame, of: Column, name: str = "maybe") -> DataFrame:
    """df with a column that is true wherever key is one of keys (of), and hardly anywhere else; no shuffle of df.

    The bitmap of the keys is broadcast: it has a fixed size. The more keys it holds, the more others pass, up to all
    beyond some 30 million keys; what passes wrongly is for the caller to part by an exact means.
    """
    h = F.pmod(F.xxhash64(key), F.lit(SIEVE_WORDS * 64))
    bits = F.broadcast(sieve(keys, of))
    marked = df.withColumn("sieve_word", F.shiftright(h, 6)).join(bits, "sieve_word", "left")
    return marked.withColumn(name, F.coalesce(F.col("sieve_bits").bitwiseAND(_bit(h)) != 0, F.lit(False))).drop("sieve_word", "sieve_bits")


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in ids (one column, staged).

    ids are broadcast within the bound. Beyond it only rows that a sieve of the ids lets through are shuffled and
    joined exactly; all others stay where they are.
    """
    n = ids.count()
    if n == 0:
        return docs
    if fits_broadcast(n, 16):
        return docs.join(F.broadcast(ids), key, "left_anti")
    return anti_join(docs, ids, [F.col(key)], [key])


def anti_join(docs: DataFrame, gone: DataFrame, key: list[Column], names: list[str]) -> DataFrame:
    """docs without the rows whose key (columns of docs) is in gone (columns names): rows outside a sieve never move."""
    given = docs.columns
    wide = docs.withColumns({f"palimpsest_{i}": k for i, k in enumerate(key)})
    own = [f"palimpsest_{i}" for i in range(len(key))]
    marked = sifted(wide, F.xxhash64(*own), gone, F.xxhash64(*names), "palimpsest_maybe")
    right = gone.select(*[F.col(n).alias(o) for n, o in zip(names, own, strict=True)]).hint("merge")
    kept = marked.filter("palimpsest_maybe").join(right, own, "left_anti")
    return marked.filter("not palimpsest_maybe").unionByName(kept).select(*[F.col(f"`{c}`") for c in given])
