"""Vector arithmetic on ARRAY columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine within -1 and 1; 0 where lengths differ, a norm is zero or a side is null (MATH-1).

    Norms that the caller has at hand save working them out for every pair.
    """
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    ok = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))).otherwise(F.lit(0.0))


def index_score(cos: Column) -> Column:
    """Cosine on the 0 to 1 scale of a vector index; from_index_score undoes it (SORT-2)."""
    return (1 + cos) / 2


def from_index_score(score: Column) -> Column:
    return 2 * score - 1
