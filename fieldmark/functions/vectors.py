"""Vector expressions on ``array<float>`` and ``array<double>`` columns.

A value that a lambda needs for every element (a norm, a row mean) is paired
with the elements by ``zip_with`` instead of being named inside the lambda,
where Spark would evaluate it again for each element.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_float32(v: str | Column) -> Column:
    return _col(v).cast("array<float>")


def fold_columns(df: DataFrame, prefix: str, out: str = "embeddings") -> DataFrame:
    """Replace the columns named ``prefix*`` by one float array, in order."""
    wide = [c for c in df.columns if c.startswith(prefix)]
    if not wide:
        raise ValueError(f"no column starts with {prefix!r}")
    rest = [F.col(c) for c in df.columns if c not in wide]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in wide]).alias(out))


def _sum_squares(v: Column) -> Column:
    return F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def squared_l2(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance in double precision."""
    gaps = F.zip_with(
        _col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double")
    )
    return _sum_squares(gaps)


def l2(a: str | Column, b: str | Column, eps: float = 0.0) -> Column:
    """Euclidean distance; ``eps`` is added to every difference."""
    gaps = F.zip_with(
        _col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double") + F.lit(eps)
    )
    return F.sqrt(_sum_squares(gaps))


def l2_normalize(v: str | Column) -> Column:
    """Unit-length vector; a norm below ``NORM_FLOOR`` is replaced by it."""
    v = _col(v)
    norm = F.greatest(F.sqrt(_sum_squares(v)), F.lit(NORM_FLOOR))
    return F.zip_with(
        v, F.array_repeat(norm, F.size(v)), lambda x, n: x.cast("double") / n
    )


def prefix(v: str | Column, dims: int) -> Column:
    return F.slice(_col(v), 1, dims)


def first_token(tokens: str | Column) -> Column:
    return F.try_element_at(_col(tokens), F.lit(1))


def mean_of_rest(tokens: str | Column) -> Column:
    """Positional mean over every token but the first; NULL without any."""
    tokens = _col(tokens)
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    width = F.size(first_token(tokens))
    total = F.aggregate(
        rest,
        F.array_repeat(F.lit(0.0), width),
        lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y.cast("double")),
    )
    mean = F.zip_with(
        total, F.array_repeat(F.size(rest), width), lambda x, n: x / n
    )
    return F.when(F.size(tokens) > 1, mean)


def centroids(
    df: DataFrame, key: str, vector: str = "embeddings", out: str = "centroid"
) -> DataFrame:
    """Mean vector per key.

    ``Summarizer`` keeps one running vector per key and merges partial results
    before the shuffle, so a key with a third of all rows costs no more than
    any other.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return (
        df.where(F.col(vector).isNotNull())
        .groupBy(key)
        .agg(vector_to_array(mean).alias(out))
    )
