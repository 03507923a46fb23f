"""Whitened principal components of integer-scaled vectors, from exact polarised sums.

An entry ``c`` becomes the whole number ``x = floor(64 * c) + 1000000``. The covariance of two dimensions comes from
variances alone: ``2 cov(i, j) = var(i + j) - var(i) - var(j)``. So one aggregate sums the squares of the
centred values of every dimension and of every sum of two dimensions. All of it is whole numbers: values are
centred on the whole part ``m`` of their mean, ``y = x - m``, and with ``r = S - n * m`` the centred square is
``sum((n*x - S)^2) = n * (n * sum(y^2) - r^2)`` exactly. What reaches the driver is one number per pair of
dimensions, whose count depends on the width of the vectors and never on the rows; ``eigh`` runs there.

The table is read four times (sums, squares, check, output), without a shuffle of vectors.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Repeated rows count as often as
they occur and are each returned. Vectors of uneven width are an error, as are entries beyond 2**40. An empty table
gives an empty result. Components without variance (equal vectors, fewer rows than dimensions) have no unit
variance to scale to and are left out. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
#: Entries up to this size are scaled exactly.
LARGEST = 2.0**40
#: Values of a slice of rows that are worked on at once.
CELLS = 1 << 22
SUM = T.DecimalType(38, 0)


@dataclass(frozen=True)
class Whitening:
    """Exact sums of the fit list and what follows from them; components by falling variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    column = F.col(f"`{vector}`")
    finite = F.forall(
        column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    return df.where(column.isNotNull() & (F.size(column) > 0) & finite)


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """The whole numbers of a batch of vectors, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) != len(column) * width:
        raise ValueError("vectors differ in length")
    if len(values) and not (column.value_lengths().to_numpy(zero_copy_only=False) == width).all():
        raise ValueError("vectors differ in length")
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"vectors hold entries beyond {LARGEST:.0f}")
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, width) + SHIFT


def slices(batches: Iterator[pa.RecordBatch], width: int, columns: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that ``columns`` values a row stay within ``CELLS``, with their whole numbers."""
    step = max(1, CELLS // max(columns, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, scaled(part.column("vector"), width)


def exact_sum(values: np.ndarray) -> np.ndarray:
    """Column sums as Python integers, whatever their size."""
    if not len(values):
        return np.zeros(values.shape[1], dtype=object)
    if int(np.abs(values).max()) * len(values) < 2**62:
        return values.sum(axis=0).astype(object)
    return values.astype(object).sum(axis=0)


def exact_squares(values: np.ndarray) -> np.ndarray:
    """Column sums of squares as Python integers, whatever their size."""
    if not len(values):
        return np.zeros(values.shape[1], dtype=object)
    if int(np.abs(values).max()) ** 2 * len(values) < 2**62:
        return np.einsum("ij,ij->j", values, values).astype(object)
    wide = values.astype(object)
    return (wide * wide).sum(axis=0)


def _numbered_sums(totals: np.ndarray, first: int = 0) -> pa.RecordBatch:
    places = pa.array(np.arange(first, first + len(totals)), pa.int32())
    return pa.record_batch([places, pa.array([int(t) for t in totals], pa.decimal128(38, 0))], names=["place", "total"])


def _totals(df: DataFrame, function) -> dict[int, int]:
    """Sums by place over all partitions."""
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("total", SUM)])
    summed = df.mapInArrow(function, schema).groupBy("place").agg(F.sum("total").alias("total"))
    return {row["place"]: int(row["total"]) for row in summed.collect()}


def fit(df: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all usable vectors; None without any."""
    vectors = usable(df, vector).select(F.col(f"`{vector}`").alias("vector"))
    first = vectors.select(F.size("vector").alias("width")).first()
    if first is None:
        return None
    width = first["width"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(width + 1, dtype=object)
        for _, x in slices(batches, width, width):
            totals[:width] += exact_sum(x)
            totals[width] += len(x)
        yield _numbered_sums(totals)

    found = _totals(vectors, sums)
    n, total = found[width], [found[i] for i in range(width)]
    middle = np.array([t // n for t in total], dtype=np.int64)
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(width + len(pairs), dtype=object)
        for _, x in slices(batches, width, width):
            y = x - middle
            totals[:width] += exact_squares(y)
            at = width
            for i in range(width - 1):
                totals[at : at + width - 1 - i] += exact_squares(y[:, i : i + 1] + y[:, i + 1 :])
                at += width - 1 - i
        yield _numbered_sums(totals)

    found = _totals(vectors, squares)
    rest = [total[i] - n * int(middle[i]) for i in range(width)]

    def centred(squares: int, rest: int) -> int:
        """``n`` times the sum of squares about the mean."""
        return n * squares - rest * rest

    own = [centred(found[i], rest[i]) for i in range(width)]
    covariance = np.empty((width, width))
    for i in range(width):
        covariance[i, i] = own[i] / n**2
    for at, (i, j) in enumerate(pairs, start=width):
        both = centred(found[at], rest[i] + rest[j])
        covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n**2)
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    # Below this a variance is rounding.
    order = order[values[order] > 16 * width * np.finfo(np.float64).eps * max(values.max(), 0.0)]
    trace = sum(own) / n**2
    return Whitening(
        n, tuple(total), np.ascontiguousarray(vectors_[:, order]), values[order], values[order] / (trace or 1.0)
    )


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """``n * x - S``, exact: as machine integers where they suffice, else as Python ones."""
    sums = np.array(model.sums, dtype=object)
    span = max(int(np.abs(x).max()) * model.n, max(abs(s) for s in model.sums)) if x.size else 0
    if span < 2**61:
        return x * np.int64(model.n) - sums.astype(np.int64)
    return x.astype(object) * model.n - sums


def _whitened(centred: np.ndarray, model: Whitening) -> np.ndarray:
    return (centred.astype(np.float64) / model.n) @ model.components / np.sqrt(model.variances)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest distance of an entry of the whitened vectors' covariance from the identity, as measured.

    The whitened vectors are centred: their sum is that of exactly centred numbers.
    """
    width, kept = len(model.sums), len(model.variances)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, kept))
        for _, x in slices(batches, width, width):
            w = _whitened(_centred(x, model), model)
            total += w.T @ w
        yield pa.record_batch([pa.array(np.arange(kept * kept), pa.int32()), pa.array(total.ravel())], names=["place", "total"])

    vectors = usable(df, vector).select(F.col(f"`{vector}`").alias("vector"))
    summed = vectors.mapInArrow(products, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    covariance = np.zeros(kept * kept)
    for row in summed.collect():
        covariance[row["place"]] = row["total"] / model.n
    return float(np.abs(covariance - np.eye(kept).ravel()).max(initial=0.0))


def whiten(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum over dimensions of ``(n*x - S)^2``, a whole number of up to 38 digits: it grows with the
    square of the number of rows.
    """
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType)]
        + [
            T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
            T.StructField("deviation", SUM), T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
        ]
    )
    model = fit(df, vector, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    width, kept = len(model.sums), len(model.variances)
    error = identity_error(df, model, vector)
    names = schema.names

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in slices(batches, width, max(width, 8 * kept)):
            centred = _centred(x, model)
            if centred.dtype == object or (centred.size and int(np.abs(centred).max()) ** 2 * width >= 2**63):
                wide = centred.astype(object)
                deviation = pa.array([int(d) for d in (wide * wide).sum(axis=1)], pa.decimal128(38, 0))
            else:
                deviation = pa.array(np.einsum("ij,ij->i", centred, centred)).cast(pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(len(x)), kept))
            yield pa.record_batch(
                [
                    part.column("key").take(row),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(row), model.n, dtype=np.int64)),
                    deviation.take(row),
                    pa.array(_whitened(centred, model).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(row), error)),
                ],
                names=names,
            )

    vectors = usable(df, vector).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    return vectors.mapInArrow(project, schema)
