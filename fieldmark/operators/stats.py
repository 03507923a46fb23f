"""Robust statistics of the distances between different identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators.neighbors import nearest, row_medians
from fieldmark.operators.ranking import exact_quantiles
from fieldmark.sources.staging import stage


def null_distances(
    rows: DataFrame,
    ks: Sequence[int] = (1,),
    *,
    key: str = "image_id",
    vector: str = "embeddings",
    label: str = "identity",
    row_count: int | None = None,
) -> DataFrame:
    """How far each row is from the rows of other identities.

    Per row and k: the median squared distance over its k nearest rows of any
    other identity, as (key, num_neighbors, distance). Written once, because
    every statistic below reads it more than once.
    """
    row_count = rows.count() if row_count is None else row_count
    found = nearest(
        rows, rows, max(ks), key=key, vector=vector, label=label,
        other_label_only=True, query_rows=row_count, gallery_rows=row_count,
    )
    return stage(row_medians(found, ks, key))


def distance_summaries(
    distances: DataFrame,
    value: str = "distance",
    by: str | None = None,
) -> DataFrame:
    """min, max, mean, population deviation, quartiles, IQR and MAD.

    One row, or one per value of ``by`` (few values, such as neighbour counts).
    The MAD needs the median first. A row of statistics per group is all that
    is computed on the driver.
    """
    groups = [by] if by else []
    moments = distances.groupBy(*groups).agg(
        F.min(value).alias("min_distance"),
        F.max(value).alias("max_distance"),
        F.avg(value).alias("mean_distance"),
        F.stddev_pop(value).alias("std_distance"),
    )

    def rows(df: DataFrame) -> dict:
        return {(r[by] if by else None): r.asDict() for r in df.collect()}

    statistics = rows(moments)
    quartiles = rows(exact_quantiles(distances, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=by))
    nothing = {"q1": None, "median": None, "q3": None}
    medians = {group: quartiles.get(group, nothing)["median"] for group in statistics}
    # One branch per group.
    median = F.lit(None).cast("double")
    for group, centre in medians.items():
        mine = F.col(by).eqNullSafe(F.lit(group)) if by else F.lit(True)
        median = F.when(mine, F.lit(centre)).otherwise(median)
    gaps = distances.select(*groups, F.abs(F.col(value) - median).alias("_gap"))
    mads = rows(exact_quantiles(gaps, "_gap", {"mad": 0.5}, by=by))
    columns = [
        *groups, "min_distance", "max_distance", "mean_distance", "std_distance",
        "iqr", "q1", "q3", "median", "mad",
    ]
    table = []
    for group, row in statistics.items():
        row = row | quartiles.get(group, nothing) | {"mad": mads.get(group, {"mad": None})["mad"]}
        row["iqr"] = None if row["median"] is None else row["q3"] - row["q1"]
        table.append(tuple(row[c] for c in columns))
    kinds = [T.StructField(c, distances.schema[c].dataType) for c in groups]
    kinds += [T.StructField(c, T.DoubleType()) for c in columns[len(groups) :]]
    return distances.sparkSession.createDataFrame(table, T.StructType(kinds))


def distance_summary(distances: DataFrame, value: str = "distance") -> DataFrame:
    """One row with the nine statistics of ``distance_summaries``."""
    return distance_summaries(distances, value)


def median_and_mad(
    distances: DataFrame,
    value: str = "distance",
    by: str | None = "num_neighbors",
) -> DataFrame:
    """Median and median absolute deviation (unscaled), one row per ``by``."""
    kept = [by, "median", "mad"] if by else ["median", "mad"]
    return distance_summaries(distances, value, by).select(*kept)
