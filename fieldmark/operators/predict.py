"""Labels from neighbours: gates, votes and prediction counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import NEW_INDIVIDUAL, within_gate

Number = float | Column


def _lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vote(
    neighbors: DataFrame,
    accepted: Column | None = None,
    *,
    key: str = "image_id",
    label: str = "neighbor_identity",
    new_label: str = NEW_INDIVIDUAL,
    out: str = "prediction",
) -> DataFrame:
    """Most frequent label among the accepted neighbours of each row.

    Ties go to the label met first, in rank order. Rows with no accepted
    neighbour get ``new_label``.
    """
    accepted = F.lit(True) if accepted is None else F.coalesce(accepted, F.lit(False))
    tally = (
        neighbors.select(key, label, "rank", accepted.alias("_ok"))
        .groupBy(key, label)
        .agg(F.count_if("_ok").alias("_votes"), F.min(F.when(F.col("_ok"), F.col("rank"))).alias("_first"))
    )
    choice = F.max_by(
        F.col(label), F.when(F.col("_votes") > 0, F.struct("_votes", -F.col("_first")))
    )
    return tally.groupBy(key).agg(F.coalesce(choice, F.lit(new_label)).alias(out))


def predict_gated(
    neighbors: DataFrame,
    median: Number,
    mad: Number,
    threshold: Number,
    *,
    key: str = "image_id",
    new_label: str = NEW_INDIVIDUAL,
) -> DataFrame:
    """Vote among neighbours whose modified z-score is below ``threshold``.

    The statistics may be numbers or one-row scalar columns.
    """
    gate = within_gate(F.col("distance"), _lit(median), _lit(mad), _lit(threshold))
    return vote(neighbors, gate, key=key, new_label=new_label)


def predict_by_distance(
    neighbors: DataFrame,
    threshold: Number,
    *,
    key: str = "image_id",
    new_label: str = NEW_INDIVIDUAL,
) -> DataFrame:
    """Label of the nearest row, or ``new_label`` beyond ``threshold``."""
    far = F.col("distance") > _lit(threshold)
    return neighbors.where(F.col("rank") == 1).select(
        key,
        F.when(far, F.lit(new_label)).otherwise(F.col("neighbor_identity")).alias("prediction"),
    )


def predict_closed_set(neighbors: DataFrame, key: str = "image_id") -> DataFrame:
    """Label of the nearest row, without rejection."""
    return neighbors.where(F.col("rank") == 1).select(
        key, F.col("neighbor_identity").alias("prediction")
    )


def complete(
    predictions: DataFrame,
    queries: DataFrame,
    *,
    key: str = "image_id",
    new_label: str = NEW_INDIVIDUAL,
    out: str = "prediction",
) -> DataFrame:
    """One prediction per query row: rows without any neighbour get ``new_label``.

    A row has no neighbour if its vector is NULL or the gallery is empty.
    """
    found = predictions.select(key, out)
    return queries.select(key).join(found, key, "left").select(
        key, F.coalesce(out, F.lit(new_label)).alias(out)
    )


def prediction_counts(
    predictions: DataFrame, prediction: str = "prediction", new_label: str = NEW_INDIVIDUAL
) -> DataFrame:
    """One row: how many rows are new, known and in total."""
    is_new = F.col(prediction) == new_label
    return predictions.agg(
        F.count_if(is_new).alias("unknown"),
        F.count_if(~is_new).alias("known"),
        F.count(F.lit(1)).alias("total"),
    )
