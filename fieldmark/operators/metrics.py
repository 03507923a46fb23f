"""Balanced accuracy on known and unknown samples, and submission checks.

Every metric first reduces rows to one line per identity, with partial sums
before the shuffle, and only then joins identity sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.columns import IDENTITY_PREFIXES, NEW_INDIVIDUAL


class SubmissionError(ValueError):
    """A submission does not fit its solution."""


def _per_identity(
    rows: DataFrame, unknown: DataFrame, identity: str, prediction: str, new_label: str
) -> DataFrame:
    """Per identity: its accuracy if known, and if unknown; the other is NULL."""
    right = F.avg((F.col(prediction) == F.col(identity)).cast("double"))
    new = F.avg((F.col(prediction) == new_label).cast("double"))
    tally = rows.groupBy(identity).agg(right.alias("_right"), new.alias("_new"))
    marks = unknown.select(identity).distinct().withColumn("_unknown", F.lit(True))
    return tally.join(marks, identity, "left").select(
        identity,
        F.when(F.col("_unknown").isNull(), F.col("_right")).alias("known_accuracy"),
        F.when(F.col("_unknown"), F.col("_new")).alias("unknown_accuracy"),
    )


def balanced_accuracies(
    rows: DataFrame,
    unknown: DataFrame,
    *,
    identity: str = "identity",
    prediction: str = "prediction",
    new_label: str = NEW_INDIVIDUAL,
) -> DataFrame:
    """One row with ``baks`` and ``baus``; a side without identities is NULL.

    ``unknown`` lists the identities that the gallery does not hold. ``baks``
    averages, over the other identities, the share of rows labelled right;
    ``baus`` averages, over these, the share labelled ``new_label``.
    """
    return _per_identity(rows, unknown, identity, prediction, new_label).agg(
        F.avg("known_accuracy").alias("baks"), F.avg("unknown_accuracy").alias("baus")
    )


def baks(rows: DataFrame, unknown: DataFrame, **names: str) -> DataFrame:
    return balanced_accuracies(rows, unknown, **names).select("baks")


def baus(rows: DataFrame, unknown: DataFrame, **names: str) -> DataFrame:
    return balanced_accuracies(rows, unknown, **names).select("baus")


def align(solution: DataFrame, submission: DataFrame, key: str = "image_id") -> DataFrame:
    """Solution rows with the submitted label as ``prediction``."""
    return solution.join(
        submission.select(key, F.col("identity").alias("prediction")), key
    )


def unmatched_rows(
    solution: DataFrame, submission: DataFrame, key: str = "image_id"
) -> DataFrame:
    """Keys on one side only, as (key, missing_from)."""
    lost = solution.select(key).join(submission.select(key), key, "left_anti")
    extra = submission.select(key).join(solution.select(key), key, "left_anti")
    return lost.withColumn("missing_from", F.lit("submission")).unionByName(
        extra.withColumn("missing_from", F.lit("solution"))
    )


def valid_label(c: str | Column, prefixes: tuple[str, ...] = IDENTITY_PREFIXES) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    starts = reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
    return F.coalesce(starts | (c == NEW_INDIVIDUAL), F.lit(False))


def submission_violations(
    solution: DataFrame, submission: DataFrame, key: str = "image_id"
) -> DataFrame:
    """How often each submission rule is broken, as (rule, violations).

    Rules: one row per solution row, the same keys without repetition, and a
    label that is ``new_individual`` or carries an allowed prefix.
    """
    for column in (key, "identity"):
        if column not in submission.columns:
            raise SubmissionError(f"no column {column} among {', '.join(submission.columns)}")
    kind = submission.schema["identity"].dataType
    if not isinstance(kind, T.StringType):
        raise SubmissionError(f"labels in column identity are {kind.simpleString()}; each must be a string")
    counts = (
        solution.select(key, F.lit(1).alias("_side"), F.lit(True).alias("_valid"))
        .unionByName(
            submission.select(key, F.lit(0).alias("_side"), valid_label("identity").alias("_valid"))
        )
        .groupBy(key)
        .agg(
            F.sum("_side").alias("_in_solution"),
            F.sum(1 - F.col("_side")).alias("_submitted"),
            F.count_if(~F.col("_valid")).alias("_bad"),
        )
        .agg(
            F.abs(F.coalesce(F.sum(F.col("_submitted") - F.col("_in_solution")), F.lit(0))).alias("length"),
            F.count_if((F.col("_submitted") == 0)).alias("missing"),
            F.count_if((F.col("_in_solution") == 0)).alias("extra"),
            F.count_if((F.col("_submitted") > 1)).alias("repeated"),
            F.coalesce(F.sum("_bad"), F.lit(0)).alias("label"),
        )
    )
    rules = {
        "length": "row count differs",
        "missing": "image_id missing",
        "extra": "image_id not in solution",
        "repeated": "image_id repeated",
        "label": "identity prefix",
    }
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(text).alias("rule"), F.col(c).cast("long").alias("violations"))
                    for c, text in rules.items()
                ]
            )
        )
    )


def dataset_scores(
    solution: DataFrame, submission: DataFrame, key: str = "image_id"
) -> DataFrame:
    """Per dataset: ``baks``, ``baus`` and their geometric mean.

    An identity is unknown if any solution row, of any dataset, marks it new.
    A side without identities counts as 0. Every solution row counts once: an id
    without a label is wrong, and of several labels for one id the smallest is taken.
    """
    labels = submission.groupBy(key).agg(F.min("identity").alias("prediction"))
    joined = (
        solution.select(key, "dataset", "identity")
        .join(labels, key, "left")
        .withColumn("prediction", F.coalesce("prediction", F.lit("")))
    )
    per_identity = joined.groupBy("dataset", "identity").agg(
        F.avg((F.col("prediction") == F.col("identity")).cast("double")).alias("_right"),
        F.avg((F.col("prediction") == NEW_INDIVIDUAL).cast("double")).alias("_new"),
    )
    unknown = (
        solution.where("new_identity").select("identity").distinct().withColumn("_unknown", F.lit(True))
    )
    marked = per_identity.join(unknown, "identity", "left")
    known = F.avg(F.when(F.col("_unknown").isNull(), F.col("_right")))
    new = F.avg(F.when(F.col("_unknown"), F.col("_new")))
    scores = marked.groupBy("dataset").agg(
        F.coalesce(known, F.lit(0.0)).alias("baks"), F.coalesce(new, F.lit(0.0)).alias("baus")
    )
    return scores.withColumn("normalized", F.sqrt(F.col("baks") * F.col("baus")))


def competition_score(
    solution: DataFrame, submission: DataFrame, key: str = "image_id", check: bool = True
) -> DataFrame:
    """One row ``score``: the plain mean of the dataset scores.

    With ``check`` a submission that breaks a rule is refused first.
    """
    if check:
        broken = submission_violations(solution, submission, key).where("violations > 0").collect()
        if broken:
            raise SubmissionError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))
    return dataset_scores(solution, submission, key).agg(F.avg("normalized").alias("score"))
