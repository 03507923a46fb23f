"""Jobs from embeddings to labels, and the leaderboard over their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.columns import is_frequent, is_known, key_value_int, linspace, path_part
from fieldmark.operators.joins import group_count
from fieldmark.operators.kernels import Wanted
from fieldmark.operators.neighbors import row_medians, write_lists
from fieldmark.operators.predict import complete, predict_gated, prediction_counts
from fieldmark.operators.split import TEST, TRAIN, VAL, openset_split, split_summary
from fieldmark.operators.stats import distance_summaries
from fieldmark.operators.sweep import DEFAULT_GRID, best_row, sweep_neighbors
from fieldmark.sources.staging import Owner, stage
from fieldmark.sources.tables import read_records, write_csv, write_record

# Roles beside the three parts: rows to label, and known rows too rare to split.
QUERY, RARE = "query", "rare"


def analysis_rows(metadata: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Narrow rows (image_id, identity, dataset, identity_count) that have an embedding."""
    rows = metadata.select("image_id", "identity", "dataset").join(
        embeddings.select("image_id"), "image_id"
    )
    return group_count(rows, "identity", "image_id")


def run_prediction(
    metadata: DataFrame,
    embeddings: DataFrame,
    output_path: str,
    num_neighbors: int = 1,
    *,
    dataset: str | None = None,
    recalibrate: bool = False,
) -> DataFrame:
    """Split, calibrate, sweep and label the rows without identity.

    Rows whose identity has more than two images are split. The threshold is
    tuned on validation and again, with train and validation as gallery, on
    test. Rows without identity are then labelled from all known rows by the
    statistics and threshold of the test sweep, or with ``recalibrate`` by the
    median and MAD of all known rows. ``dataset`` restricts everything to one
    dataset. Returns (image_id, identity) and writes, below ``output_path``:

    - ``reid_split_summary.csv``, ``val_thresholds.csv``, ``test_thresholds.csv``
    - ``{val,test}_distance_summary.json``, ``{val,test}_best_threshold.json``
    - ``test_known_counts.json`` and ``prediction.csv``

    Vectors are joined once, to rows that already know their part, and one
    pass over pairs of rows finds the neighbours for every step: those of
    known rows among other identities for the calibrations, those of
    validation and test rows for the sweeps and those of the rows to label.
    Of what is staged only the result is left.
    """
    with Owner() as mine:
        predictions = _predict(metadata, embeddings, output_path, num_neighbors, dataset, recalibrate)
        return mine.hand_over(predictions)


def _predict(
    metadata: DataFrame, embeddings: DataFrame, output_path: str, num_neighbors: int, dataset: str | None, recalibrate: bool
) -> DataFrame:
    """``run_prediction``, whose result is a staged table."""
    if dataset is not None:
        metadata = metadata.where(F.col("dataset") == dataset)
    rows = stage(analysis_rows(metadata, embeddings))
    parts = stage(openset_split(rows.where(is_frequent()).select("image_id", "identity")))
    write_csv(split_summary(parts), f"{output_path}/reid_split_summary.csv", single_file=True)

    role = F.when(~is_known(), QUERY).otherwise(F.coalesce("part", F.lit(RARE)))
    labelled = rows.join(parts.select("image_id", "part"), "image_id", "left").select(
        "image_id", "identity", role.alias("role")
    )
    # One folder per role: each step below reads the rows of its roles only.
    table = stage(
        labelled.join(embeddings.select("image_id", "embeddings"), "image_id"), partition_by=["role"]
    )
    known = table.where(F.col("role") != QUERY)
    queries = table.where(F.col("role") == QUERY)
    galleries = {"val": frozenset([TRAIN]), "test": frozenset([TRAIN, VAL])}
    asking = {"val": VAL, "test": TEST}
    every = frozenset([TRAIN, VAL, TEST, RARE])
    wanted = [Wanted("final", frozenset([QUERY]), every)]
    for name, gallery in galleries.items():
        wanted += [
            Wanted(f"{name}_null", gallery, gallery, True), Wanted(name, frozenset([asking[name]]), gallery)
        ]
    if recalibrate:
        wanted.append(Wanted("known_null", every, every, True))
    found = write_lists(table, known, num_neighbors, wanted, role="role", query_columns=["identity"])
    nulls = found.where(F.col("list").endswith("_null"))
    distances = row_medians(nulls, [num_neighbors], by=["list"])
    summaries = {r["list"]: r for r in distance_summaries(stage(distances), by="list").collect()}

    chosen = None
    for name, gallery in galleries.items():
        summary = summaries.get(f"{name}_null")
        if summary is None:
            raise ValueError(f"no two identities to compare in the gallery of {name}")
        swept = stage(
            sweep_neighbors(
                found.where(F.col("list") == name), table.where(F.col("role") == asking[name]),
                table.where(F.col("role").isin(*gallery)), [(num_neighbors, summary["median"], summary["mad"])],
                linspace(*DEFAULT_GRID),
            )
        )
        write_csv(swept.orderBy("threshold"), f"{output_path}/{name}_thresholds.csv", single_file=True)
        record = metadata.sparkSession.createDataFrame([summary]).drop("list")
        write_record(record, f"{output_path}/{name}_distance_summary.json")
        chosen = best_row(swept)
        write_record(chosen, f"{output_path}/{name}_best_threshold.json")
    best = chosen.first()
    if best["score"] is None:
        raise ValueError("no threshold has a score: known and unknown test rows are both needed")

    median, mad = best["median"], best["mad"]
    if recalibrate:
        median, mad = summaries["known_null"]["median"], summaries["known_null"]["mad"]
    gated = predict_gated(found.where(F.col("list") == "final"), median, mad, best["threshold"])
    predictions = stage(complete(gated, queries).withColumnRenamed("prediction", "identity"))
    write_record(prediction_counts(predictions, "identity"), f"{output_path}/test_known_counts.json")
    write_csv(predictions, f"{output_path}/prediction.csv")
    return predictions


def leaderboard(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records of ``<model>/<epoch>/<record>`` paths with model, epoch and its number.

    ``pattern`` may match JSON files or the folders a job wrote.
    """
    records = read_records(spark, pattern)
    record = F.regexp_replace("filename", r"/part-[^/]*$", "")
    return (
        records.withColumn("model", path_part(record, -3))
        .withColumn("epoch", path_part(record, -2))
        .withColumn("epoch_number", key_value_int("epoch"))
        .drop("filename")
    )


def top_runs(runs: DataFrame, n: int = 10, best: bool = True) -> DataFrame:
    """The ``n`` best or worst runs by score, as (model, epoch, score)."""
    order = F.desc_nulls_last("score") if best else F.asc_nulls_last("score")
    return runs.select("model", "epoch", "score").orderBy(order, "model", "epoch").limit(n)


def score_by_epoch(runs: DataFrame, model_like: str = "%") -> DataFrame:
    """Scores of numbered epochs of the matching models, in epoch order."""
    return (
        runs.where(F.col("model").like(model_like) & F.col("epoch").like("%=%"))
        .select("model", "epoch_number", "score")
        .orderBy("model", "epoch_number")
    )
