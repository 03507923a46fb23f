"""One entry per operator, over whole driver tables.

The ``embeddings`` table stands for an image table: ``image_id`` is the vector
id, the dataset and the identity are derived from label and id, and every tenth
row has no identity, like a query image.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions import columns as C
from fieldmark.functions import vectors as V
from fieldmark.operators import embedding, joins, metrics, predict, profile, report, split, sweep, triplets
from fieldmark.operators.neighbors import nearest
from fieldmark.operators.ranking import encode_labels
from fieldmark.operators.stats import distance_summary, median_and_mad, null_distances
from fieldmark.plans.prediction import run_prediction
from fieldmark.sources.positions import positional_zip, row_numbers
from fieldmark.sources.staging import stage, staging_root
from fieldmark.sources.tables import read_columns

KS = (1, 3, 5, 10, 20)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_columns(spark, f"{sf_dir}/{name}.parquet", columns or None)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = (
        F.when(F.col("label") % 3 == 0, "SeaTurtleID2022")
        .when(F.col("label") % 3 == 1, "SalamanderID2025")
        .otherwise("LynxID2025")
    )
    identity = F.when(
        F.col("vec_id") % 10 != 0,
        F.concat_ws("_", "dataset", F.col("label").cast("string"), (F.col("vec_id") % 7).cast("string")),
    )
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("dataset", dataset)
        .select(
            F.col("vec_id").alias("image_id"), identity.alias("identity"), "dataset",
            F.col("embedding").alias("embeddings"), "label",
        )
    )


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("image_id", "identity", "dataset")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = joins.group_count(narrow(spark, sf_dir), "identity", "image_id")
    return stage(counted.where(C.is_frequent()))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(split.openset_split(eligible(spark, sf_dir)))


def part_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = split.openset_split(eligible(spark, sf_dir))
    vectors = images(spark, sf_dir).select("image_id", "embeddings")
    return stage(assigned.join(vectors, "image_id"), partition_by=["part"])


def train_and_val(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = part_vectors(spark, sf_dir)
    return rows.where("part = 'train'"), rows.where("part = 'val'")


def labelled_and_not(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = images(spark, sf_dir)
    return rows.where(C.is_known()), rows.where(~C.is_known())


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- counts and profiles ----------------------------------------------------


def identity_count(spark, sf_dir):
    return joins.group_count(narrow(spark, sf_dir), "identity", "image_id")


def frequent_filter(spark, sf_dir):
    return eligible(spark, sf_dir)


def count_by_key(spark, sf_dir):
    return profile.count_by(table(spark, sf_dir, "events", "event_type"), "event_type")


def freq_of_freq(spark, sf_dir):
    return profile.frequency_of_frequencies(narrow(spark, sf_dir), "identity")


def describe_counts(spark, sf_dir):
    df = profile.describe_counts(table(spark, sf_dir, "events", "user_id"), "user_id")
    return rounded(df, "mean", "stddev")


def nunique(spark, sf_dir):
    return profile.distinct_counts(narrow(spark, sf_dir), "identity")


def profile_topn(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "documents", "source"), "source", 3)


def profile_slice(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "documents", "source"), "source", 10, skip=3)


def _species_rows(spark, sf_dir) -> DataFrame:
    kind = F.col("label") % 5
    species = (
        F.when(kind == 0, "lynx").when(kind == 1, "salamander")
        .when(kind == 2, "loggerhead turtle").when(kind == 3, "fox")
    )
    return images(spark, sf_dir).select(
        "image_id", "identity", species.alias("species"),
        F.when(C.is_known(), "database").otherwise("query").alias("split"),
    )


SPECIES = ["lynx", "salamander", "loggerhead turtle"]


def species_profile(spark, sf_dir):
    return profile.species_profile(_species_rows(spark, sf_dir), SPECIES)


def relabel(spark, sf_dir):
    return _species_rows(spark, sf_dir).select(
        "image_id",
        C.query_label("identity", "species", "split").alias("identity"),
        C.known_species("species", SPECIES).alias("species"),
    )


def run_lengths(spark, sf_dir):
    rows = row_numbers(spark, f"{sf_dir}/documents.parquet").select("row_number", "lang")
    return profile.run_lengths(rows, "row_number", "lang")


def label_encode(spark, sf_dir):
    rows = images(spark, sf_dir).select("image_id", "identity").where(C.is_known())
    return joins.attach_by_key(rows, encode_labels(rows, "identity"), "identity")


# --- projections, filters and scalars ---------------------------------------


def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id",
        C.path_part("url", -1).alias("last"),
        C.path_part("url", -2).alias("second_last"),
        C.path_part("url", -3).alias("third_last"),
    )


def file_suffix(spark, sf_dir):
    suffixes = table(spark, sf_dir, "pages", "url").select(C.file_suffix("url").alias("suffix"))
    return profile.count_by(suffixes, "suffix")


def relative_path(spark, sf_dir):
    under = F.concat(F.lit("file:///data/root/images/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "documents", "doc_id", "lang").select(
        "doc_id", C.relative_path(under, "file:/data/root").alias("path")
    )


def name_prefix(spark, sf_dir):
    return narrow(spark, sf_dir).select("image_id", C.name_prefix("identity").alias("prefix"))


def key_value(spark, sf_dir):
    epoch = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("epoch="), F.col("label").cast("string"))).otherwise("final")
    return table(spark, sf_dir, "embeddings", "vec_id", "label").select(
        "vec_id", C.key_value_int(epoch).alias("epoch_number")
    )


def like_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "source").where(F.col("source").like("%rc1%"))


def in_list(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "lang").where(F.col("lang").isin("en", "fr"))


def known_unknown(spark, sf_dir):
    marked = narrow(spark, sf_dir).withColumn("known", C.is_known())
    return profile.count_by(marked, "dataset", "known")


def hash_sample(spark, sf_dir):
    return narrow(spark, sf_dir).select("image_id", C.hash_bucket("image_id", 10).alias("sample_id"))


def _tokens(spark, sf_dir) -> DataFrame:
    """Four tokens of 16 numbers per image."""
    quarter = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embeddings", i * 16 + 1, F.lit(16))
    )
    return images(spark, sf_dir).select("image_id", quarter.alias("tokens"))


def struct_fields(spark, sf_dir):
    token = F.struct(V.first_token("tokens").alias("cls"), V.mean_of_rest("tokens").alias("avg_patch"))
    df = _tokens(spark, sf_dir).select("image_id", token.alias("token")).select("image_id", "token.*")
    return df.select(
        "image_id", F.size("cls").alias("cls_size"), F.size("avg_patch").alias("avg_patch_size"),
        F.round(F.col("cls")[0].cast("double"), 6).alias("first_cls"), F.round(F.col("cls")[15].cast("double"), 6).alias("last_cls"),
        F.round(F.col("avg_patch")[0], 6).alias("first_avg"), F.round(F.col("avg_patch")[15], 6).alias("last_avg"),
    )


def token_pool(spark, sf_dir):
    pooled = _tokens(spark, sf_dir).select(
        "image_id", F.arrays_zip(V.first_token("tokens").alias("cls"), V.mean_of_rest("tokens").alias("avg_patch")).alias("z")
    )
    return pooled.select("image_id", F.posexplode("z").alias("pos", "z")).select(
        "image_id", F.col("pos").cast("long").alias("pos"),
        F.round(F.col("z.cls").cast("double"), 6).alias("cls"), F.round("z.avg_patch", 6).alias("avg_patch"),
    )


def rename_columns(spark, sf_dir):
    return (
        table(spark, sf_dir, "labels")
        .drop("toxic")
        .withColumnRenamed("quality", "freq")
        .withColumn("split", F.lit("database"))
    )


def vector_text(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id", C.joined_text(["doc_id", "quality", "toxic"]).alias("token")
    )


def _elements(df: DataFrame, vector: str | Column, digits: int = 6) -> DataFrame:
    return df.select("image_id", F.posexplode(vector).alias("pos", "value")).select(
        "image_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("value").cast("double"), digits).alias("value")
    )


def prefix_truncate(spark, sf_dir):
    return _elements(images(spark, sf_dir), V.prefix("embeddings", 16))


def l2_normalise(spark, sf_dir):
    scaled = images(spark, sf_dir).select(
        "image_id", F.transform("embeddings", lambda x: x * F.lit(3.0)).alias("v")
    )
    return _elements(scaled, V.l2_normalize("v"))


def wide_fold(spark, sf_dir):
    wide = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("image_id"), F.col("quality").alias("embed_0"), F.col("toxic").alias("embed_1")
    )
    return _elements(V.fold_columns(wide, "embed_"), "embeddings")


def float_cast(spark, sf_dir):
    third = F.transform("embeddings", lambda x: x.cast("double") / F.lit(3.0))
    return _elements(images(spark, sf_dir), V.as_float32(third))


def score_arithmetic(spark, sf_dir):
    value = F.col("value")
    df = table(spark, sf_dir, "events", "event_id", "value").where(value.isNotNull())
    share = F.abs(value) / (F.abs(value) + F.lit(1.0))
    return df.select(
        "event_id",
        F.round(C.modified_z(value, F.lit(10.0), F.lit(2.0)), 6).alias("z"),
        F.round(C.geometric_mean(share, F.lit(0.5)), 6).alias("geometric"),
        F.round(C.crossover(share, F.lit(0.5)), 6).alias("crossover"),
        F.round(C.hinge(value - F.lit(10.0)), 6).alias("hinge"),
    )


# --- joins and set operations -----------------------------------------------


def metadata_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "inner")


def path_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")


def anti_join_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return joins.missing_rows(docs, table(spark, sf_dir, "labels", "doc_id"), "doc_id")


def semi_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return joins.rows_in(docs, table(spark, sf_dir, "labels", "doc_id"), "doc_id")


def left_join_back(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    per_source = toxic.groupBy("source").agg(F.count(F.lit(1)).alias("toxic_docs"))
    return joins.attach_by_key(docs, per_source, "source")


def positional(spark, sf_dir):
    left = row_numbers(spark, f"{sf_dir}/documents.parquet").select("row_number", "doc_id")
    right = row_numbers(spark, f"{sf_dir}/embeddings.parquet").select("row_number", "vec_id", "label")
    return positional_zip(left, right)


def union_parts(spark, sf_dir):
    rows = parts(spark, sf_dir).select("image_id", "part")
    return rows.where("part = 'train'").unionByName(rows.where("part = 'val'"))


def identity_difference(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return joins.key_difference(rows.where("part <> 'train'"), rows.where("part = 'train'"), "identity")


def overlap_counts(spark, sf_dir):
    return joins.key_overlap(parts(spark, sf_dir), "part", "identity")


def distinct_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents", "lang", "source").distinct()


def sort_top(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    return rounded(events.orderBy(F.col("value").desc_nulls_last(), "event_id").limit(10), "value")


# --- splits -----------------------------------------------------------------


def openset_split(spark, sf_dir):
    return split.openset_split(eligible(spark, sf_dir)).select("image_id", "identity", "part")


def split_summary(spark, sf_dir):
    return split.split_summary(parts(spark, sf_dir))


def identity_split(spark, sf_dir):
    return split.identity_split(eligible(spark, sf_dir)).select("image_id", "identity", "part")


def early_split(spark, sf_dir):
    return split.early_split(eligible(spark, sf_dir)).select("image_id", "identity", "part")


def stratified_split(spark, sf_dir):
    rows = images(spark, sf_dir).select("image_id", "label")
    return split.stratified_split(rows, "label", "image_id")


# --- neighbours and statistics ----------------------------------------------


def knn_topk(spark, sf_dir):
    known, unknown = labelled_and_not(spark, sf_dir)
    return rounded(nearest(unknown, known, 10), "distance")


def knn_other_identity(spark, sf_dir):
    known, _ = labelled_and_not(spark, sf_dir)
    return rounded(nearest(known, known, 3, other_label_only=True), "distance")


def row_median_distance(spark, sf_dir):
    known, _ = labelled_and_not(spark, sf_dir)
    return rounded(null_distances(known, [1, 3, 5]), "distance")


def null_distance_summary(spark, sf_dir):
    train, _ = train_and_val(spark, sf_dir)
    summary = distance_summary(null_distances(train, [3]))
    return rounded(summary, *summary.columns)


def median_mad_by_k(spark, sf_dir):
    train, _ = train_and_val(spark, sf_dir)
    return rounded(median_and_mad(null_distances(train, KS)), "median", "mad")


# --- predictions ------------------------------------------------------------


def vote(spark, sf_dir):
    known, unknown = labelled_and_not(spark, sf_dir)
    return predict.vote(nearest(unknown, known, 10))


def predict_zgate(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    stats = stage(median_and_mad(null_distances(train, [5])))
    gated = predict.predict_gated(
        nearest(val, train, 5), stats.select("median").scalar(), stats.select("mad").scalar(), -0.5
    )
    return predict.complete(gated, val)


def predict_absolute(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    return predict.complete(predict.predict_by_distance(nearest(val, train, 1), 1.2), val)


def predict_all_rows(spark, sf_dir):
    """Predictions from a gallery whose dataset has no row: every query row is new."""
    known, unknown = labelled_and_not(spark, sf_dir)
    found = nearest(unknown, known.where("dataset = 'NoSuchDataset'"), 3)
    return predict.complete(predict.predict_by_distance(found, 1.2), unknown)


def closed_set_1nn(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    found = predict.predict_closed_set(nearest(val, train, 1))
    predicted = predict.complete(found, val, new_label="unknown")
    rows = val.select("image_id", "identity").join(predicted, "image_id")
    unknown = joins.key_difference(val, train, "identity")
    return rounded(metrics.balanced_accuracies(rows, unknown, new_label="unknown"), "baks", "baus")


def prediction_counts(spark, sf_dir):
    return predict.prediction_counts(predict_absolute(spark, sf_dir))


def _scored(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    predicted = predict.predict_by_distance(nearest(val, train, 1), 1.2)
    rows = val.select("image_id", "identity").join(predicted, "image_id")
    return rows, joins.key_difference(val, train, "identity")


def baks(spark, sf_dir):
    return rounded(metrics.baks(*_scored(spark, sf_dir)), "baks")


def baus(spark, sf_dir):
    return rounded(metrics.baus(*_scored(spark, sf_dir)), "baus")


def _solution_and_submission(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    train_ids = train.select("identity").distinct().withColumn("_known", F.lit(True))
    solution = val.join(train_ids, "identity", "left").select(
        "image_id", "identity", "dataset", F.col("_known").isNull().alias("new_identity")
    )
    submission = predict.predict_by_distance(nearest(val, train, 1), 1.2).withColumnRenamed("prediction", "identity")
    return stage(solution), stage(submission)


def competition_score(spark, sf_dir):
    return rounded(metrics.competition_score(*_solution_and_submission(spark, sf_dir)), "score")


def dataset_scores(spark, sf_dir):
    scores = metrics.dataset_scores(*_solution_and_submission(spark, sf_dir))
    return rounded(scores, "baks", "baus", "normalized")


def _flawed_submission(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as solution; the labelled ones are submitted, with bad prefixes on some."""
    solution = table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("image_id"), F.lit("new_individual").alias("identity")
    )
    submission = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("image_id"),
        F.when(F.col("quality") == 1, "LynxID2025_1").otherwise("Fox_1").alias("identity"),
    )
    return solution, submission


def submission_violations(spark, sf_dir):
    return metrics.submission_violations(*_flawed_submission(spark, sf_dir))


def submission_alignment(spark, sf_dir):
    return metrics.unmatched_rows(*_flawed_submission(spark, sf_dir))


# --- sweeps -----------------------------------------------------------------

SWEEP = ("threshold", "baks", "baus", "crossover_score", "score", "median", "mad")


def threshold_sweep(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    found = nearest(val, train, 3, query_columns=["identity"])
    return rounded(sweep.sweep_neighbors(found, val, train, [(3, 1.25, 0.05)], C.linspace(-8, 8, 100)), *SWEEP)


def distance_sweep(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    found = nearest(val, train, 1, query_columns=["identity"])
    swept = sweep.sweep_distances(found, val, train, C.linspace(0.8, 1.6, 41))
    return rounded(swept, *SWEEP[:5])


def mad_scaled_sweep(spark, sf_dir):
    """Absolute thresholds, as many MADs of the distances between identities away from their median."""
    train, val = train_and_val(spark, sf_dir)
    stats = median_and_mad(null_distances(train, [1])).first()
    steps = C.linspace(-2, 2, 21)
    grid = [stats["median"] + step * stats["mad"] for step in steps]
    found = nearest(val, train, 1, query_columns=["identity"])
    swept = sweep.sweep_distances(found, val, train, grid)
    multiplier = (F.col("threshold") - F.lit(stats["median"])) / F.lit(stats["mad"])
    return rounded(swept.withColumn("multiplier", multiplier), *SWEEP[:5], "multiplier")


def distance_experiment(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    return rounded(sweep.experiment(train, val, [1])[0], *SWEEP)


def k_sweep(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    return rounded(sweep.experiment(train, val, KS)[0], *SWEEP)


def best_threshold(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    return rounded(sweep.best_row(sweep.experiment(train, val, [5])[0]), *SWEEP)


def sweep_maxima(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    return rounded(sweep.maxima(sweep.experiment(train, val, [5])[0]), "baks", "baus", "score")


def _label_unknown(spark, sf_dir, **options):
    rows = images(spark, sf_dir)
    output = f"{staging_root(spark)}/labels-{uuid.uuid4().hex}"
    return run_prediction(rows.drop("embeddings", "label"), rows.select("image_id", "embeddings"), output, 3, **options)


def final_labels(spark, sf_dir):
    return _label_unknown(spark, sf_dir)


def dataset_only(spark, sf_dir):
    """One dataset on its own: nearest labels of its unlabelled rows."""
    known, unknown = labelled_and_not(spark, sf_dir)
    only = F.col("dataset") == "SalamanderID2025"
    return rounded(nearest(unknown.where(only), known.where(only), 1), "distance")


# --- vectors, triplets and losses -------------------------------------------


def centroid(spark, sf_dir):
    means = V.centroids(images(spark, sf_dir).where(C.is_known()), "identity")
    return means.select("identity", F.posexplode("centroid").alias("pos", "value")).select(
        "identity", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


def _database(spark, sf_dir) -> DataFrame:
    rows = images(spark, sf_dir).withColumn("split", F.when(C.is_known(), "database").otherwise("query"))
    return triplets.triplet_rows(rows)


def triplet_filter(spark, sf_dir):
    return _database(spark, sf_dir).select("image_id", "identity")


def positive_sample(spark, sf_dir):
    return triplets.sample_positives(_database(spark, sf_dir), n=2)


def negative_sample(spark, sf_dir):
    return triplets.sample_negatives(_database(spark, sf_dir), n=2)


def negative_sample_same_dataset(spark, sf_dir):
    return triplets.sample_negatives(_database(spark, sf_dir), n=2, same_dataset=True)


def candidate_counts(spark, sf_dir):
    return triplets.candidate_counts(_database(spark, sf_dir))


def batch_distances(spark, sf_dir):
    batched = triplets.assign_batches(_database(spark, sf_dir).select("image_id", "embeddings"), 100)
    return rounded(triplets.batch_distances(batched), "nearest", "farthest", "mean")


def semi_hard(spark, sf_dir):
    mined = triplets.mine_semi_hard(_database(spark, sf_dir), margin=0.2, batch_size=100)
    return rounded(mined, "dp", "dn")


def _mined(spark, sf_dir) -> DataFrame:
    rows = stage(_database(spark, sf_dir).select("image_id", "identity", "embeddings"))
    return triplets.with_vectors(triplets.mine_semi_hard(rows, margin=0.2, batch_size=100), rows)


NESTED = {"nested_dims": (64, 32, 16, 2), "loss_weights": (1.0, 1.0, 0.5, 0.25, 0.125), "margin": 0.2}


def triplet_loss(spark, sf_dir):
    return rounded(triplets.triplet_loss(_mined(spark, sf_dir), margin=0.2), "loss")


def nested_loss(spark, sf_dir):
    return rounded(triplets.nested_triplet_loss(_mined(spark, sf_dir), **NESTED), "loss")


def epoch_loss(spark, sf_dir):
    return rounded(triplets.epoch_loss(_mined(spark, sf_dir), **NESTED), "loss")


# --- reports ----------------------------------------------------------------


def accuracy(spark, sf_dir):
    df = report.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(df, "accuracy", "accuracy_pct")


def _nearest_label(spark, sf_dir) -> DataFrame:
    rows = images(spark, sf_dir).select("image_id", "identity", "dataset", "embeddings")
    known, unknown = rows.where(C.is_known()), rows.where(~C.is_known())
    found = nearest(unknown, known, 1, label="dataset", query_columns=["dataset"])
    return found.select("image_id", "dataset", F.col("neighbor_dataset").alias("prediction"))


def class_report(spark, sf_dir):
    df = report.classification_report(_nearest_label(spark, sf_dir), "dataset", "prediction")
    return rounded(df, "precision", "recall", "f1_score")


def confusion(spark, sf_dir):
    return report.confusion_matrix(_nearest_label(spark, sf_dir), "dataset", "prediction")


def silhouette(spark, sf_dir):
    rows = images(spark, sf_dir).where(C.is_known())
    return rounded(report.silhouette_score(rows, "identity"), "silhouette")


def silhouette_rows(spark, sf_dir):
    rows = images(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    return rounded(report.silhouette_samples(rows, "label"), "silhouette")


# --- models -----------------------------------------------------------------


def head_weights(outputs: int, inputs: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    o, i = np.arange(outputs)[:, None], np.arange(inputs)[None, :]
    return ((o * 7 + i * 13 + shift) % 11 - 5) / 10.0, (np.arange(outputs) % 3 - 1) / 10.0


def linear_projection(spark, sf_dir):
    head = embedding.LinearHead(*head_weights(16, 64, 0))
    rows = images(spark, sf_dir).select("image_id", "embeddings")
    return _elements(embedding.project(rows, head, element=T.DoubleType()), "embeddings")


def nonlinear_projection(spark, sf_dir):
    head = embedding.NonlinearHead(*head_weights(32, 64, 0), *head_weights(16, 32, 3))
    rows = images(spark, sf_dir).select("image_id", "embeddings")
    return _elements(embedding.project(rows, head, element=T.DoubleType()), "embeddings")


def batch_embed(spark, sf_dir):
    def factory(name: str):
        def model(batch: np.ndarray) -> dict[str, np.ndarray]:
            data = [bytes(b) for b in batch]
            return {
                "cls": np.array([[len(b)] for b in data], dtype="float32"),
                "avg_patch": np.array([[b.count(b" ")] for b in data], dtype="float32"),
            }

        return model

    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.encode("text", "utf-8").alias("content")
    )
    embedder = embedding.BatchEmbedder(factory=factory, modelName="byte-counts", batchSize=64)
    return embedder.transform(docs).select(
        "doc_id", F.col("token.cls")[0].cast("long").alias("bytes"), F.col("token.avg_patch")[0].cast("long").alias("spaces")
    )


def pca(spark, sf_dir):
    scored = embedding.pca_scores(images(spark, sf_dir).select("image_id", "embeddings"), 2)
    return scored.select(
        "image_id", F.round(F.col("scores")[0], 6).alias("first"), F.round(F.col("scores")[1], 6).alias("second")
    )


REGISTERED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    identity_count, frequent_filter, count_by_key, freq_of_freq, describe_counts, nunique,
    profile_topn, profile_slice, species_profile, relabel, run_lengths, label_encode,
    path_parts, file_suffix, relative_path, name_prefix, key_value, like_filter, in_list,
    known_unknown, hash_sample, struct_fields, token_pool, rename_columns, vector_text,
    prefix_truncate, l2_normalise, wide_fold, float_cast, score_arithmetic,
    metadata_join, path_left_join, anti_join_missing, semi_join, left_join_back, positional,
    union_parts, identity_difference, overlap_counts, distinct_projection, sort_top,
    openset_split, split_summary, identity_split, early_split, stratified_split,
    knn_topk, knn_other_identity, row_median_distance, null_distance_summary, median_mad_by_k,
    vote, predict_zgate, predict_absolute, predict_all_rows, closed_set_1nn, prediction_counts,
    baks, baus, competition_score, dataset_scores, submission_violations, submission_alignment,
    threshold_sweep, distance_sweep, mad_scaled_sweep, distance_experiment, k_sweep, best_threshold, sweep_maxima,
    final_labels, dataset_only,
    centroid, triplet_filter, positive_sample, negative_sample, negative_sample_same_dataset,
    candidate_counts, batch_distances, semi_hard, triplet_loss, nested_loss, epoch_loss,
    accuracy, class_report, confusion, silhouette, silhouette_rows,
    linear_projection, nonlinear_projection, batch_embed, pca,
)
