"""Queries that write a driver table through a sink and read it back, and composites of whole jobs."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracles
from checks.queries import SWEEP, _label_unknown, images, rounded, table, train_and_val
from fieldmark.functions import columns as C
from fieldmark.operators import embedding, joins, sweep
from fieldmark.operators.ranking import encode_labels
from fieldmark.plans.prediction import leaderboard, score_by_epoch, top_runs
from fieldmark.sources.staging import stage, staging_root
from fieldmark.sources.tables import (
    METADATA_COLUMNS,
    key_differences,
    read_columns,
    read_files,
    read_metadata,
    read_records,
    write_csv,
    write_files,
    write_partitioned,
    write_record,
    write_samples,
)

# The model named below travels with its query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fresh_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/roundtrip-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf_dir):
    path = fresh_folder(spark)
    text = {
        "image_id": F.col("doc_id"), "identity": F.col("source"), "path": F.concat("lang", F.lit("/"), "doc_id"),
        "date": F.lit(None), "orientation": F.lit("left, \"top\""), "species": F.col("lang"),
        "split": F.lit("database"), "dataset": F.col("source"),
    }
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    write_csv(docs.select(*(text[c].cast("string").alias(c) for c in METADATA_COLUMNS)), path)
    return read_metadata(spark, path)


def _records(spark, sf_dir) -> str:
    """JSON records below <model>/<epoch>/<record>: mean quality of documents by language and id."""
    path = fresh_folder(spark)
    rows = table(spark, sf_dir, "labels", "doc_id", "quality").join(
        table(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id"
    )
    scored = rows.groupBy(F.col("lang").alias("model"), (F.col("doc_id") % 5).alias("epoch")).agg(
        F.avg("quality").alias("score"), F.count(F.lit(1)).alias("rows")
    )
    # One row a folder, so one record a file.
    scored.withColumn("record", F.lit("best")).write.partitionBy("model", "epoch", "record").json(path)
    return f"{path}/*/*/*/*.json"


def json_records(spark, sf_dir):
    records = read_records(spark, _records(spark, sf_dir), "score double, rows long")
    return rounded(records.withColumn("record", C.path_part("filename", -2)).drop("filename"), "score")


def record_roundtrip(spark, sf_dir):
    """The largest source of documents, written as a record and read back."""
    path = fresh_folder(spark)
    counted = table(spark, sf_dir, "documents", "source", "lang").groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("lang").alias("languages"),
        F.lit(None).cast("double").alias("score"),
    )
    write_record(counted.orderBy(F.desc("rows"), "source").limit(1), f"{path}/best")
    schema = "source string, rows long, languages long, score double"
    return read_records(spark, f"{path}/best/*.json", schema).drop("filename")


def files_roundtrip(spark, sf_dir):
    """Labels written as a fixed number of files, and by size, and read back with their number of files."""
    path = fresh_folder(spark)
    rows = table(spark, sf_dir, "labels")
    write_files(rows, f"{path}/fixed", files=3)
    write_files(rows, f"{path}/sized")
    fixed, sized = (read_columns(spark, f"{path}/{name}", ["doc_id", "quality", "toxic"]) for name in ("fixed", "sized"))
    files = fixed.select(F.col("_metadata.file_path").alias("file")).distinct().count()
    return fixed.withColumn("files", F.lit(files)).unionByName(sized.withColumn("files", F.lit(None).cast("int")))


def leaderboard_rows(spark, sf_dir):
    return rounded(leaderboard(spark, _records(spark, sf_dir)), "score")


def leaderboard_top(spark, sf_dir):
    return rounded(top_runs(leaderboard(spark, _records(spark, sf_dir)), 3), "score")


def leaderboard_epochs(spark, sf_dir):
    return rounded(score_by_epoch(leaderboard(spark, _records(spark, sf_dir)), "%e%"), "score")


def partitioned_roundtrip(spark, sf_dir):
    path = fresh_folder(spark)
    write_partitioned(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars"), path, ["lang"])
    return read_columns(spark, path, ["doc_id", "lang", "source", "n_chars"])


def samples_roundtrip(spark, sf_dir):
    path = fresh_folder(spark)
    write_samples(table(spark, sf_dir, "labels"), path, "doc_id", 10)
    return read_columns(spark, path, ["doc_id", "quality", "toxic", "sample_id"])


def reconcile(spark, sf_dir):
    return key_differences(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), "doc_id")


def file_listing(spark, sf_dir):
    """Document numbers as text files, a folder per language, read back as bytes."""
    path = fresh_folder(spark)
    lines = table(spark, sf_dir, "documents", "doc_id", "lang").select(F.col("doc_id").cast("string").alias("value"), "lang")
    lines.write.option("maxRecordsPerFile", 1_000_000).partitionBy("lang").text(path)
    files = read_files(spark, path, "*.txt")
    return files.groupBy(C.path_part("path", -2).alias("folder")).agg(
        F.sum("length").alias("bytes"), F.sum(F.size(F.split("content", "\n")) - 1).alias("lines")
    )


def byte_counts(name: str):
    """A model whose outputs are the numbers of bytes and of spaces."""

    def model(batch: np.ndarray) -> dict[str, np.ndarray]:
        data = [bytes(b) for b in batch]
        return {
            "cls": np.array([[len(b)] for b in data], dtype="float32"),
            "avg_patch": np.array([[b.count(b" ")] for b in data], dtype="float32"),
        }

    return model


def pipeline_embed(spark, sf_dir):
    """The embedding stage after it was saved and loaded with its pipeline."""
    path = fresh_folder(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.encode("text", "utf-8").alias("content"))
    stages = [embedding.BatchEmbedder(factory=f"{__name__}:byte_counts", modelName="byte-counts", batchSize=64)]
    Pipeline(stages=stages).fit(docs).save(path)
    return PipelineModel.load(path).transform(docs).select(
        "doc_id", F.col("token.cls")[0].cast("long").alias("bytes"), F.col("token.avg_patch")[0].cast("long").alias("spaces")
    )


def decode_labels(spark, sf_dir):
    rows = images(spark, sf_dir).select("image_id", "identity").where(C.is_known())
    codes = stage(encode_labels(rows, "identity"))
    coded = joins.attach_by_key(rows, codes, "identity").select("image_id", "label_id")
    return joins.decode_labels(coded, codes)


def best_crossover(spark, sf_dir):
    train, val = train_and_val(spark, sf_dir)
    return rounded(sweep.best_row(sweep.experiment(train, val, [5])[0], by="crossover_score"), *SWEEP)


def final_labels_recalibrated(spark, sf_dir):
    return _label_unknown(spark, sf_dir, recalibrate=True)


def final_labels_one_dataset(spark, sf_dir):
    return _label_unknown(spark, sf_dir, dataset="SalamanderID2025")


REGISTERED = (
    csv_roundtrip, json_records, record_roundtrip, files_roundtrip, leaderboard_rows, leaderboard_top, leaderboard_epochs, partitioned_roundtrip,
    samples_roundtrip, reconcile, file_listing, pipeline_embed, decode_labels, best_crossover,
    final_labels_recalibrated, final_labels_one_dataset,
)

RUNS = """
WITH runs AS (
  SELECT 'model=' || lang AS model, 'epoch=' || (doc_id % 5) AS epoch, (doc_id % 5)::INT AS number,
         avg(quality) AS score, count(*) AS rows
  FROM labels JOIN documents USING (doc_id) GROUP BY ALL)"""

SQL: dict[str, str] = {
    "csv_roundtrip": """
SELECT doc_id::VARCHAR AS image_id, source AS identity, lang || '/' || doc_id AS path, NULL::VARCHAR AS date,
       'left, "top"' AS orientation, lang AS species, 'database' AS split, source AS dataset FROM documents""",
    "json_records": f"{RUNS} SELECT round(score, 6) AS score, rows, 'record=best' AS record FROM runs",
    "record_roundtrip": """
SELECT source, count(*) AS rows, count(DISTINCT lang) AS languages, NULL::DOUBLE AS score
FROM documents GROUP BY source ORDER BY 2 DESC, 1 LIMIT 1""",
    "files_roundtrip": """
SELECT doc_id, quality, toxic, 3::INT AS files FROM labels UNION ALL
SELECT doc_id, quality, toxic, NULL::INT AS files FROM labels""",
    "leaderboard_rows": f"""{RUNS}
SELECT model, epoch, number AS epoch_number, round(score, 6) AS score, rows FROM runs""",
    "leaderboard_top": f"""{RUNS}
SELECT model, epoch, round(score, 6) AS score FROM runs ORDER BY runs.score DESC, model, epoch LIMIT 3""",
    "leaderboard_epochs": f"""{RUNS}
SELECT model, number AS epoch_number, round(score, 6) AS score FROM runs WHERE model LIKE '%e%'""",
    "partitioned_roundtrip": "SELECT doc_id, lang, source, n_chars FROM documents",
    "samples_roundtrip": f"""
WITH s AS ({oracles.CRC_BUCKET.replace("vec_id", "doc_id").replace("FROM embeddings", "FROM labels")})
SELECT doc_id, quality, toxic, sample_id::INT AS sample_id FROM labels JOIN s ON image_id = doc_id""",
    "reconcile": """
SELECT doc_id, coalesce(a, 0) AS left_rows, coalesce(b, 0) AS right_rows
FROM (SELECT doc_id, count(*) AS a FROM documents GROUP BY 1)
FULL JOIN (SELECT doc_id, count(*) AS b FROM labels GROUP BY 1) USING (doc_id)
WHERE coalesce(a, 0) <> coalesce(b, 0)""",
    "file_listing": """
SELECT 'lang=' || lang AS folder, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes, count(*) AS lines
FROM documents GROUP BY lang""",
    "pipeline_embed": oracles.SQL["batch_embed"],
    "decode_labels": f"""WITH {oracles.IMAGES}, c AS (
  SELECT image_id, identity, dense_rank() OVER (ORDER BY identity) - 1 AS label_id FROM known)
SELECT image_id, label_id, identity FROM c""",
    "best_crossover": oracles.SQL["best_threshold"].replace("ORDER BY score", "ORDER BY crossover_score"),
    "final_labels_recalibrated": oracles.SQL["final_labels"].replace(
        "best AS (SELECT threshold, median, mad FROM swept ORDER BY score DESC NULLS LAST, threshold LIMIT 1),",
        "chosen AS (SELECT threshold FROM swept ORDER BY score DESC NULLS LAST, threshold LIMIT 1),"
        + oracles.null_stats("again", "known", (3,))
        + ", best AS (SELECT threshold, median, mad FROM chosen, again_s),",
    ),
    "final_labels_one_dataset": oracles.SQL["final_labels"].replace(
        "FROM embeddings)", "FROM embeddings WHERE label % 3 = 1)"
    ),
}
