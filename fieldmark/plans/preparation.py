"""Jobs from files to embeddings."""

from __future__ import annotations

import os
import re

from pyspark.ml import Pipeline, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.columns import relative_path
from fieldmark.operators.embedding import LinearHead, NonlinearHead, project
from fieldmark.sources.tables import (
    read_columns,
    read_files,
    read_metadata,
    require_equal_counts,
    sample_bucket,
    sample_path,
    write_files,
    write_partitioned,
)


#: Estimated bytes up to which the keys of images are sent to every executor.
NARROW_BYTES = 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of ``df``; of a Parquet table it follows the sizes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def write_images(
    images: DataFrame, keys: DataFrame, path: str, num_partitions: int | None = None, narrow: int = NARROW_BYTES
) -> DataFrame:
    """Write ``images`` with their ``keys`` (joined on path) in ``dataset=/split=`` directories; returns the rows written.

    The bytes of an image move once. Keys of at most ``narrow`` estimated bytes are broadcast and only the sink deals
    the rows out. Larger ones meet the images in a shuffle by path, whose tasks write what they hold.
    """
    by = ["dataset", "split"]
    if estimated_bytes(keys) <= narrow:
        joined = images.join(F.broadcast(keys), "path", "left")
        write_partitioned(joined, path, by, num_partitions, spread="path")
        return joined
    if num_partitions is not None:
        images, keys = (df.repartition(num_partitions, "path") for df in (images, keys))
    joined = images.join(keys.hint("merge"), "path", "left")
    joined.write.mode("overwrite").partitionBy(*by).parquet(path)
    return joined


def _absolute(path: str) -> str:
    return path if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:/", path) else os.path.abspath(path)


def prepare_images(
    spark: SparkSession, input_root: str, output_root: str, num_partitions: int | None = None
) -> None:
    """Turn ``metadata.csv`` and ``images/`` into two Parquet tables.

    ``metadata`` keeps the CSV; ``images`` holds the file bytes with image_id,
    in ``dataset=/split=`` directories. Without ``num_partitions`` their tasks
    follow size. Fails if the row counts differ.
    """
    root = _absolute(input_root)
    metadata_path = f"{output_root}/parquet/metadata"
    images_path = f"{output_root}/parquet/images"
    metadata = read_metadata(spark, f"{root}/metadata.csv")
    write_files(metadata, metadata_path)

    images = read_files(spark, f"{root}/images").withColumn("path", relative_path("path", root))
    keys = read_columns(spark, metadata_path, ["image_id", "path", "dataset", "split"])
    write_images(images, keys, images_path, num_partitions)
    require_equal_counts(
        spark.read.parquet(metadata_path), spark.read.parquet(images_path), "metadata and images"
    )


def embed_images(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    embedder: Transformer,
    sample_id: int | None = None,
    num_sample_ids: int = 10,
    num_partitions: int | None = None,
) -> str:
    """Run an embedding stage over an image table and write (image_id, output).

    With ``sample_id`` only that hash bucket is done, into its own partition
    directory, so that several jobs can share the work. Returns the path.
    """
    df = spark.read.parquet(input_path)
    if sample_id is not None:
        df = sample_bucket(df, "image_id", sample_id, num_sample_ids)
        output_path = sample_path(output_path, sample_id)
    embedded = Pipeline(stages=[embedder]).fit(df).transform(df)
    write_files(embedded.select("image_id", embedder.getOutputCol()), output_path, num_partitions)
    return output_path


def project_embeddings(
    metadata: DataFrame,
    embeddings: DataFrame,
    head: LinearHead | NonlinearHead,
    output_path: str,
    vector: str = "embeddings",
) -> None:
    """Project the embeddings that have metadata and write them sorted by image_id."""
    kept = embeddings.select("image_id", vector).join(metadata.select("image_id"), "image_id")
    # The sort samples its input, so it comes before the model, which keeps the order.
    projected = project(kept.sort("image_id"), head, vector).select("image_id", F.col(vector).alias("embeddings"))
    projected.write.mode("overwrite").parquet(output_path)
