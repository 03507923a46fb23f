"""Readers with declared schemas, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.columns import hash_bucket

METADATA_COLUMNS = (
    "image_id", "identity", "path", "date", "orientation", "species", "split", "dataset",
)
METADATA_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in METADATA_COLUMNS])


def read_metadata(
    spark: SparkSession, path: str, schema: T.StructType | None = METADATA_SCHEMA
) -> DataFrame:
    """CSV metadata with a header; ``schema=None`` infers types by an extra scan."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below ``root`` as (path, modificationTime, length, content)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )


def read_columns(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table; only ``columns`` are read from disk if given."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_records(
    spark: SparkSession, pattern: str, schema: T.StructType | None = None
) -> DataFrame:
    """Multi-line JSON files of a path glob, with their ``filename``."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(pattern).select("*", F.col("_metadata.file_path").alias("filename"))


def write_files(df: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite a Parquet table with ``files`` files, or as many as its size asks for."""
    dealt = df.hint("rebalance") if files is None else df.repartition(files)
    dealt.write.mode("overwrite").parquet(path)


def write_partitioned(
    df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None, spread: str | None = None
) -> None:
    """Overwrite a Parquet table laid out in directories by ``keys``.

    Rows are hash-distributed by the keys first, and without ``partitions`` tasks
    are split or merged to Spark's advisory size, so a directory that holds a large
    share of all rows is written by several. With a fixed number of ``partitions``
    it would be one task; name a unique ``spread`` column to avoid that.
    """
    if partitions is None:
        dealt = df.hint("rebalance", *keys)
        dealt.write.mode("overwrite").partitionBy(*keys).parquet(path)
        return
    by = [F.col(k) for k in keys]
    if spread:
        by.append(F.pmod(F.xxhash64(spread), F.lit(partitions)))
    df.repartition(partitions, *by).write.mode("overwrite").partitionBy(*keys).parquet(path)


def sample_bucket(df: DataFrame, key: str, sample_id: int, buckets: int) -> DataFrame:
    """Rows of one hash bucket of ``key``; the buckets are disjoint and complete."""
    return df.where(hash_bucket(key, buckets) == sample_id)


def sample_path(path: str, sample_id: int) -> str:
    """Partition directory of one sample, so that independent jobs fill one table."""
    return f"{path}/sample_id={sample_id}"


def write_samples(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write every sample of ``df`` in one job, replacing only the samples it holds.

    Tasks follow size: a bucket that holds many rows is written by several.
    """
    (
        df.withColumn("sample_id", hash_bucket(key, buckets))
        .hint("rebalance", "sample_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sample_id")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Overwrite a CSV folder with a header; ``single_file`` is for report-sized frames."""
    df = df.coalesce(1) if single_file else df
    df.write.mode("overwrite").option("header", True).csv(path)


def write_record(df: DataFrame, path: str) -> None:
    """Overwrite a JSON folder with a one-row frame, NULL fields included."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def require_equal_counts(left: DataFrame, right: DataFrame, what: str = "outputs") -> None:
    """Fail unless both frames have as many rows."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{what} differ in rows: {a} and {b}")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that do not occur equally often, as (key, left_rows, right_rows)."""
    counts = [
        df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
        for df, n in ((left, "left_rows"), (right, "right_rows"))
    ]
    return (
        counts[0]
        .join(counts[1], key, "full")
        .select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("left_rows", "right_rows")])
        .where("left_rows <> right_rows")
    )
