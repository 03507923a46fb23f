"""Row numbers for files whose only link is the order of their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.operators.joins import attach_by_key

# Up to this many files, their offsets are broadcast.
FEW_FILES = 50_000


def row_numbers(spark: SparkSession, path: str, out: str = "row_number") -> DataFrame:
    """Parquet rows with their 0-based position in file order.

    Files follow each other by name. The position inside a file comes from the
    Parquet reader, so it depends neither on how files are split into tasks nor
    on a re-run of a task; only one row count per file is summed up.
    """
    df = spark.read.parquet(path)
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
    )
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        located.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    if len(df.inputFiles()) <= FEW_FILES:
        joined = located.join(F.broadcast(files), "_file")
    else:
        joined = attach_by_key(located, files, "_file", "inner")
    return joined.select(*df.columns, (F.col("_before") + F.col("_index")).alias(out))


def positional_zip(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("row_number",)
) -> DataFrame:
    """Join numbered rows pairwise, e.g. on ``row_number`` or also on a ``split``."""
    return left.join(right, list(keys))
