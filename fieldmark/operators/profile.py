"""Counts, frequency tables, top lists and run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import known_species, query_label
from fieldmark.sources.staging import stage


def count_by(df: DataFrame, *keys: str, drop_null: bool = False) -> DataFrame:
    """Rows per key; ``drop_null`` leaves NULL keys out."""
    if drop_null:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def frequency_of_frequencies(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows, as (freq, count)."""
    sizes = count_by(df, key, drop_null=True).select(F.col("count").alias("freq"))
    return count_by(sizes, "freq")


def describe_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: count, mean, sample deviation, min and max of rows per key."""
    sizes = count_by(df, key)
    return sizes.agg(
        F.count("count").alias("count"),
        F.avg("count").alias("mean"),
        F.stddev_samp("count").alias("stddev"),
        F.min("count").alias("min"),
        F.max("count").alias("max"),
    )


def distinct_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct values with NULL counted as a value, and without."""
    values = df.select(key).distinct()
    return values.agg(
        F.count(F.lit(1)).alias("with_null"), F.count(key).alias("without_null")
    )


def top_values(df: DataFrame, key: str, n: int, skip: int = 0) -> DataFrame:
    """The ``n`` most frequent values after the first ``skip``; ties by value."""
    counts = count_by(df, key, drop_null=True)
    return counts.orderBy(F.col("count").desc(), F.col(key).asc()).offset(skip).limit(n)


def species_profile(
    df: DataFrame, allowed_species: list[str], top: int = 3, more: int = 10
) -> DataFrame:
    """Relabelled species counts and the most frequent identities in one table.

    Rows are (section, value, count): ``species`` over all species, ``top`` for
    the most frequent identities (queries relabelled) and ``next`` for the
    following ones. The identity counts are made once.
    """
    relabelled = df.select(
        query_label("identity", "species", "split").alias("identity"),
        known_species("species", allowed_species).alias("species"),
    )
    species = count_by(relabelled, "species").select(
        F.lit("species").alias("section"), F.col("species").alias("value"), "count"
    )
    leaders = top_values(relabelled, "identity", top + more)
    place = F.row_number().over(Window.orderBy(F.col("count").desc(), "identity"))
    # The window sees at most top + more rows.
    named = leaders.withColumn("_place", place).select(
        F.when(F.col("_place") <= top, "top").otherwise("next").alias("section"),
        F.col("identity").alias("value"),
        "count",
    )
    return species.unionByName(named)


# Rows per window in run_lengths.
RUN_BLOCK = 1 << 20


def run_lengths(
    df: DataFrame, position: str, name: str, block: int = RUN_BLOCK
) -> DataFrame:
    """Runs of equal consecutive ``name`` by ``position``, as (start, name, length).

    ``position`` is a dense 0-based row number, e.g. from ``row_numbers``. Runs
    are found inside blocks of positions. Only the first and last run of a
    block can continue in another one, so just these, two per block, meet in a
    final window.
    """
    cut = df.select(
        F.col(position).alias("_p"), F.col(name).alias("_n"),
        F.floor(F.col(position) / block).cast("long").alias("_b"),
    )
    inside = Window.partitionBy("_b").orderBy("_p")
    fresh = ~F.col("_n").eqNullSafe(F.lag("_n").over(inside)) | (F.row_number().over(inside) == 1)
    island = cut.withColumn("_new", fresh.cast("int")).withColumn(
        "_island", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = island.groupBy("_b", "_island").agg(
        F.min("_p").alias("start"), F.first("_n").alias("name"), F.count(F.lit(1)).alias("length")
    )
    last = F.max("_island").over(Window.partitionBy("_b"))
    runs = stage(runs.withColumn("_edge", (F.col("_island") == 1) | (F.col("_island") == last)))

    ends = Window.orderBy("start")
    edges = runs.where("_edge")
    joins_up = F.col("name").eqNullSafe(F.lag("name").over(ends)) & (
        F.lag(F.col("start") + F.col("length")).over(ends) == F.col("start")
    )
    merged = (
        edges.withColumn("_new", (~F.coalesce(joins_up, F.lit(False))).cast("int"))
        .withColumn("_run", F.sum("_new").over(ends.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_run")
        .agg(F.min("start").alias("start"), F.first("name").alias("name"), F.sum("length").alias("length"))
        .drop("_run")
    )
    return runs.where("NOT _edge").select("start", "name", "length").unionByName(merged)
