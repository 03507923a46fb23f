"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that are looked for as heavy, and the share of all rows from which one is.
HEAVY_KEYS = 256
HEAVY_SHARE = 1 / 1024


def _frequent(rows: DataFrame, key: str) -> tuple[list[tuple], int]:
    """The most frequent non-NULL keys, at most ``HEAVY_KEYS``, with their counts, and the non-NULL rows.

    A frequent-items summary is built in every task and the summaries are merged in one aggregate, so neither the
    number of keys nor their skew matters. Its counts may be off by a small share of all rows, unless it
    holds every key: then they are exact.
    """
    found = rows.where(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(HEAVY_KEYS), F.lit(4 * HEAVY_KEYS)).alias("top"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    return [(item["item"], item["count"]) for item in found["top"] or []], found["n"]


def heavy_keys(rows: DataFrame, key: str) -> list:
    """The non-NULL keys that own a large share of the rows, at most ``HEAVY_KEYS``.

    A key just below the share may be taken for a heavy one, which costs nothing but its place in the list.
    """
    top, n = _frequent(rows, key)
    return [item for item, count in top if count >= HEAVY_SHARE * n]


def attach_by_key(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a one-row-per-key table to rows whose keys may be very uneven; NULL keys meet each other.

    Heavy keys are found first; there are few of them, so their rows of ``table`` are broadcast and the rows that
    have them stay where they are. All other keys, each with a small share, take a plain join; where
    the summary holds every key there are no others. ``rows`` are read twice more: stage them if they are costly.
    """
    right = table.withColumnRenamed(key, "_key")
    top, n = _frequent(rows, key)
    every = len(top) < HEAVY_KEYS and sum(count for _, count in top) == n
    heavy = [item for item, count in top if every or count >= HEAVY_SHARE * n]

    def is_heavy(column: str) -> Column:
        return F.col(column).isNull() | F.col(column).isin(heavy)

    # At most one row per heavy key and one for NULL.
    few = F.broadcast(right.where(is_heavy("_key")))
    same = F.col(key).eqNullSafe(F.col("_key"))
    if every:
        return rows.join(few, same, how).drop("_key")
    hot = rows.where(is_heavy(key)).join(few, same, how)
    light = rows.where(~is_heavy(key)).join(right.where(~is_heavy("_key")), F.col(key) == F.col("_key"), how)
    return light.unionByName(hot).drop("_key")


def group_count(rows: DataFrame, key: str, counted: str, out: str = "identity_count") -> DataFrame:
    """Attach to each row how many non-NULL ``counted`` values its key has.

    NULL keys form one group. Equal to a count over a window partitioned by
    ``key``, but no task ever holds a whole key: counts are combined before their
    one shuffle and joined back as ``attach_by_key`` does.
    """
    counts = rows.groupBy(key).agg(F.count(counted).alias(out))
    return attach_by_key(rows, counts, key, "inner")


def decode_labels(rows: DataFrame, codes: DataFrame, code: str = "label_id") -> DataFrame:
    """Add to coded rows the label of their ``code``; NULL for a code that ``codes`` lacks."""
    return attach_by_key(rows, codes, code)


def missing_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def rows_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL keys of ``left`` that ``right`` lacks."""
    wanted = left.select(key).where(F.col(key).isNotNull()).distinct()
    return wanted.join(right.select(key).distinct(), key, "left_anti")


def key_overlap(parts: DataFrame, part: str, key: str) -> DataFrame:
    """Distinct keys shared by each two parts, as (left_part, right_part, shared).

    A key contributes the list of the parts it is in, and there are few parts,
    so pairs are made from part names and never from rows.
    """
    where_seen = (
        parts.select(part, key)
        .where(F.col(key).isNotNull())
        .distinct()
        .groupBy(key)
        .agg(F.collect_set(part).alias("seen"))
    )
    return (
        where_seen.groupBy("seen")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("seen", "n", F.explode("seen").alias("left_part"))
        .select("n", "left_part", F.explode("seen").alias("right_part"))
        .groupBy("left_part", "right_part")
        .agg(F.sum("n").alias("shared"))
    )
