"""Exact ranks and order statistics without a one-partition window.

Two orders are needed. A *hash order* stands in for a seeded shuffle; because
hashes are evenly spread, a prefix of the hash cuts any group, however large,
into even slices. A *value order* has no such property and is sorted by range; single
order statistics are selected by histograms, without a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators import kernels
from fieldmark.sources.staging import stage

# Four hex digits of the hash: at most 65,536 slices per group.
SLICE_DIGITS = 4


def hash_order(seed: int, key: str | Column) -> Column:
    """Text whose order is a reproducible shuffle of ``key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def rank_by_hash(
    df: DataFrame,
    key: str,
    seed: int,
    *,
    within: Sequence[str] = (),
    side: DataFrame | None = None,
    weight: str | None = None,
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Add each row's 1-based place in the hash order of its group.

    ``within`` names the group columns (none: the whole table); ``size`` gets
    the row count of the group. ``key`` must be unique within the group; rows
    of a NULL group have no rank and are left out. ``side`` optionally holds one
    row per group: its columns are added and groups it lacks are left out. With
    a ``weight``, ranks and sizes are its inclusive running and total sums.

    Rows are shuffled by (group, hash slice). A group with a third of all rows
    is thus spread over up to 65,536 slices; what its slices have to know about
    each other is a table of at most as many counts. ``df`` is read twice: stage
    it if it is costly.
    """
    within = list(within)
    tagged = df.withColumn("_hash", hash_order(seed, key)).withColumn(
        "_slice", F.substring("_hash", 1, SLICE_DIGITS)
    )
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    slices = tagged.groupBy(*within, "_slice").agg(F.sum(amount).alias("_rows"))
    by_group = Window.partitionBy(*within)
    before = by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *within,
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_group).alias(size),
    )
    extra = []
    if side is not None:
        extra = [c for c in side.columns if c not in within]
        slices = slices.join(side, within)
    if not within:
        # At most 65,536 rows, whatever the table holds.
        slices = F.broadcast(slices)
    on = [*within, "_slice"]
    joined = tagged.join(slices, on).select(
        *tagged.columns, "_before", size, *extra
    )
    in_slice = Window.partitionBy(*on).orderBy("_hash", key)
    if weight:
        place = F.sum(weight).over(in_slice.rowsBetween(Window.unboundedPreceding, 0))
    else:
        place = F.row_number().over(in_slice)
    return joined.withColumn(rank, F.col("_before") + place).drop(
        "_hash", "_slice", "_before"
    )


def running_total(
    df: DataFrame,
    order: Sequence[str],
    weight: str | None = None,
    out: str = "running",
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` (default 1) in value order.

    The order columns must be unique; group equal values first. The frame is
    range-sorted and written once, which pins every row to its partition;
    totals then run inside partitions, on top of one offset per partition.
    """
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    pinned = stage(df.sort(*order).withColumn("_part", F.spark_partition_id()))
    parts = pinned.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy("_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One offset per shuffle partition of the sort.
    return (
        pinned.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.sum(amount).over(inside))
        .select(*df.columns, out)
    )


def encode_labels(df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Table of distinct labels with codes 0..n-1 in sorted order; no NULL."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    ranked = running_total(distinct, [label], out=out)
    return ranked.withColumn(out, F.col(out) - 1)


#: Bits of a value that one histogram tells apart.
DIGIT_BITS = 16


def as_ordered_bits(value: str) -> Column:
    """Doubles as longs in the same order."""

    def bits(values: pd.Series) -> pd.Series:
        return pd.Series(kernels.ordered_bits(values.to_numpy()))

    return F.pandas_udf(bits, "long")(F.col(value).cast("double"))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], *, by: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, one column per name.

    ``by`` (few distinct values, such as neighbour counts) gives one row per
    value. Order statistics are found digit by digit: a histogram of the
    leading 16 bits says which bin each of them is in, and the next pass
    counts only inside these bins. A bin of equal values needs no further pass, and
    after four passes every bin is one. Each pass is one aggregate for all groups and
    quantiles, combined before its shuffle; it returns at most 2**16 bins for each bin
    that was open. Nothing is sorted and nothing written. ``df`` is read once
    a pass: stage it if it is costly.
    """
    groups = [by] if by else []
    bits = df.where(F.col(value).isNotNull()).select(*groups, as_ordered_bits(value).alias("_bits"))
    found: dict = {}
    shares: dict = {}
    # Open bins: (group, leading bits) with the places, counted from the bin's start, that are looked for in it.
    open_bins: dict = {}
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("_bits", shift).alias("_digit")
        inside = bits
        if shift < 64 - DIGIT_BITS:
            if not open_bins:
                break
            wanted = F.lit(False)
            for group, prefixes in _by_group(open_bins).items():
                mine = F.col(by).eqNullSafe(F.lit(group)) if by else F.lit(True)
                wanted = wanted | (mine & F.shiftright("_bits", shift + DIGIT_BITS).isin(prefixes))
            inside = bits.where(wanted)
        counted = inside.groupBy(*groups, digit).agg(
            F.count(F.lit(1)).alias("n"), F.min("_bits").alias("low"), F.max("_bits").alias("high")
        )
        bins: dict = {}
        for row in counted.collect():
            group = row[by] if by else None
            prefix = row["_digit"] >> DIGIT_BITS if open_bins else None
            bins.setdefault((group, prefix), []).append((row["_digit"], row["n"], row["low"], row["high"]))
        if not open_bins:
            for group, _ in bins:
                n = sum(b[1] for b in bins[group, None])
                places = set()
                for name, p in probabilities.items():
                    place = p * (n - 1)
                    low = int(place)
                    high = min(low + 1, n - 1)
                    shares[group, name] = (low, high, place - low)
                    places |= {low, high}
                open_bins[group, None] = [(place, place) for place in places]
        still_open: dict = {}
        for at, places in open_bins.items():
            group, before = at[0], 0
            places = sorted(places)
            for digit_value, n, low, high in sorted(bins[at]):
                here = [(place - before, name) for place, name in places if before <= place < before + n]
                if low == high:
                    found.update({(group, name): kernels.from_ordered_bits(low) for _, name in here})
                elif here:
                    still_open[group, digit_value] = here
                before += n
        open_bins = still_open
    rows = {}
    for (group, name), (low, high, share) in shares.items():
        at_low, at_high = found[group, low], found[group, high]
        rows.setdefault(group, {})[name] = at_low + (at_high - at_low) * share
    if not by and not rows:
        rows[None] = dict.fromkeys(probabilities)
    fields = [df.schema[c] for c in groups] + [T.StructField(name, T.DoubleType()) for name in probabilities]
    table = [(*([group] if by else []), *(values[name] for name in probabilities)) for group, values in rows.items()]
    return df.sparkSession.createDataFrame(table, T.StructType(fields))


def _by_group(open_bins: dict) -> dict:
    prefixes: dict = {}
    for group, prefix in open_bins:
        prefixes.setdefault(group, []).append(prefix)
    return prefixes
