"""Leakage-free open-set splits, reproducible on any cluster layout.

A seeded shuffle is replaced by the order of a seeded hash; part sizes follow
the usual rule (``floor`` for a given kept share, ``ceil`` for a given rest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import round_half_even
from fieldmark.operators.joins import attach_by_key
from fieldmark.operators.ranking import rank_by_hash, running_total
from fieldmark.sources.staging import stage

TRAIN, VAL, TEST = "train", "val", "test"


def _kept(ratio: float, total: str) -> Column:
    """``floor(ratio * total)``; an empty part fails the query."""
    kept = F.floor(F.lit(float(ratio)) * F.col(total))
    empty = F.raise_error(
        F.format_string(f"a split of %d rows at {ratio} leaves a part empty", F.col(total))
    )
    return F.when((kept > 0) & (kept < F.col(total)), kept).otherwise(empty.cast("long"))


def assign_identities(
    df: DataFrame,
    train_ratio: float = 0.6,
    val_ratio: float = 0.5,
    group_col: str = "identity",
    seed: int = 42,
) -> DataFrame:
    """One row per identity with its part: ``train``, ``val`` or ``test``.

    A share ``train_ratio`` of the identities is known; of the held-out ones a
    share ``val_ratio`` is unknown in validation and the rest in test.
    """
    identities = df.where(F.col(group_col).isNotNull()).select(group_col).distinct()
    ranked = stage(
        rank_by_hash(identities, group_col, seed)
        .withColumn("_known", F.col("rank") <= _kept(train_ratio, "group_size"))
        .select(group_col, "_known")
    )
    held_out = rank_by_hash(ranked.where(~F.col("_known")).select(group_col), group_col, seed + 1)
    unknown = held_out.select(
        group_col,
        F.when(F.col("rank") <= _kept(val_ratio, "group_size"), F.lit(VAL))
        .otherwise(F.lit(TEST))
        .alias("_part"),
    )
    known = ranked.where("_known").select(group_col, F.lit(TRAIN).alias("_part"))
    return known.unionByName(unknown)


def _split_images(
    df: DataFrame,
    identities: DataFrame,
    gallery: Column,
    single: str,
    leftover: Column,
    group_col: str,
    image_col: str,
    seed: int,
    out: str,
) -> DataFrame:
    """Give each image its part, from one hash order per identity.

    The first ``gallery`` images of a known identity are train; of the q that
    follow, the last ``ceil(q / 2)`` are test and the others validation.
    """
    ranked = rank_by_hash(
        df, image_col, seed, within=[group_col], side=identities, rank="_rank", size="_n"
    )
    rest = F.col("_n") - gallery
    to_test = F.col("_rank") > F.col("_n") - F.ceil(rest / F.lit(2.0))
    part = (
        F.when(F.col("_part") != TRAIN, F.col("_part"))
        .when(F.col("_n") == 1, F.lit(single))
        .when(F.col("_rank") <= gallery, F.lit(TRAIN))
        .when(rest == 1, leftover)
        .when(to_test, F.lit(TEST))
        .otherwise(F.lit(VAL))
    )
    return ranked.select(*df.columns, part.alias(out))


def openset_split(
    df: DataFrame,
    train_ratio: float = 0.6,
    val_ratio: float = 0.5,
    known_ratio: float = 0.8,
    group_col: str = "identity",
    image_col: str = "image_id",
    seed: int = 42,
    out: str = "part",
) -> DataFrame:
    """Label every row ``train``, ``val`` or ``test`` for open-set work.

    Identities are divided first. All images of held-out identities are unknown
    queries. A known identity keeps ``known_ratio`` of its images in the train
    gallery and halves the others between validation and test; a single image
    stays in train and a single left-over goes to validation. Pass narrow rows
    and join vectors afterwards: every column given is shuffled.
    """
    identities = assign_identities(df, train_ratio, val_ratio, group_col, seed)
    kept = F.floor(F.lit(float(known_ratio)) * F.col("_n"))
    gallery = F.when(kept > 0, kept).otherwise(
        F.raise_error(F.lit("known_ratio leaves a gallery empty")).cast("long")
    )
    return _split_images(
        df, identities, gallery, TRAIN, F.lit(VAL), group_col, image_col, seed + 2, out
    )


def early_split(
    df: DataFrame,
    train_ratio: float = 0.6,
    val_ratio: float = 0.2,
    known_ratio: float = 0.5,
    group_col: str = "identity",
    image_col: str = "image_id",
    seed: int = 42,
    out: str = "part",
) -> DataFrame:
    """The first variant: single images go to validation.

    The queries of an identity take ``ceil((1 - known_ratio) * n)`` images and
    must be at least two, because there is no rule for a single one.
    """
    identities = assign_identities(df, train_ratio, val_ratio, group_col, seed)
    gallery = F.col("_n") - F.ceil(F.lit(1.0 - known_ratio) * F.col("_n"))
    lone = F.raise_error(F.lit("an identity has one query image to halve")).cast("string")
    return _split_images(
        df, identities, gallery, VAL, lone, group_col, image_col, seed + 2, out
    )


def identity_split(
    df: DataFrame,
    train_ratio: float = 0.6,
    val_ratio: float = 0.5,
    group_col: str = "identity",
    image_col: str = "image_id",
    seed: int = 42,
    out: str = "part",
) -> DataFrame:
    """Divide by identity only: all images of an identity share one part."""
    identities = assign_identities(df, train_ratio, val_ratio, group_col, seed)
    return attach_by_key(df, identities, group_col, "inner").withColumnRenamed(
        "_part", out
    )


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_size: float = 0.2,
    seed: int = 42,
    out: str = "part",
) -> DataFrame:
    """Label rows ``train`` or ``test`` with class shares kept.

    ``ceil(test_size * n)`` rows are tests. Each class first gets the whole
    part of its share of the train rows; the rows still missing go one each to
    the classes with the largest fractions, ties to the smaller label.
    """
    classes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = stage(classes)
    total = classes.agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes"), F.min("_n").alias("least")
    ).first()
    rows = total["rows"] or 0
    tests = -int(-(rows * test_size) // 1)
    train = rows - tests
    if rows == 0 or total["least"] < 2 or min(train, tests) < total["classes"]:
        raise ValueError("every class needs two rows, and every part a row per class")
    share = F.col("_n") / F.lit(float(rows)) * F.lit(float(train))
    shares = classes.select(
        label, F.floor(share).alias("_whole"), (F.floor(share) - share).alias("_minus_fraction")
    )
    missing = train - shares.agg(F.sum("_whole")).first()[0]
    quota = running_total(shares, ["_minus_fraction", label], out="_place").select(
        label, (F.col("_whole") + (F.col("_place") <= missing).cast("long")).alias("_quota")
    )
    ranked = rank_by_hash(df, key, seed, within=[label], side=quota, rank="_rank", size="_n")
    part = F.when(F.col("_rank") <= F.col("_quota"), F.lit(TRAIN)).otherwise(F.lit(TEST))
    return ranked.select(*df.columns, part.alias(out))


def split_summary(
    parts: DataFrame,
    part: str = "part",
    id_col: str = "identity",
    image_col: str = "image_id",
) -> DataFrame:
    """One row per part: individuals, images, shared images, known individuals.

    Overlaps come from one pass that notes, per image and per identity, which
    parts it is in. ``<part>_image_pct`` relates the images shared with that
    part to its size, rounded half-even to two places. Train counts no unknown
    individuals by definition.
    """
    names = (TRAIN, VAL, TEST)

    def seen(key: str) -> DataFrame:
        flags = [F.max((F.col(part) == n).cast("int")).alias(n) for n in names]
        return parts.where(F.col(key).isNotNull()).groupBy(key).agg(*flags)

    def both(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b))

    images = seen(image_col).agg(*[both(a, b).alias(f"{a}_{b}") for a in names for b in names])
    people = seen(id_col).agg(
        *[F.sum(n).alias(f"{n}_ids") for n in names],
        *[both(n, TRAIN).alias(f"{n}_known") for n in names],
    )
    rows = parts.agg(*[F.count_if(F.col(part) == n).alias(f"{n}_rows") for n in names])
    # Three one-row tables, put side by side as scalar subqueries.
    one = rows.select(
        "*",
        images.select(F.struct(*images.columns)).scalar().alias("_images"),
        people.select(F.struct(*people.columns)).scalar().alias("_people"),
    ).select("*", "_images.*", "_people.*")

    def line(n: str) -> Column:
        overlaps = [F.col(f"{m}_{n}").alias(f"{m}_image_overlap") for m in names]
        shares = [
            round_half_even(F.try_divide(F.col(f"{m}_{n}"), F.col(f"{m}_{m}")) * 100.0).alias(
                f"{m}_image_pct"
            )
            for m in names
        ]
        unknown = F.lit(0).cast("long") if n == TRAIN else F.col(f"{n}_ids") - F.col(f"{n}_known")
        return F.struct(
            F.lit(n).alias("split"),
            F.col(f"{n}_ids").alias("num_individuals"),
            F.col(f"{n}_rows").alias("num_images"),
            *overlaps,
            *shares,
            F.col(f"{n}_known").alias("known_individuals"),
            unknown.alias("unknown_individuals"),
        )

    return one.select(F.inline(F.array(*[line(n) for n in names])))
