"""Triplet sampling, in-batch semi-hard mining and triplet losses."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.columns import hinge
from fieldmark.functions.vectors import l2, prefix
from fieldmark.operators import kernels
from fieldmark.operators.joins import group_count
from fieldmark.operators.ranking import rank_by_hash
from fieldmark.sources.staging import stage

# Fixed value: added to each difference of a paired distance, not of a matrix one.
PAIR_EPS = 1e-6
BATCH_SIZE = 200


def triplet_rows(
    metadata: DataFrame, *, key: str = "image_id", label: str = "identity", split: str = "split"
) -> DataFrame:
    """Database rows whose identity has at least two of them."""
    rows = metadata.where((F.col(split) == "database") & F.col(label).isNotNull())
    return group_count(rows, label, key, "_n").where(F.col("_n") >= 2).drop("_n")


def random_integer(seed: int, *parts: str | Column) -> Column:
    """Reproducible non-negative integer below 2**60 from the given values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _draws(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))


def sample_positives(
    rows: DataFrame, n: int = 1, seed: int = 42, *, key: str = "image_id", label: str = "identity"
) -> DataFrame:
    """``n`` draws with replacement per row among the other rows of its identity.

    Returns (anchor_id, draw, positive_id). Rows are numbered inside their
    identity and a draw names a number, so one equi-join on (identity, number)
    fetches it: the candidates of an anchor are never listed.
    """
    numbered = stage(
        rank_by_hash(rows.select(key, label), key, seed, within=[label], rank="_place", size="_n")
    )
    draws = _draws(numbered.where(F.col("_n") > 1), n)
    pick = random_integer(seed, key, F.col("draw").cast("string")) % (F.col("_n") - 1) + 1
    wanted = draws.withColumn("_pick", pick).select(
        F.col(key).alias("anchor_id"), "draw", label,
        F.when(F.col("_pick") < F.col("_place"), F.col("_pick")).otherwise(F.col("_pick") + 1).alias("_place"),
    )
    found = numbered.select(F.col(key).alias("positive_id"), label, "_place")
    return wanted.join(found, [label, "_place"]).select("anchor_id", "draw", "positive_id")


def _numbered_by_identity(
    rows: DataFrame, scope: list[str], seed: int, key: str, label: str
) -> DataFrame:
    """Number the rows of each scope so that an identity holds one stretch of numbers.

    Adds _place, the stretch's start _start and length _n, and the scope size _all.
    """
    sizes = rows.where(F.col(label).isNotNull()).groupBy(*scope, label).agg(F.count(F.lit(1)).alias("_rows"))
    stretches = rank_by_hash(
        sizes, label, seed, within=scope, weight="_rows", rank="_end", size="_all"
    ).select(*scope, label, (F.col("_end") - F.col("_rows")).alias("_start"), "_all")
    inside = rank_by_hash(
        rows.select(key, *scope, label), key, seed, within=[*scope, label],
        side=stretches, rank="_inner", size="_n",
    )
    return inside.select(
        key, *scope, label, (F.col("_start") + F.col("_inner")).alias("_place"), "_start", "_n", "_all"
    )


def sample_negatives(
    rows: DataFrame,
    n: int = 1,
    seed: int = 42,
    same_dataset: bool = False,
    *,
    key: str = "image_id",
    label: str = "identity",
    dataset: str = "dataset",
) -> DataFrame:
    """``n`` draws with replacement per row among the rows of other identities.

    Returns (anchor_id, draw, negative_id); ``same_dataset`` keeps to the
    anchor's dataset. An identity owns one stretch of row numbers, so a draw
    from the others is a number outside it, fetched by one equi-join.
    """
    scope = [dataset] if same_dataset else []
    numbered = stage(_numbered_by_identity(rows, scope, seed, key, label))
    draws = _draws(numbered.where(F.col("_all") > F.col("_n")), n)
    pick = random_integer(seed, key, F.col("draw").cast("string")) % (F.col("_all") - F.col("_n")) + 1
    wanted = draws.withColumn("_pick", pick).select(
        F.col(key).alias("anchor_id"), "draw", *scope,
        F.when(F.col("_pick") <= F.col("_start"), F.col("_pick"))
        .otherwise(F.col("_pick") + F.col("_n"))
        .alias("_place"),
    )
    found = numbered.select(F.col(key).alias("negative_id"), *scope, "_place")
    return wanted.join(found, [*scope, "_place"]).select("anchor_id", "draw", "negative_id")


def candidate_counts(
    rows: DataFrame, *, key: str = "image_id", label: str = "identity", dataset: str = "dataset"
) -> DataFrame:
    """How many positives and negatives each row may be paired with.

    Returns (key, positives, negatives, negatives_same_dataset), by counting:
    an identity's rows, its rows in the dataset, the dataset and the table.
    """
    labelled = rows.where(F.col(label).isNotNull()).select(key, label, dataset)
    per_cell = labelled.groupBy(dataset, label).agg(F.count(F.lit(1)).alias("_cell"))
    cells = stage(per_cell)
    # One row per dataset, and one in all.
    datasets = cells.groupBy(dataset).agg(F.sum("_cell").alias("_dataset"))
    total = cells.agg(F.sum("_cell").alias("_all"))
    identities = cells.groupBy(label).agg(F.sum("_cell").alias("_identity"))
    sizes = (
        cells.join(identities, label)
        .join(datasets, dataset)
        .select("*", total.select("_all").scalar().alias("_all"))
    )
    ranked = rank_by_hash(labelled, key, 0, within=[dataset, label], side=sizes)
    return ranked.select(
        key,
        (F.col("_identity") - 1).alias("positives"),
        (F.col("_all") - F.col("_identity")).alias("negatives"),
        (F.col("_dataset") - F.col("_cell")).alias("negatives_same_dataset"),
    )


def assign_batches(
    rows: DataFrame, batch_size: int = BATCH_SIZE, seed: int = 42, *, key: str = "image_id"
) -> DataFrame:
    """Shuffle the rows into batches of exactly ``batch_size`` (the last may be smaller)."""
    ranked = rank_by_hash(rows, key, seed, rank="_place", size="_n")
    return ranked.select(
        *rows.columns, F.floor((F.col("_place") - 1) / F.lit(batch_size)).cast("long").alias("batch")
    )


def batch_distances(
    batched: DataFrame, *, key: str = "image_id", vector: str = "embeddings"
) -> DataFrame:
    """Plain distances of each row to the others of its batch, summarised.

    Returns (key, batch, others, nearest, farthest, mean). The distance matrix
    of a batch lives inside its task, a slab of rows at a time.
    """
    schema = T.StructType(
        [
            T.StructField(key, batched.schema[key].dataType),
            T.StructField("batch", T.LongType()),
            T.StructField("others", T.IntegerType()),
            T.StructField("nearest", T.DoubleType()),
            T.StructField("farthest", T.DoubleType()),
            T.StructField("mean", T.DoubleType()),
        ]
    )

    def summarise(batch: pa.Table) -> pa.Table:
        vectors = kernels.matrix(batch[vector])
        n = len(vectors)
        low, high, mean = (np.full(n, np.nan) for _ in range(3))
        if n > 1:
            for start, stop in kernels.slabs(n, vectors):
                gaps = kernels.plain_distances(vectors[start:stop], vectors)
                # A row's distance to itself is 0 and left out.
                own = (np.arange(stop - start), np.arange(start, stop))
                mean[start:stop] = gaps.sum(axis=1) / (n - 1)
                high[start:stop] = gaps.max(axis=1)
                gaps[own] = np.inf
                low[start:stop] = gaps.min(axis=1)
        return pa.table(
            [batch[key], batch["batch"], pa.array([n - 1] * n, pa.int32())]
            + [pa.array(v, mask=np.full(n, n < 2)) for v in (low, high, mean)],
            names=schema.names,
        )

    return batched.select(key, "batch", vector).groupBy("batch").applyInArrow(summarise, schema)


def mine_semi_hard(
    rows: DataFrame,
    *,
    margin: float = 1.0,
    batch_size: int = BATCH_SIZE,
    triplets_per_anchor: int = 1,
    seed: int = 42,
    eps: float = PAIR_EPS,
    key: str = "image_id",
    label: str = "identity",
    vector: str = "embeddings",
) -> DataFrame:
    """Semi-hard triplets: (batch, anchor_id, draw, positive_id, negative_id, dp, dn).

    A positive is drawn for every anchor. Among the anchor's batch, rows of
    other identities with ``dp < dn < dp + margin`` qualify and the nearest is
    taken, the smaller key on ties; anchors without one give no triplet. The
    positive distance adds ``eps`` to each difference, the batch ones do not.
    Batches and draws are made on keys; vectors join when both are known. Stage
    ``rows`` first if they are costly, because they are read three times.
    """
    batched = stage(assign_batches(rows.select(key, label), batch_size, seed, key=key))
    drawn = sample_positives(batched, triplets_per_anchor, seed, key=key, label=label)
    vectors = rows.select(key, vector)
    positives = vectors.select(F.col(key).alias("positive_id"), F.col(vector).alias("_positive"))
    # triplets_per_anchor rows per group.
    fetched = (
        drawn.join(positives, "positive_id")
        .groupBy(F.col("anchor_id").alias(key))
        .agg(F.sort_array(F.collect_list(F.struct("draw", "positive_id", "_positive"))).alias("_fetched"))
    )
    measured = F.transform(
        "_fetched",
        lambda x: F.struct(
            x.getField("draw").alias("draw"),
            x.getField("positive_id").alias("positive_id"),
            l2(F.col(vector), x.getField("_positive"), eps).alias("dp"),
        ),
    )
    work = (
        batched.join(vectors, key)
        .join(fetched, key, "left")
        .select("batch", key, label, vector, measured.alias("_drawn"))
    )
    id_type = rows.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("batch", T.LongType()),
            T.StructField("anchor_id", id_type),
            T.StructField("draw", T.IntegerType()),
            T.StructField("positive_id", id_type),
            T.StructField("negative_id", id_type),
            T.StructField("dp", T.DoubleType()),
            T.StructField("dn", T.DoubleType()),
        ]
    )

    def mine(batch: pa.Table) -> pa.Table:
        batch = batch.take(pc.sort_indices(batch[key]))
        vectors = kernels.matrix(batch[vector])
        mine_code, their_code = kernels.same_code(batch[label], batch[label])
        drawn_lists = batch["_drawn"].combine_chunks()
        owner = pc.list_parent_indices(drawn_lists).to_numpy(zero_copy_only=False)
        flat = drawn_lists.flatten()
        dp = flat.field("dp").to_numpy(zero_copy_only=False)
        n = len(owner)
        found, negative, dn = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n)
        for start, stop in kernels.slabs(n, vectors):
            # Draws of one anchor lie side by side and share its distances.
            anchors, which = np.unique(owner[start:stop], return_inverse=True)
            gaps = kernels.plain_distances(vectors[anchors], vectors)[which]
            least = dp[start:stop, None]
            fits = (mine_code[owner[start:stop], None] != their_code) & (gaps > least) & (gaps < least + margin)
            gaps[~fits] = np.inf
            best = gaps.argmin(axis=1)
            found[start:stop] = fits.any(axis=1)
            negative[start:stop], dn[start:stop] = best, gaps[np.arange(stop - start), best]
        keep = np.flatnonzero(found)
        kept, anchors = pa.array(keep), pa.array(owner[keep].astype(np.int64))
        return pa.table(
            [
                batch["batch"].take(anchors),
                batch[key].take(anchors),
                flat.field("draw").take(kept),
                flat.field("positive_id").take(kept),
                batch[key].take(pa.array(negative[keep])),
                flat.field("dp").take(kept),
                pa.array(dn[keep]),
            ],
            names=schema.names,
        )

    return work.groupBy("batch").applyInArrow(mine, schema)


def with_vectors(
    triplets: DataFrame, rows: DataFrame, *, key: str = "image_id", vector: str = "embeddings"
) -> DataFrame:
    """Add the vectors of the three members as anchor, positive and negative."""
    for member in ("anchor", "positive", "negative"):
        vectors = rows.select(F.col(key).alias(f"{member}_id"), F.col(vector).alias(member))
        triplets = triplets.join(vectors, f"{member}_id")
    return triplets


def triplet_hinge(
    margin: float = 1.0, eps: float = PAIR_EPS, dims: int | None = None
) -> Column:
    """Hinge of one triplet over the first ``dims`` dimensions, or all."""
    a, p, n = ((F.col(c) if dims is None else prefix(c, dims)) for c in ("anchor", "positive", "negative"))
    return hinge(l2(a, p, eps) - l2(a, n, eps) + F.lit(float(margin)))


def nested_hinge(
    nested_dims: Sequence[int] = (),
    loss_weights: Sequence[float] | None = None,
    margin: float = 1.0,
    eps: float = PAIR_EPS,
) -> Column:
    """Weighted hinge over the full vector and its prefixes.

    A prefix not shorter than the vector adds nothing, but its weight still
    counts in the divisor.
    """
    weights = [1.0] * (1 + len(nested_dims)) if loss_weights is None else list(loss_weights)
    if len(weights) != 1 + len(nested_dims):
        raise ValueError("one weight for the full vector and one per prefix are needed")
    total = F.lit(float(weights[0])) * triplet_hinge(margin, eps)
    for dims, weight in zip(nested_dims, weights[1:]):
        shorter = F.size("anchor") > dims
        total = total + F.when(
            shorter, F.lit(float(weight)) * triplet_hinge(margin, eps, dims)
        ).otherwise(F.lit(0.0))
    return total / F.lit(float(sum(weights)))


def triplet_loss(triplets: DataFrame, margin: float = 1.0, eps: float = PAIR_EPS) -> DataFrame:
    """One row: the mean hinge and the number of triplets."""
    return triplets.agg(
        F.avg(triplet_hinge(margin, eps)).alias("loss"), F.count(F.lit(1)).alias("triplets")
    )


def nested_triplet_loss(triplets: DataFrame, **options) -> DataFrame:
    """One row: the mean nested hinge and the number of triplets."""
    return triplets.agg(
        F.avg(nested_hinge(**options)).alias("loss"), F.count(F.lit(1)).alias("triplets")
    )


def epoch_loss(triplets: DataFrame, **options) -> DataFrame:
    """One row: the mean over batches of the batch means, batches and triplets."""
    per_batch = triplets.groupBy("batch").agg(
        F.avg(nested_hinge(**options)).alias("_loss"), F.count(F.lit(1)).alias("_n")
    )
    return per_batch.agg(
        F.avg("_loss").alias("loss"),
        F.count(F.lit(1)).alias("batches"),
        F.sum("_n").alias("triplets"),
    )
