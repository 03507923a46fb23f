"""Closed-set classification reports and the silhouette score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators import kernels
from fieldmark.operators.grid import even_block, plan_blocks, run_tiles, vector_width
from fieldmark.operators.joins import attach_by_key
from fieldmark.operators.ranking import running_total
from fieldmark.sources.staging import stage


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: the share of right predictions, and the same in percent."""
    share = F.avg((F.col(label) == F.col(prediction)).cast("double"))
    return df.agg(share.alias("accuracy"), (share * 100.0).alias("accuracy_pct"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Non-zero cells as (label, prediction, count)."""
    return df.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("count"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class, with the three summary rows.

    Rows are (class, precision, recall, f1_score, support). ``accuracy`` sits in
    the f1_score column of its row. A zero denominator gives 0. The classes are
    read once; a rollup adds the totals.
    """
    cells = confusion_matrix(df, label, prediction)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(zero)

    def side(c: str, support: Column, predicted: Column, right: Column) -> Column:
        return F.struct(
            F.col(c).cast("string").alias("class"), support.alias("support"),
            predicted.alias("predicted"), right.alias("right"),
        )

    classes = (
        cells.select(
            F.inline(
                F.array(
                    side("label", F.col("count"), zero, hit),
                    side("prediction", zero, F.col("count"), zero),
                )
            )
        )
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "right")])
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    scored = classes.select(
        "class", "support", "right",
        ratio(F.col("right"), F.col("predicted")).alias("precision"),
        ratio(F.col("right"), F.col("support")).alias("recall"),
    ).withColumn(
        "f1_score",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    scores = ("precision", "recall", "f1_score")
    rolled = scored.rollup("class").agg(
        F.grouping("class").alias("_total"),
        F.sum("support").alias("support"),
        F.sum("right").alias("_right"),
        *[F.avg(c).alias(f"_macro_{c}") for c in scores],
        *[(F.sum(F.col(c) * F.col("support"))).alias(f"_weighted_{c}") for c in scores],
    )

    def line(name: Column, values: list[Column]) -> Column:
        return F.struct(
            name.alias("class"), *[v.alias(c) for v, c in zip(values, scores)], F.col("support")
        )

    nothing = F.lit(None).cast("double")
    macro = [F.col(f"_macro_{c}") for c in scores]
    weighted = [ratio(F.col(f"_weighted_{c}"), F.col("support")) for c in scores]
    overall = ratio(F.col("_right"), F.col("support"))
    return rolled.select(
        F.inline(
            F.when(F.col("_total") == 0, F.array(line(F.col("class"), macro))).otherwise(
                F.array(
                    line(F.lit("accuracy"), [nothing, nothing, overall]),
                    line(F.lit("macro avg"), macro),
                    line(F.lit("weighted avg"), weighted),
                )
            )
        )
    )


def silhouette_samples(
    df: DataFrame,
    label: str,
    *,
    key: str = "image_id",
    vector: str = "embeddings",
    piece_rows: int | None = None,
) -> DataFrame:
    """Euclidean silhouette of every row, as (key, label, silhouette).

    Rows meet label blocks in a tile grid. A label with at most ``piece_rows``
    rows lies whole in one block, so its mean distance is known inside the tile
    and only the best other label leaves it. A larger label is cut into pieces
    with a block each, which pass on one partial sum per row. A tile thus emits
    one or two numbers per row. A row alone in its label scores 0.
    """
    df = stage(df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, label, vector))
    width = vector_width(df, vector)
    blocks = plan_blocks(df, width)
    # A quarter of a block, so that whole labels hashed together fill blocks evenly.
    piece_rows = piece_rows or max(1, blocks.rows // blocks.count // 4)
    sizes = stage(df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")))
    shape = sizes.agg(F.count(F.lit(1)).alias("labels")).first()["labels"]
    if not 2 <= shape <= blocks.rows - 1:
        raise ValueError("the number of labels must lie between 2 and rows - 1")

    pieces = F.ceil(F.col("_size") / piece_rows)
    big = F.col("_size") > piece_rows
    plan = sizes.where(big).agg(F.coalesce(F.sum(pieces), F.lit(0)).alias("n")).first()["n"]
    small_blocks = blocks.count
    starts = _piece_starts(sizes, label, big, pieces, small_blocks)
    labelled = attach_by_key(df, sizes.join(starts, label, "left"), label)
    own = (
        F.when(F.col("_start").isNull(), F.pmod(F.xxhash64(label), F.lit(small_blocks)))
        .otherwise(F.col("_start") + F.pmod(F.xxhash64(key), F.col("_pieces")))
        .cast("int")
    )
    labelled = stage(labelled.withColumn("_rb", own).withColumn("_whole", F.col("_start").isNull()))

    left = labelled.select(key, label, vector, even_block(key, blocks).alias("_lb"))
    names = ([key, label, vector], [label, vector, "_size", "_whole"])
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("other", df.schema[label].dataType),
            T.StructField("same", T.BooleanType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("size", T.DoubleType()),
        ]
    )

    def tile(rows: pa.Table, block: pa.Table) -> pa.Table:
        out = {name: [] for name in schema.names}
        if rows.num_rows and block.num_rows:
            coded = block[label].combine_chunks().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            total = kernels.distances_to_labels(
                kernels.matrix(rows[vector]), kernels.matrix(block[vector]), codes
            )
            first = np.unique(codes, return_index=True)[1]
            size = block["_size"].to_numpy()[first].astype(float)
            whole = bool(block["_whole"][0].as_py())
            mine, theirs = kernels.same_code(rows[label], pa.chunked_array([coded.dictionary]))
            same = mine[:, None] == theirs[None, :]
            ids = rows[key].combine_chunks()

            def emit(r, c, is_same, complete):
                out[key].append(ids.take(pa.array(r)))
                out["other"].append(coded.dictionary.take(pa.array(c)))
                out["same"].append(pa.array(np.full(len(r), is_same)))
                out["total"].append(pa.array(total[r, c]))
                unknown = pa.nulls(len(r), pa.float64())
                out["mean"].append(pa.array(total[r, c] / size[c]) if complete else unknown)
                out["size"].append(unknown if complete else pa.array(size[c]))

            r, c = np.nonzero(same)
            emit(r, c, True, False)
            if whole:
                mean = np.where(same, np.inf, total / size[None, :])
                c = np.argmin(mean, axis=1)
                r = np.flatnonzero(np.isfinite(mean[np.arange(len(c)), c]))
                emit(r, c[r], False, True)
            else:
                r, c = np.nonzero(~same)
                emit(r, c, False, False)
        types = [ids.type if rows.num_rows and block.num_rows else rows[key].type,
                 block[label].type, pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table(
            [pa.concat_arrays(v) if v else pa.array([], t) for v, t in zip(out.values(), types)],
            names=schema.names,
        )

    parts = run_tiles(left, labelled, blocks.count, small_blocks + int(plan), tile, schema, names)
    means = parts.groupBy(key, "other", "same").agg(
        F.sum("total").alias("total"),
        F.coalesce(F.min("mean"), F.sum("total") / F.max("size")).alias("mean"),
    )
    per_row = means.groupBy(key).agg(
        F.max(F.when(F.col("same"), F.col("total"))).alias("_inner"),
        F.min(F.when(~F.col("same"), F.col("mean"))).alias("_b"),
    )
    a = F.col("_inner") / (F.col("_size") - 1)
    score = F.when(F.col("_size") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    return (
        labelled.select(key, label, "_size")
        .join(per_row, key)
        .withColumn("_a", F.when(F.col("_size") > 1, a))
        .select(key, label, score.alias("silhouette"))
    )


def _piece_starts(sizes, label, big, pieces, first) -> DataFrame:
    """First block of each large label."""
    large = running_total(sizes.where(big).select(label, pieces.alias("_pieces")), [label], "_pieces", "_upto")
    return large.select(label, "_pieces", (F.lit(first) + F.col("_upto") - F.col("_pieces")).alias("_start"))


def silhouette_score(df: DataFrame, label: str, **names) -> DataFrame:
    """One row: the mean silhouette."""
    return silhouette_samples(df, label, **names).agg(F.avg("silhouette").alias("silhouette"))
