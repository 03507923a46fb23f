"""Threshold and neighbour-count sweeps from a single neighbour join.

Neighbours are sorted by distance, so a threshold accepts a prefix of them and
a larger threshold a longer prefix. A row therefore has at most k + 1 different
predictions over the whole grid, each valid on one interval of thresholds. The
sweep works on these intervals; rows are never multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import crossover, geometric_mean, linspace, within_gate
from fieldmark.operators.kernels import Wanted
from fieldmark.operators.neighbors import row_medians, write_lists
from fieldmark.operators.stats import distance_summaries

# The default threshold grid and neighbour counts.
DEFAULT_GRID = (-8.0, 8.0, 100)
DEFAULT_KS = (1, 3, 5, 10, 20)

# Parts of an experiment and its neighbour lists.
GALLERY, ASKING = "gallery", "asking"
CALIBRATE, APPLY = "calibrate", "apply"


def _doubles(values: Sequence[float]) -> Column:
    """Array literal; one parsed expression is cheaper than a call per element."""
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")


def _first_accepting(grid: Sequence[float], accepts: Callable[[Column], Column]) -> Column:
    """Position of the first threshold of the sorted ``grid`` that accepts, found by halving.

    What a threshold accepts, every larger one accepts too.
    """
    values = _doubles(grid)
    steps = [1 << b for b in reversed(range(len(grid).bit_length()))]

    def step(place: Column, by: Column) -> Column:
        ahead = place + by
        rejected = ~accepts(F.get(values, F.least(ahead, F.lit(len(grid))) - 1))
        return F.when((ahead <= len(grid)) & rejected, ahead).otherwise(place)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def running_winners(labels: Column) -> Column:
    """The winner of the vote among the first 1, 2, ... of an array of labels; ties go to the label met first.

    One fold: only the votes of the label just met change, so it is compared with the winner so far.
    """
    nobody = F.struct(
        F.slice(labels, F.lit(1), F.lit(0)).alias("seen"), F.slice(labels, F.lit(1), F.lit(0)).alias("winners"),
        F.lit(0).alias("votes"), F.lit(0).alias("first"),
    )

    def meet(state: Column, label: Column) -> Column:
        seen = F.array_append(state["seen"], label)
        votes = F.size(F.filter(seen, lambda x: x == label))
        first = F.array_position(seen, label).cast("int")
        ahead = (votes > state["votes"]) | ((votes == state["votes"]) & (first < state["first"]))
        winner = F.when(ahead, label).otherwise(F.get(state["winners"], F.size(state["winners"]) - 1))
        return F.struct(
            seen.alias("seen"), F.array_append(state["winners"], winner).alias("winners"),
            F.when(ahead, votes).otherwise(state["votes"]).alias("votes"),
            F.when(ahead, first).otherwise(state["first"]).alias("first"),
        )

    return F.aggregate(labels, nobody, meet)["winners"]


def _correct_intervals(
    neighbors: DataFrame, counts: Sequence[int], starts: Callable[[int, Column], Column], n: int, key: str, label: str
) -> DataFrame:
    """(num_neighbors, label, side, start, stop): threshold positions where a row is right.

    ``starts(i, distance)`` is the first position that accepts a neighbour when ``counts[i]`` of them vote.
    The neighbours of a row, at most the largest count, become one array in rank order. Who wins among the first
    so many depends on no statistic, so one fold serves all counts.
    """
    ranked = F.sort_array(F.collect_list(F.struct("rank", "distance", "neighbor_identity")))
    rows = neighbors.groupBy(key, label).agg(ranked.alias("_near"))
    rows = rows.select(label, "_near", running_winners(F.col("_near.neighbor_identity")).alias("_winners"))
    def of_count(i: int, k: int) -> list[Column]:
        begins = F.col(f"_begins{i}")
        kind = F.lit(k).alias("num_neighbors")

        def interval(begin: Column, at: Column) -> Column:
            right = F.get("_winners", at) == F.col(label)
            stop = F.coalesce(F.get(begins, at + 1), F.lit(n))
            return F.struct(kind, F.when(right, "known").alias("side"), begin.alias("start"), stop.alias("stop"))

        none = F.struct(
            kind, F.lit("unknown").alias("side"), F.lit(0).alias("start"), F.get(begins, F.lit(0)).alias("stop")
        )
        return [F.transform(begins, interval), F.array(none)]

    def begins_of(i: int, k: int) -> Column:
        return F.transform(F.slice("_near", 1, k), lambda x: starts(i, x["distance"]))

    rows = rows.withColumns({f"_begins{i}": begins_of(i, k) for i, k in enumerate(counts)})
    every = [column for i, k in enumerate(counts) for column in of_count(i, k)]
    found = F.filter(F.concat(*every), lambda x: x["side"].isNotNull() & (x["start"] < x["stop"]))
    return rows.select(label, F.explode(found).alias("_i")).select("_i.num_neighbors", label, "_i.side", "_i.start", "_i.stop")


def _score_intervals(
    intervals: DataFrame,
    others: DataFrame,
    train: DataFrame,
    table: DataFrame,
    label: str,
) -> DataFrame:
    """Add baks, baus, crossover_score and score to the (num_neighbors, _t) rows of ``table``."""
    totals = others.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    known = train.select(label).distinct().withColumn("_known", F.lit(True))
    totals = totals.join(known, label, "left").select(
        label, "_rows", F.when(F.col("_known"), "known").otherwise("unknown").alias("side")
    )
    # At most n * n / 2 kinds of interval per identity, combined before the shuffle.
    kinds = (
        intervals.groupBy("num_neighbors", label, "side", "start", "stop")
        .agg(F.count(F.lit(1)).alias("_hits"))
        .join(totals, [label, "side"])
        .groupBy("num_neighbors", "side", "_rows", "start", "stop")
        .agg(F.sum("_hits").alias("_hits"))
    )
    per_threshold = (
        kinds.select(
            "num_neighbors", "side", "_rows", "_hits",
            F.explode(F.sequence("start", F.col("stop") - 1)).alias("_t"),
        )
        .groupBy("num_neighbors", "_t", "side", "_rows")
        .agg(F.sum("_hits").alias("_hits"))
        .groupBy("num_neighbors", "_t")
        .agg(
            *[
                F.sum(F.when(F.col("side") == s, F.col("_hits") / F.col("_rows"))).alias(f"_{s}")
                for s in ("known", "unknown")
            ]
        )
    )
    identities = totals.agg(
        F.struct(*[F.count_if(F.col("side") == s).alias(s) for s in ("known", "unknown")]).alias("n")
    ).scalar()

    def mean(side: str) -> Column:
        hits = F.coalesce(F.col(f"_{side}"), F.lit(0.0))
        return F.try_divide(hits, identities.getField(side))

    # As many rows as the grid and the neighbour counts make.
    return (
        table.join(F.broadcast(per_threshold), ["num_neighbors", "_t"], "left")
        .select(*table.columns, mean("known").alias("baks"), mean("unknown").alias("baus"))
        .withColumn("crossover_score", crossover("baks", "baus"))
        .withColumn("score", geometric_mean("baks", "baus"))
    )


def sweep_neighbors(
    neighbors: DataFrame,
    others: DataFrame,
    train: DataFrame,
    statistics: Sequence[tuple[int, float, float]],
    grid: Sequence[float],
    *,
    key: str = "image_id",
    label: str = "identity",
) -> DataFrame:
    """Score every z-score threshold of ``grid`` for each (k, median, mad).

    ``neighbors`` are those of ``others`` in ``train``, with ``label`` carried
    and at least as many as the largest k. One row per k and threshold:
    threshold, baks, baus, crossover_score, score, num_neighbors, median, mad.
    baks or baus is NULL if ``others`` has no known or no unknown identity.
    """
    spark = neighbors.sparkSession
    grid = sorted(float(t) for t in grid)
    values = spark.createDataFrame(
        [(int(k), float(m), float(d)) for k, m, d in statistics],
        "num_neighbors int, median double, mad double",
    )

    def starts(i: int, distance: Column) -> Column:
        _, median, mad = statistics[i]
        return _first_accepting(grid, lambda t: within_gate(distance, F.lit(float(median)), F.lit(float(mad)), t))

    # A row's neighbours beyond the largest count say nothing.
    used = neighbors.where(F.col("rank") <= max(int(k) for k, _, _ in statistics))
    intervals = _correct_intervals(used, [int(k) for k, _, _ in statistics], starts, len(grid), key, label)
    table = values.select("*", F.posexplode(_doubles(grid)).alias("_t", "threshold"))
    return _score_intervals(intervals, others, train, table, label).select(
        "threshold", "baks", "baus", "crossover_score", "score", "num_neighbors", "median", "mad"
    )


def sweep_distances(
    neighbors: DataFrame,
    others: DataFrame,
    train: DataFrame,
    grid: Sequence[float],
    *,
    key: str = "image_id",
    label: str = "identity",
) -> DataFrame:
    """Score absolute distance thresholds for the nearest neighbour.

    A row takes its neighbour's label where ``distance <= threshold``.
    """
    grid = sorted(float(t) for t in grid)
    intervals = _correct_intervals(
        neighbors.where(F.col("rank") == 1), [1],
        lambda _, distance: _first_accepting(grid, lambda t: distance <= t), len(grid), key, label,
    )
    table = neighbors.sparkSession.createDataFrame(
        [(1, i, t) for i, t in enumerate(grid)], "num_neighbors int, _t int, threshold double"
    )
    return _score_intervals(intervals, others, train, table, label).select(
        "threshold", "baks", "baus", "crossover_score", "score"
    )


def experiment(
    train: DataFrame,
    others: DataFrame,
    ks: Sequence[int] = (1,),
    grid: Sequence[float] | None = None,
    *,
    key: str = "image_id",
    vector: str = "embeddings",
    label: str = "identity",
) -> tuple[DataFrame, DataFrame]:
    """Calibrate on ``train`` and sweep ``others``, for each k of ``ks``.

    Returns the sweep and, per k, the summary of the distances between
    different identities in ``train``. One pass over pairs finds the neighbours
    of ``train`` among other identities and those of ``others``; it serves
    every k and every threshold.
    """
    grid = linspace(*DEFAULT_GRID) if grid is None else grid
    columns = [key, vector, label]
    gallery = train.select(*columns, F.lit(GALLERY).alias("_part"))
    both = gallery.unionByName(others.select(*columns, F.lit(ASKING).alias("_part")))
    answers = frozenset([GALLERY])
    wanted = [Wanted(CALIBRATE, answers, answers, True), Wanted(APPLY, frozenset([ASKING]), answers)]
    found = write_lists(
        both, gallery, max(ks), wanted, role="_part", key=key, vector=vector, label=label, query_columns=[label]
    )
    summary = distance_summaries(
        row_medians(found.where(F.col("list") == CALIBRATE), ks, key), by="num_neighbors"
    )
    statistics = [(r["num_neighbors"], r["median"], r["mad"]) for r in summary.collect()]
    swept = sweep_neighbors(found.where(F.col("list") == APPLY), others, train, statistics, grid, key=key, label=label)
    return swept, summary


def best_row(sweep: DataFrame, by: str = "score") -> DataFrame:
    """The row with the largest ``by``; the lowest threshold among equals."""
    return sweep.orderBy(F.col(by).desc_nulls_last(), F.col("threshold").asc()).limit(1)


def maxima(sweep: DataFrame) -> DataFrame:
    """One row with the largest baks, baus and score."""
    return sweep.agg(*[F.max(c).alias(c) for c in ("baks", "baus", "score")])
