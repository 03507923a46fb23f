"""Exact k-nearest-neighbour joins by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldmark.operators import cells, kernels
from fieldmark.operators.grid import block_rows_of, vector_width
from fieldmark.operators.kernels import Wanted
from fieldmark.sources.staging import Owner, stage


def nearest(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    *,
    key: str = "image_id",
    vector: str = "embeddings",
    label: str = "identity",
    query_columns: Sequence[str] = (),
    other_label_only: bool = False,
    query_rows: int | None = None,
    gallery_rows: int | None = None,
    block_bytes: int | None = None,
) -> DataFrame:
    """The ``k`` nearest gallery rows of every query row.

    Returns ``key``, the ``query_columns``, ``rank`` (1 is nearest),
    ``distance`` (squared), ``neighbor_id`` and ``neighbor_<label>``. Ties go
    to the smaller neighbour key. With ``other_label_only`` a row is compared
    to rows of other labels only. A gallery with fewer than ``k`` eligible
    rows gives fewer neighbours. ``key`` is unique on either side. Rows whose
    vector is NULL neither ask nor answer; ``predict.complete`` gives them a
    prediction.
    """
    found = nearest_lists(
        queries, gallery, k, [Wanted("", other_label_only=other_label_only)], key=key, vector=vector,
        label=label, query_columns=query_columns, query_rows=query_rows, gallery_rows=gallery_rows,
        block_bytes=block_bytes,
    )
    return found.drop("list")


def nearest_lists(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    wanted: Sequence[Wanted],
    *,
    role: str | None = None,
    key: str = "image_id",
    vector: str = "embeddings",
    label: str = "identity",
    query_columns: Sequence[str] = (),
    query_rows: int | None = None,
    gallery_rows: int | None = None,
    block_bytes: int | None = None,
    pairs: Accumulator | None = None,
) -> DataFrame:
    """Several neighbour lists from one pass over pairs: the rows of ``nearest``, each with its ``list``.

    A list says which roles (values of ``role``) ask and which answer. The work goes by cells:

    1. An even sample of the gallery gives pivots; a row is in the cell of its nearest pivot. One pass counts
       rows and takes radii per cell. A gallery that fits one block is one cell and needs neither.
    2. Every query meets the block of its own cell. The k-th distance found there, or to the pivots, bounds
       what is still missing, and the triangle inequality leaves out the cells that cannot hold anything nearer.
       Queries are written with their bests and the cells that are left.
    3. Queries are copied to these cells only, while gallery rows stay in theirs. Bests are merged per query.

    Distances are exact. Vectors without structure leave no cell out; then all pairs are formed. ``pairs``
    counts the pairs that were, tile by tile.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = list(wanted)
    itself = queries is gallery
    present = F.col(vector).isNotNull()
    out_columns = [key, *query_columns]
    neighbor_label = f"neighbor_{label}"
    fields = [T.StructField(c, queries.schema[c].dataType) for c in out_columns]
    best = [
        T.StructField("list", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("neighbor_id", gallery.schema[key].dataType),
        T.StructField(neighbor_label, gallery.schema[label].dataType),
    ]
    best_names = [field.name for field in best]

    def asking(df: DataFrame) -> DataFrame:
        names = {key, vector, *query_columns}
        if any(one.other_label_only for one in wanted):
            names.add(label)
        roles = [F.col(role).alias("_role")] if role else []
        return df.where(present).select(*[c for c in df.columns if c in names], *roles)

    def answering(df: DataFrame) -> DataFrame:
        roles = [F.col(role).alias("_role")] if role else []
        return df.where(present).select(key, vector, label, *roles)

    def rows_of(q: pa.Table, g: pa.Table) -> tuple[list, pa.Table]:
        """What ``kernels.nearest_lists`` found, and as columns with the query's position in front."""
        if pairs is not None:
            pairs.add(q.num_rows * g.num_rows)
        found = kernels.nearest_lists(q, g, k, wanted, key, vector, label)
        row, place, rank, distance = (np.concatenate([one[i] for one in found]) for i in range(4))
        number = np.repeat(np.arange(len(found)), [len(one[0]) for one in found])
        place = pa.array(place, pa.int64())
        columns = [
            pa.array(number, pa.int32()), pa.array(rank, pa.int32()), pa.array(distance, pa.float64()),
            g[key].take(place), g[label].take(place),
        ]
        return found, pa.table([pa.array(row, pa.int64()), *columns], names=["_row", *best_names])

    def flat(q: pa.Table, g: pa.Table) -> pa.Table:
        _, rows = rows_of(q, g)
        values = [q[c].take(rows["_row"]) for c in out_columns]
        return pa.table([*values, *(rows[c] for c in best_names)], names=[*out_columns, *best_names])

    width = vector_width(gallery, vector)
    gallery_rows = gallery.count() if gallery_rows is None else gallery_rows
    query_rows = gallery_rows if itself else queries.count() if query_rows is None else query_rows
    block_rows = min(cells.TILE_ROWS, block_rows_of(width, block_bytes))
    slots = gallery.sparkSession.sparkContext.defaultParallelism
    asked, answers = asking(queries), answering(gallery)
    wide = min(cells.MAX_CELLS, -(-gallery_rows // block_rows))
    pivots = cells.one_cell(width)
    in_gallery, in_queries = np.array([gallery_rows]), np.array([query_rows])
    if wide > 1:
        pivots = cells.sample_pivots(answers, gallery_rows, wide, key, vector, label, "_role" if role else None)
        sides = [answers] if itself else [answers, asked]
        in_gallery, in_queries, pivots = cells.measure(sides, pivots, vector)
    plan = cells.plan_tiles(in_gallery, in_queries, block_rows, slots)
    cell = F.col("_cell")

    def tile_of(plan: cells.Plan, block, chunk):
        return (cells.of_cell(plan.first, cell) + block * cells.of_cell(plan.chunks, cell) + chunk).cast("long")

    def home_block(plan: cells.Plan):
        return cells.spread(key, cells.of_cell(plan.blocks, cell), 1)

    def chunk_of(plan: cells.Plan):
        return cells.spread(key, cells.of_cell(plan.chunks, cell), 2)

    celled = cells.with_cell(answers, pivots, vector)

    def copies(plan: cells.Plan) -> DataFrame:
        """Gallery rows, one for each chunk of queries that comes to their cell."""
        chunks = cells.of_cell(plan.chunks, cell)
        return (
            celled.where(chunks > 0)
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
            .withColumn("_tile", tile_of(plan, home_block(plan), F.col("_chunk")))
            .drop("_cell", "_chunk")
        )

    met = cells.with_cell(asked, pivots, vector).where(cells.of_cell(plan.chunks, cell) > 0)
    met = met.withColumn("_block", home_block(plan)).withColumn("_tile", tile_of(plan, F.col("_block"), chunk_of(plan)))
    if plan.blocks.sum() == 1:
        found = cells.on_tiles(met.drop("_cell", "_block"), copies(plan), plan.tiles, flat, T.StructType([*fields, *best]))
        return _named(found, wanted, out_columns, best_names)

    kept = [field for field in asked.schema.fields]
    state = T.StructType(
        [
            *kept, T.StructField("_cell", T.IntegerType()), T.StructField("_block", T.IntegerType()),
            T.StructField("_reach", T.DoubleType()), T.StructField("_cells", T.ArrayType(T.IntegerType())),
            T.StructField("_found", T.ArrayType(T.StructType(best))),
        ]
    )
    kept_names = [field.name for field in kept]
    many_blocks = plan.blocks > 1

    def meet(q: pa.Table, g: pa.Table) -> pa.Table:
        if q.num_rows == 0:
            return arrow.empty_table()
        found, rows = rows_of(q, g)
        reach = kernels.reaches(q, found, pivots, k, wanted, vector, label)
        cell = q["_cell"].to_numpy()
        needed = pivots.needed(kernels.matrix(q[vector]), cell, reach)
        # The own cell is done unless it has other blocks.
        needed[np.arange(len(cell)), cell] = many_blocks[cell]
        step = max(1, kernels.FEW_CELLS // needed.shape[1])
        to = [np.nonzero(needed[s : s + step])[1].astype(np.int32) for s in range(0, len(needed), step)]
        ends = np.concatenate([[0], np.cumsum(needed.sum(axis=1))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(to)))
        order = kernels.pc.sort_indices(rows["_row"])
        rows = rows.take(order)
        counts = np.bincount(rows["_row"].to_numpy(), minlength=q.num_rows)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        structs = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in best_names], names=best_names)
        bests = pa.ListArray.from_arrays(ends, structs)
        values = [q[c] for c in (*kept_names, "_cell", "_block")]
        return pa.table([*values, pa.array(reach), lists, bests], names=state.names)

    arrow = to_arrow_schema(state)
    staged = stage(cells.on_tiles(met, copies(plan), plan.tiles, meet, state))
    result = staged.select(*out_columns, F.explode("_found").alias("_b")).select(*out_columns, "_b.*")

    asks = np.zeros(len(pivots.vectors), dtype=np.int64)
    for row in staged.select(F.explode("_cells").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect():
        asks[row["c"]] = row["n"]
    if asks.any():
        again = cells.plan_tiles(in_gallery, asks, block_rows, slots)
        came = (
            staged.select(*kept_names, "_reach", F.col("_cell").alias("_home"), "_block", F.explode("_cells").alias("_cell"))
            .withColumn("_b", F.explode(F.sequence(F.lit(0), cells.of_cell(again.blocks, cell) - 1)))
            .where((cell != F.col("_home")) | (F.col("_b") != F.col("_block")))
            .withColumn("_tile", tile_of(again, F.col("_b"), chunk_of(again)))
            .select(*kept_names, "_reach", "_tile")
        )

        def near(q: pa.Table, g: pa.Table) -> pa.Table:
            _, rows = rows_of(q, g)
            # Roots and squares round: what is a hair beyond the reach goes to the merge.
            reach = q["_reach"].to_numpy()[rows["_row"].to_numpy()] * (1 + 1e-9)
            rows = rows.filter(pa.array(rows["distance"].to_numpy() <= reach * reach + 1e-300))
            values = [q[c].take(rows["_row"]) for c in out_columns]
            return pa.table([*values, *(rows[c] for c in best_names)], names=[*out_columns, *best_names])

        more = cells.on_tiles(came, copies(again), again.tiles, near, T.StructType([*fields, *best]))
        merged = Window.partitionBy("list", key).orderBy("distance", "neighbor_id")
        result = result.unionByName(more).withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    return _named(result, wanted, out_columns, best_names)


def write_lists(queries: DataFrame, gallery: DataFrame, k: int, wanted: Sequence[Wanted], **options) -> DataFrame:
    """``nearest_lists``, written with a folder per list; nothing else that it staged is left."""
    with Owner() as mine:
        found = nearest_lists(queries, gallery, k, wanted, **options)
        return mine.hand_over(stage(found, partition_by=["list"]))


def _named(found: DataFrame, wanted: Sequence[Wanted], out_columns: list[str], best_names: list[str]) -> DataFrame:
    name = F.get(F.array(*[F.lit(one.name) for one in wanted]), F.col("list")).alias("list")
    return found.select(*out_columns, name, *[c for c in best_names if c != "list"])


def row_medians(
    neighbors: DataFrame, ks: Sequence[int], key: str = "image_id", by: Sequence[str] = ()
) -> DataFrame:
    """Median distance over the first k neighbours of each row, per k in ``ks``.

    One neighbour join with the largest k serves every smaller one; the distances of a row, at most that many,
    are one array. ``by`` names further columns that tell lists of one row apart.
    """
    who = [*by, key]
    rows = neighbors.where(F.col("rank") <= max(ks)).groupBy(*who).agg(
        F.sort_array(F.collect_list("distance")).alias("_sorted")
    )

    def median(k: int):
        n = F.least(F.size("_sorted"), F.lit(int(k)))
        middle = (n / 2).cast("int")
        upper = F.get("_sorted", middle)
        lower = F.get("_sorted", middle - 1)
        # The mean of the two middle ones as their linear interpolation.
        value = F.when(n % 2 == 1, upper).otherwise(lower * F.lit(0.5) + upper * F.lit(0.5))
        return F.struct(F.lit(int(k)).alias("num_neighbors"), value.alias("distance"))

    medians = F.explode(F.array(*[median(k) for k in ks])).alias("_m")
    return rows.select(*who, medians).select(*who, "_m.num_neighbors", "_m.distance")
