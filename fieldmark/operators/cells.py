"""Cutting a gallery into cells around pivots, so that a neighbour join forms few pairs.

A cell holds the rows nearest to one pivot and is cut into blocks of bounded size by a hash of the key. All
tables here have a row per cell, and there are at most ``MAX_CELLS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators import kernels
from fieldmark.operators.grid import MAX_PARTITIONS

#: Most cells, whatever the size of the gallery.
MAX_CELLS = 1024
#: Rows of a table's hash range, for picking an even sample by a filter.
HASH_RANGE = 1 << 40
#: Most rows of either side of a tile, whatever their width: a worker holds several copies of a tile.
TILE_ROWS = 32_768
#: Fewest query rows of a tile that is cut off only to keep the cluster busy.
MIN_CHUNK_ROWS = 128


@dataclass(frozen=True)
class Plan:
    """How cells are cut: per cell its number of blocks and of query chunks, and its first tile."""

    blocks: np.ndarray
    chunks: np.ndarray
    first: np.ndarray

    @property
    def tiles(self) -> int:
        return int((self.blocks * self.chunks).sum())


def _per_cell(values: Sequence[int]) -> Column:
    """A literal array, parsed once."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")


def of_cell(values: Sequence[int], cell: Column) -> Column:
    if len(values) == 1:
        return F.lit(int(values[0]))
    return F.get(_per_cell(values), cell)


def spread(key: str, n: Column, seed: int) -> Column:
    """A number below ``n`` from the hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), n).cast("int")


def one_cell(width: int) -> kernels.Pivots:
    """A single cell that holds everything."""
    none = pa.nulls(1, pa.string())
    return kernels.Pivots(np.zeros((1, width)), none, none, np.zeros(1), np.full(1, np.inf))


def sample_pivots(gallery: DataFrame, rows: int, cells: int, key: str, vector: str, label: str, role: str | None):
    """At most ``cells`` different vectors of an even sample, with label and role; radii are open yet."""
    bound = min(HASH_RANGE, 2 * cells * HASH_RANGE // max(rows, 1) + 1)
    picked = gallery.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(HASH_RANGE)) < F.lit(bound))
    roles = F.col(role) if role else F.lit(None).cast("string")
    found = picked.select(vector, F.col(label).alias("label"), roles.alias("role")).toArrow()
    vectors = kernels.matrix(found[vector]).astype(np.float64)
    if not np.isfinite(vectors).all():
        raise ValueError("vectors hold NaN or infinite elements")
    if not len(vectors):
        return one_cell(0)
    _, first = np.unique(vectors, axis=0, return_index=True)
    first = np.sort(first)[:cells]
    places = pa.array(first)
    labels, roles = (found[c].combine_chunks().take(places) for c in ("label", "role"))
    return kernels.Pivots(vectors[first], labels, roles, np.zeros(len(first)), np.zeros(len(first)))


def with_cell(df: DataFrame, pivots: kernels.Pivots, vector: str) -> DataFrame:
    """``df`` with the ``_cell`` of each row."""
    if len(pivots.vectors) == 1:
        return df.withColumn("_cell", F.lit(0))
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _ = pivots.nearest(kernels.matrix(pa.chunked_array([batch.column(vector)])))
            yield batch.append_column("_cell", pa.array(cell, pa.int32()))

    return df.mapInArrow(assign, schema)


def measure(sides: Sequence[DataFrame], pivots: kernels.Pivots, vector: str):
    """Per side the rows of each cell, and the pivots with the radii that the first side gives them."""
    n = len(pivots.vectors)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((2, n), dtype=np.int64)
        inner, outer = np.full((2, n), np.inf), np.zeros((2, n))
        for batch in batches:
            vectors = kernels.matrix(pa.chunked_array([batch.column(vector)]))
            cell, distance = pivots.nearest(vectors)
            side = batch.column("_side").to_numpy()
            np.add.at(rows, (side, cell), 1)
            np.minimum.at(inner, (side, cell), distance)
            np.maximum.at(outer, (side, cell), distance)
        side, cell = np.nonzero(rows)
        yield pa.record_batch(
            [pa.array(side, pa.int32()), pa.array(cell, pa.int32())] + [pa.array(x[side, cell]) for x in (rows, inner, outer)],
            names=["side", "cell", "rows", "inner", "outer"],
        )

    tagged = [df.select(F.col(vector), F.lit(i).alias("_side")) for i, df in enumerate(sides)]
    both = tagged[0] if len(tagged) == 1 else tagged[0].unionAll(tagged[1])
    counted = both.mapInArrow(count, "side int, cell int, rows long, inner double, outer double")
    found = counted.groupBy("side", "cell").agg(
        F.sum("rows").alias("rows"), F.min("inner").alias("inner"), F.max("outer").alias("outer")
    )
    rows = np.zeros((2, n), dtype=np.int64)
    inner, outer = np.full(n, np.inf), np.full(n, -np.inf)
    for row in found.collect():
        rows[row["side"], row["cell"]] = row["rows"]
        if row["side"] == 0:
            inner[row["cell"]], outer[row["cell"]] = row["inner"], row["outer"]
    # A pivot that no gallery row is nearest to goes; its queries may turn up in any other cell.
    held = np.flatnonzero(rows[0])
    asks = rows[len(sides) - 1]
    asks = asks[held] + (asks.sum() - asks[held].sum())
    kept = [column.take(pa.array(held)) for column in (pivots.labels, pivots.roles)]
    return rows[0][held], asks, kernels.Pivots(pivots.vectors[held], *kept, inner[held], outer[held])


def plan_tiles(gallery_rows: np.ndarray, query_rows: np.ndarray, block_rows: int, slots: int) -> Plan:
    """Blocks and chunks of every cell, so that both sides of a tile are bounded and the cluster is busy."""
    blocks = np.maximum(1, -(-gallery_rows // block_rows))
    # Rows of a cell that each of its blocks meets, in as many chunks as bounds and slots ask for.
    bounded = -(-query_rows // block_rows)
    share = -(-slots * query_rows // max(int((query_rows * blocks).sum()), 1))
    busy = np.minimum(share, query_rows // MIN_CHUNK_ROWS)
    chunks = np.maximum(1, np.maximum(bounded, busy))
    chunks = np.where((query_rows == 0) | (gallery_rows == 0), 0, chunks)
    sizes = blocks * chunks
    return Plan(blocks, chunks, np.cumsum(sizes) - sizes)


def on_tiles(left: DataFrame, right: DataFrame, tiles: int, tile, schema: T.StructType) -> DataFrame:
    """Apply ``tile(left_table, right_table)`` to the rows of each ``_tile`` number.

    Tiles are dealt by their number: every partition gets the same number of them, one where there are no more
    than ``MAX_PARTITIONS``, and holds one in memory at a time.
    """
    places = max(1, min(tiles, MAX_PARTITIONS))
    left_names, right_names = ([c for c in df.columns if c != "_tile"] for df in (left, right))

    def side(df: DataFrame, mark: str, names: list[str]) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{mark}_{c}") for c in names], "_tile", F.lit(mark == "l").alias("_left"))

    both = side(left, "l", left_names).unionByName(side(right, "r", right_names), allowMissingColumns=True)

    def on_both(group: pa.Table) -> pa.Table:
        is_left = group["_left"].combine_chunks()
        rows = group.filter(is_left).select([f"l_{c}" for c in left_names]).rename_columns(left_names)
        block = group.filter(kernels.pc.invert(is_left)).select([f"r_{c}" for c in right_names]).rename_columns(right_names)
        # What earlier tiles and batches left in the pool is not kept beside this one.
        del group, is_left
        pa.default_memory_pool().release_unused()
        return tile(rows, block)

    return (
        both.withColumn("_place", (F.col("_tile") % places).cast("int"))
        .repartitionById(places, F.col("_place"))
        .groupBy("_place", "_tile")
        .applyInArrow(on_both, schema)
    )
