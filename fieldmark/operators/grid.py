"""Pairing two tables block by block, each pair of blocks in one bounded task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vector bytes per side of a tile, and row limits for very short vectors and
# for tables that would not keep the cluster busy as one tile.
BLOCK_BYTES = 64 << 20
MAX_BLOCK_ROWS = 65_536
MIN_BLOCK_ROWS = 512

# Partitions that a grid may take.
MAX_PARTITIONS = 100_000


@dataclass(frozen=True)
class Blocks:
    """How many blocks a table is cut into, from its row count and width."""

    rows: int
    count: int


def vector_width(df: DataFrame, vector: str) -> int:
    """Width of the first vector; 0 for an empty table."""
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return row["n"] if row else 0


def plan_blocks(
    df: DataFrame, width: int, rows: int | None = None, block_bytes: int | None = None
) -> Blocks:
    """Choose a block count so that one block is bounded in bytes and rows.

    Counting reads no vectors. Smaller tables are cut further, so that the
    grid of two such tables has about as many tiles as there are cores.
    """
    rows = df.count() if rows is None else rows
    parallel = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
    fits = block_rows_of(width, block_bytes)
    target = min(fits, max(MIN_BLOCK_ROWS, math.ceil(rows / parallel)))
    return Blocks(rows, max(1, math.ceil(rows / target)))


def block_rows_of(width: int, block_bytes: int | None = None) -> int:
    """Rows of this width that fit one block."""
    return max(1, min(MAX_BLOCK_ROWS, (block_bytes or BLOCK_BYTES) // (4 * max(width, 1))))


def even_block(key: str, blocks: Blocks) -> Column:
    """Block number from the hash of a unique key: blocks of even size."""
    return F.pmod(F.xxhash64(key), F.lit(blocks.count)).cast("int")


def run_tiles(
    left: DataFrame,
    right: DataFrame,
    left_blocks: int,
    right_blocks: int,
    tile: Callable,
    schema: T.StructType,
    columns: tuple[Sequence[str], Sequence[str]],
) -> DataFrame:
    """Apply ``tile(left_table, right_table)`` to every pair of blocks.

    The frames carry their block in ``_lb`` and ``_rb``. Every row is copied
    to each block of the other side. Right blocks form groups, and one
    partition holds the tiles of a left block with one group, one in memory at
    a time. As long as there are few tiles a group is a single block; a larger
    grid shares ``MAX_PARTITIONS`` partitions, and what its tiles emit can then
    be combined per partition before the next shuffle. Tiles are dealt to
    partitions by number, so that none is empty and none has two groups.
    """
    groups = max(1, min(right_blocks, MAX_PARTITIONS // left_blocks))
    partitions = left_blocks * groups

    def spread(df: DataFrame, side: str, own: str, other: str, n: int, names: Sequence[str]) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
        mine = [F.col(c).alias(f"{side}_{c}") for c in names]
        return df.select(*mine, own, copies.alias(other))

    # One grouped frame rather than a cogroup: a cogroup would insist on hashing
    # all three block columns and shuffle a second time.
    both = spread(left, "l", "_lb", "_rb", right_blocks, columns[0]).withColumn(
        "_left", F.lit(True)
    ).unionByName(
        spread(right, "r", "_rb", "_lb", left_blocks, columns[1]).withColumn("_left", F.lit(False)),
        allowMissingColumns=True,
    )
    left_names, right_names = list(columns[0]), list(columns[1])

    def on_both(group: pa.Table) -> pa.Table:
        is_left = group["_left"]
        rows = group.filter(is_left).select([f"l_{c}" for c in left_names])
        block = group.filter(pc.invert(is_left)).select([f"r_{c}" for c in right_names])
        return tile(rows.rename_columns(left_names), block.rename_columns(right_names))

    return (
        both.withColumn("_place", (F.col("_lb") * groups + F.col("_rb") % groups).cast("int"))
        .repartitionById(partitions, F.col("_place"))
        .groupBy("_place", "_rb")
        .applyInArrow(on_both, schema)
    )
