"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own, so ``k`` centroids a half give ``k * k`` cells. A query
visits centroid pairs in the order of their summed distances, found with a heap, until the visited cells
hold the wanted share of all rows; their rows are measured again on the original vectors.

The centroids are fitted on at most ``max_sample`` rows, those with the smallest hash of their id; every
row is indexed. Rows of a cell are stored in blocks of bounded size: small neighbouring cells share one, a
cell that a third of all vectors fall into has many. Queries travel to the blocks of their cells, in slices
of bounded size, and a block sends on only its best rows for each query.

Vectors that are null or zero, hold a null or a non-finite component, or have another length than most,
take no part. Ties go to the smaller id. A row that is there twice is one neighbour and asks once; of different
vectors with one id the first in order asks, and the nearest of them is the neighbour.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.sources.staging import stage

BLOCK_ROWS = 4_096
SLICE_QUERIES = 4_096


@dataclass(frozen=True)
class Quantiser:
    """Centroids of both halves."""

    first: np.ndarray
    second: np.ndarray

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return squared(vectors[:, :half], self.first), squared(vectors[:, half:], self.second)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.distances(vectors)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (
        (rows**2).sum(axis=1)[:, None] - 2.0 * rows @ centroids.T + (centroids**2).sum(axis=1)
    )


def lloyd(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from randomly drawn distinct rows; empty ones stay where they are."""
    distinct = np.unique(rows, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        nearest = squared(rows, centroids).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (array of double) of the rows that take part."""
    values = F.col("vector")
    slim = rows.select(
        F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
    )
    finite = slim.where("vec_id IS NOT NULL").where(
        F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(values, lambda x: x != 0)
    )
    usual = finite.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return finite.where(F.size("vector") == (usual["n"] if usual else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def fit(rows: DataFrame, centroids: int, max_sample: int = 20_000) -> Quantiser | None:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).toPandas()
    if sample.empty:
        return None
    vectors = matrix(sample["vector"])
    half = vectors.shape[1] // 2
    return Quantiser(lloyd(vectors[:, :half], centroids), lloyd(vectors[:, half:], centroids))


def assign(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """``rows`` with their ``cell``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=quantiser.cells(matrix(batch["vector"])).astype(np.int32))

    return rows.mapInPandas(run, "vec_id long, vector array<double>, cell int")


def lay_out(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Cell -> its first block and its number of blocks. The table has at most one entry per cell."""
    places, block, filled = {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if filled and filled + n > BLOCK_ROWS:
            block, filled = block + 1, 0
        needed = -(-n // BLOCK_ROWS)
        places[cell] = (block, needed)
        if needed > 1:
            block, filled = block + needed, 0
        else:
            filled += n
    return places


def traverse(one: np.ndarray, two: np.ndarray, sizes: dict[int, int], wanted: int) -> list[int]:
    """Cells by growing sum of their centroids' distances, until they hold ``wanted`` rows."""
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    a, b, width = one[first], two[second], len(two)
    heap = [(float(a[0] + b[0]), 0, 0)]
    cells, found = [], 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(first[i]) * width + int(second[j])
        if cell in sizes:
            cells.append(cell)
            found += sizes[cell]
        # (i, j) is reached once: along its row from (i, j - 1), in the first column from (i - 1, 0).
        if j + 1 < width:
            heapq.heappush(heap, (float(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(a[i + 1] + b[0]), i + 1, 0))
    return cells


def search(
    rows: DataFrame,
    is_query,
    k: int = 10,
    share: float = 0.7,
    key: str = "vec_id",
    vector: str = "embedding",
    max_sample: int = 20_000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row that ``is_query`` selects.

    ``share`` is the part of all rows that a query's cells hold. Vectors without structure need a large one
    for a recall of 0.9; clustered vectors reach it with a few hundredths.
    """
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    good = usable(rows, key, vector)
    total = good.count()
    quantiser = fit(good, int(np.clip(np.sqrt(total) / 4, 16, 1024)), max_sample)
    if quantiser is None:
        return spark.createDataFrame([], result)
    indexed = stage(assign(good, quantiser))
    sizes = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.countDistinct("vec_id").alias("n")).collect()}
    places = lay_out(sizes)
    # One more than asked for: the query is in one of the cells.
    wanted = max(int(np.ceil(share * total)), k) + 1

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = batch["cell"].map(lambda c: places[c][0]).to_numpy()
            spread = batch["cell"].map(lambda c: places[c][1]).to_numpy()
            yield batch.assign(block=(first + batch["vec_id"].to_numpy() % spread).astype(np.int64))

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            one, two = quantiser.distances(matrix(batch["vector"]))
            out = []
            for i, (query, values) in enumerate(zip(batch["vec_id"], batch["vector"], strict=True)):
                by_block: dict[int, list[int]] = {}
                for cell in traverse(one[i], two[i], sizes, wanted):
                    block, spread = places[cell]
                    for at in range(block, block + spread):
                        by_block.setdefault(at, []).append(cell)
                out.extend((query, values, block, cells) for block, cells in by_block.items())
            yield pd.DataFrame(out, columns=["query_id", "query", "block", "cells"])

    blocks = indexed.mapInPandas(to_blocks, "vec_id long, vector array<double>, cell int, block long")
    queries = indexed.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    slices = 1 + queries.count() // SLICE_QUERIES
    asked = queries.mapInPandas(to_cells, "query_id long, query array<double>, block long, cells array<int>")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(slices)))
    copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def nearest(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entries) and len(queries):
            vectors, ids = matrix(entries["vector"]), entries["vec_id"].to_numpy()
            cell = entries["cell"].to_numpy()
            for query, values, cells in zip(queries["query_id"], queries["query"], queries["cells"], strict=True):
                at = np.nonzero(np.isin(cell, cells) & (ids != query))[0]
                score = np.sqrt(((vectors[at] - np.asarray(values)) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], score))
                # Copies are as near as each other; the first place of an id counts.
                best = best[np.sort(np.unique(ids[at[best]], return_index=True)[1])][:k]
                found.extend((query, ids[at[i]], score[i]) for i in best)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = (
        copies.groupBy("block", "part")
        .cogroup(asked.groupBy("block", "part"))
        .applyInPandas(nearest, "query_id long, vec_id long, score double")
    )
    # Different vectors of one id may lie in different blocks.
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
