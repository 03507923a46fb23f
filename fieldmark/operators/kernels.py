"""NumPy work on one bounded block pair inside a task.

Everything here sees Arrow tables of one tile or batch; how rows reach a task
is decided by the operators that call these functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Cells of one distance matrix held at a time.
CELLS = 8_000_000
# The same where several such matrices are alive at once, or one should stay in a cache.
FEW_CELLS = 2_000_000


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix; uneven lengths are an error."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0), dtype=flat.dtype)
    width = len(flat) // rows
    if not (pc.list_value_length(column).to_numpy(zero_copy_only=False) == width).all():
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, width)


def same_code(left: pa.ChunkedArray, right: pa.ChunkedArray):
    """Integer codes equal exactly where two label columns are; NULL equals none."""
    left, right = left.combine_chunks(), right.combine_chunks()
    codes = pa.concat_arrays([left, right]).dictionary_encode().indices
    codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = codes[: len(left)].copy(), codes[len(left) :].copy()
    b[b < 0] = -2
    return a, b


def exact_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of paired rows, from differences, in double precision."""
    gaps = a.astype(np.float64) - b.astype(np.float64)
    return np.add.reduce(gaps * gaps, axis=1)


def slabs(rows: int, vectors: np.ndarray):
    """(start, stop) of as many rows as may be measured against all vectors at once."""
    step = max(1, CELLS // max(vectors.size, 1))
    for start in range(0, rows, step):
        yield start, min(start + step, rows)


def plain_distances(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Plain distances of every row to every vector, from differences, in double precision."""
    gaps = rows.astype(np.float64)[:, None, :] - vectors.astype(np.float64)[None, :, :]
    gaps *= gaps
    return np.sqrt(np.add.reduce(gaps, axis=2))


def _places(group: np.ndarray) -> np.ndarray:
    """0-based place of each position among the positions of its group."""
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, len(ordered)])
    places = np.empty(len(group), dtype=np.int64)
    places[order] = np.arange(len(ordered)) - np.repeat(starts, sizes)
    return places


def _row_bytes(vectors: np.ndarray) -> np.ndarray:
    """One comparable value per row."""
    plain = np.ascontiguousarray(vectors)
    return plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel()


def _leading_copies(vectors: np.ndarray, codes: np.ndarray | None, k: int) -> np.ndarray:
    """Row positions to keep: of equal vectors only those that can be answers.

    Rows come in id order, and equal vectors are equally far from any query, so
    the k smallest ids suffice. If rows of the query's own label do not count,
    k ids per label suffice, and of these the first 2k: at most k of them share
    the query's label.
    """
    keys = _row_bytes(vectors)
    _, group = np.unique(keys, return_inverse=True)
    keep = np.arange(len(keys))
    if group.max() + 1 == len(keys):
        return keep
    if codes is None:
        return keep[_places(group) < k]
    _, label = np.unique(codes, return_inverse=True)
    keep = keep[_places(group * (label.max() + 1) + label) < k]
    return keep[_places(group[keep]) < 2 * k]


# Columns whose minima are compared in place of the columns themselves.
STRIP = 64


def _strip_minima(rough: np.ndarray, k: int) -> np.ndarray:
    """Per row, minima over strips of ``STRIP`` columns; the columns themselves where these are few.

    Strip ``j`` of ``n`` holds the columns ``j``, ``j + n``, ``j + 2 * n`` and so on. Columns behind the last
    whole multiple are in none.
    """
    rows, columns = rough.shape
    strips = columns // STRIP
    if strips < 4 * k:
        return rough
    return rough[:, : strips * STRIP].reshape(rows, STRIP, strips).min(axis=1)


def _within(rough: np.ndarray, minima: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells up to each row's ``limit``; only strips with such a cell are looked at."""
    row, strip = np.nonzero(minima <= limit[:, None])
    if minima is rough:
        return row, strip
    strips = minima.shape[1]
    column = strip[:, None] + strips * np.arange(STRIP)
    at, inside = np.nonzero(rough[row[:, None], column] <= limit[row, None])
    rest = strips * STRIP
    last_row, last = np.nonzero(rough[:, rest:] <= limit[:, None])
    return np.concatenate([row[at], last_row]), np.concatenate([column[at, inside], last + rest])


def nearest_in_tile(
    queries: np.ndarray,
    gallery: np.ndarray,
    k: int,
    query_codes: np.ndarray | None = None,
    gallery_codes: np.ndarray | None = None,
):
    """Exact k nearest gallery rows per query, ties to the earlier gallery row.

    A matrix product in single precision finds a superset of the answer: every
    row within the product's worst rounding error of the k-th best. Only that
    superset is measured again in double precision and sorted. Returns query
    positions, gallery positions, 1-based ranks and squared distances. With
    codes, rows of equal code are not neighbours.
    """
    keep = _leading_copies(gallery, gallery_codes, k)
    if gallery_codes is not None:
        # Equal codes side by side: one slice per query rules them out.
        keep = keep[np.argsort(gallery_codes[keep], kind="stable")]
        pool_codes = gallery_codes[keep]
        own_from = np.searchsorted(pool_codes, query_codes, side="left")
        own_to = np.searchsorted(pool_codes, query_codes, side="right")
    pool = gallery[keep]
    peak = max(float(np.abs(pool).max()), float(np.abs(queries).max()))
    if not math.isfinite(peak):
        raise ValueError("vectors hold NaN or infinite elements")
    kind = np.float32 if 1e-12 < peak < 1e12 else np.float64
    unit = float(np.finfo(kind).eps)
    fast_pool = pool.astype(kind)
    pool_norm = np.einsum("ij,ij->i", fast_pool, fast_pool)
    farthest = float(np.sqrt(pool_norm.max()))
    doubled = np.ascontiguousarray(-2 * fast_pool.T)
    found = []
    step = max(1, FEW_CELLS // len(pool))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        fast = part.astype(kind)
        # The query's own norm shifts its whole row, so it is left out.
        rough = fast @ doubled
        rough += pool_norm
        if query_codes is not None:
            for i in range(len(part)):
                rough[i, own_from[start + i] : own_to[start + i]] = np.inf
        if k < len(pool):
            length = np.linalg.norm(fast, axis=1).astype(np.float64)
            slack = 4 * unit * (part.shape[1] + 16) * (length + farthest) ** 2
            # At least k columns do not exceed the k-th smallest minimum, which is nearly as low as the k-th of them.
            minima = _strip_minima(rough, k)
            limit = np.partition(minima, k - 1, axis=1)[:, k - 1].astype(np.float64) + slack
            limit = np.nextafter(limit.astype(kind), kind(np.inf))
            limit = np.minimum(limit, np.finfo(kind).max)
        else:
            minima = rough
            limit = np.full(len(part), np.finfo(kind).max)
        row, col = _within(rough, minima, limit)
        found.append(_best(part, pool, keep, row, col, k, start))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(part, pool, keep, row, col, k, start):
    distance = np.empty(len(row))
    step = max(1, FEW_CELLS // part.shape[1])
    for s in range(0, len(row), step):
        e = s + step
        distance[s:e] = exact_squared(part[row[s:e]], pool[col[s:e]])
    place = keep[col]
    order = np.lexsort((place, distance, row))
    row, place, distance = row[order], place[order], distance[order]
    first = np.searchsorted(row, row, side="left")
    rank = np.arange(len(row)) - first + 1
    top = rank <= k
    return row[top] + start, place[top], rank[top], distance[top]


@dataclass(frozen=True)
class Pivots:
    """Gallery rows around which the gallery is cut into cells: a row is in the cell of its nearest one.

    ``inner`` and ``outer`` are the least and the largest distance of a cell's rows to its pivot. ``labels``
    and ``roles`` are those of the pivots, which count as gallery rows themselves.
    """

    vectors: np.ndarray
    labels: pa.Array
    roles: pa.Array
    inner: np.ndarray
    outer: np.ndarray

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain distances of rows to pivots, and per row how far off they may be."""
        rows = rows.astype(np.float64)
        own = np.einsum("ij,ij->i", rows, rows)
        norm = np.einsum("ij,ij->i", self.vectors, self.vectors)
        squared = own[:, None] - 2.0 * (rows @ self.vectors.T) + norm
        # The product is off by a few units of the squared lengths, and a root near zero by the root of that.
        off = np.sqrt(1e-15 * (rows.shape[1] + 16)) * (np.sqrt(own) + np.sqrt(norm.max(initial=0.0)))
        return np.sqrt(np.maximum(squared, 0.0)), off

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distance to the pivot."""
        cell = np.empty(len(rows), dtype=np.int32)
        distance = np.empty(len(rows))
        step = max(1, FEW_CELLS // len(self.vectors))
        for s in range(0, len(rows), step):
            found, _ = self.distances(rows[s : s + step])
            cell[s : s + step] = found.argmin(axis=1)
            distance[s : s + step] = found.min(axis=1)
        return cell, distance

    def needed(self, rows: np.ndarray, cell: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which cells may hold a row within ``reach`` of each row, itself of ``cell``: a boolean matrix.

        A gallery row ``g`` of cell ``c`` is between ``inner`` and ``outer`` from its pivot, and no nearer to the
        pivot of ``cell``; the triangle inequality turns both into a least distance of ``g``.
        """
        out = np.empty((len(rows), len(self.vectors)), dtype=bool)
        between, _ = self.distances(self.vectors)
        step = max(1, FEW_CELLS // len(self.vectors))
        for s in range(0, len(rows), step):
            to, off = self.distances(rows[s : s + step])
            home = cell[s : s + step]
            own = to[np.arange(len(to)), home][:, None]
            least = np.maximum(to - self.outer, self.inner - to)
            gap = between[home]
            # Pivots close together say nothing reliable.
            apart = gap > 1e3 * off[:, None]
            half = np.divide(to * to - own * own, 2.0 * gap, out=np.full_like(gap, -np.inf), where=apart)
            np.maximum(least, half, out=least)
            out[s : s + step] = least <= (reach[s : s + step] * (1 + 1e-9) + 8 * off)[:, None]
        return out


@dataclass(frozen=True)
class Wanted:
    """One kind of neighbour list: the roles that ask and that answer (None: all), and whether labels must differ."""

    name: str
    queries: frozenset[str] | None = None
    gallery: frozenset[str] | None = None
    other_label_only: bool = False


def with_role(column, roles: frozenset[str] | None, n: int) -> np.ndarray:
    """Positions of the rows with one of the roles."""
    if roles is None:
        return np.arange(n)
    return np.flatnonzero(pc.is_in(column, pa.array(sorted(roles))).to_numpy(zero_copy_only=False))


def nearest_lists(q: pa.Table, g: pa.Table, k: int, wanted, key: str, vector: str, label: str):
    """Per wanted list: query positions, gallery positions, ranks and squared distances of one tile.

    Gallery positions are those in ``g``; ties go to the smaller key.
    """
    nothing = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    if not q.num_rows or not g.num_rows:
        return [nothing for _ in wanted]
    order = pc.sort_indices(g[key]).to_numpy(zero_copy_only=False)
    asked, answers = matrix(q[vector]), matrix(g[vector])
    out = []
    for one in wanted:
        rows = with_role(q["_role"] if one.queries else None, one.queries, q.num_rows)
        pool = with_role(g["_role"] if one.gallery else None, one.gallery, g.num_rows)
        pool = order[np.isin(order, pool)] if one.gallery else order
        if not len(rows) or not len(pool):
            out.append(nothing)
            continue
        codes = (None, None)
        if one.other_label_only:
            codes = same_code(q[label].take(pa.array(rows)), g[label].take(pa.array(pool)))
        row, place, rank, distance = nearest_in_tile(asked[rows], answers[pool], k, *codes)
        out.append((rows[row], pool[place], rank, distance))
    return out


def reaches(q: pa.Table, found, pivots: Pivots, k: int, wanted, vector: str, label: str) -> np.ndarray:
    """Per query row a plain distance within which its ``k`` neighbours of every list lie.

    Lists of ``k`` rows are found already; for others the pivots, gallery rows too, give a bound.
    """
    out = np.zeros(q.num_rows)
    asked = matrix(q[vector])
    for one, (row, _, rank, distance) in zip(wanted, found, strict=True):
        rows = with_role(q["_role"] if one.queries else None, one.queries, q.num_rows)
        bound = np.full(q.num_rows, np.inf)
        full = rank == k
        bound[row[full]] = np.sqrt(distance[full])
        pool = with_role(pivots.roles, one.gallery, len(pivots.vectors))
        if len(pool) >= k:
            step = max(1, FEW_CELLS // len(pool))
            for s in range(0, len(rows), step):
                some = rows[s : s + step]
                to, off = pivots.distances(asked[some])
                to = to[:, pool] + off[:, None]
                if one.other_label_only:
                    mine, theirs = same_code(q[label].take(pa.array(some)), pa.chunked_array([pivots.labels.take(pa.array(pool))]))
                    to[mine[:, None] == theirs] = np.inf
                bound[some] = np.minimum(bound[some], np.partition(to, k - 1, axis=1)[:, k - 1])
        out[rows] = np.maximum(out[rows], bound[rows])
    return out


def distances_to_labels(rows: np.ndarray, block: np.ndarray, codes: np.ndarray):
    """Sum of plain distances from every row to the block rows of each code.

    ``codes`` are 0..n-1; returns a (rows, n) matrix.
    """
    order = np.argsort(codes, kind="stable")
    block, ordered = block[order].astype(np.float64), codes[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    norm = np.einsum("ij,ij->i", block, block)
    doubled = np.ascontiguousarray(-2 * block.T)
    _, ids = np.unique(_row_bytes(np.concatenate([rows.astype(np.float64), block])), return_inverse=True)
    row_ids, block_ids = ids[: len(rows)], ids[len(rows) :]
    out = np.empty((len(rows), len(starts)))
    step = max(1, CELLS // len(block))
    for s in range(0, len(rows), step):
        part = rows[s : s + step].astype(np.float64)
        own = np.einsum("ij,ij->i", part, part)
        squared = part @ doubled
        squared += norm
        squared += own[:, None]
        # Rounding may put copies a hair apart or below zero: copies are at 0,
        # and other close pairs are measured again.
        row, col = np.nonzero(squared < 1e-9 * (own.max() + norm.max()))
        copy = row_ids[s + row] == block_ids[col]
        squared[row[copy], col[copy]] = 0.0
        row, col = row[~copy], col[~copy]
        for a in range(0, len(row), step):
            r, c = row[a : a + step], col[a : a + step]
            squared[r, c] = exact_squared(part[r], block[c])
        np.sqrt(squared, out=squared)
        out[s : s + step] = np.add.reduceat(squared, starts, axis=1)
    return out


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order: equal values are equal, NaN is the largest."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_ordered_bits(bits: int) -> float:
    """The double that ``ordered_bits`` made into ``bits``."""
    plain = np.array([bits], dtype=np.int64)
    return float(np.where(plain < 0, plain ^ np.int64(0x7FFFFFFFFFFFFFFF), plain).view(np.float64)[0])


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by its series of positive terms; beyond 6 it is 1 in double precision."""
    inside = np.clip(x, -6.0, 6.0)
    square = 2.0 * inside * inside
    term = inside.astype(np.float64)
    total = term.copy()
    odd = 1
    while term.size and np.abs(term).max() > 1e-300 and (np.abs(term) > 1e-17 * np.abs(total)).any():
        odd += 2
        term = term * square / odd
        total += term
    return np.clip(total * np.exp(-inside * inside) * (2.0 / math.sqrt(math.pi)), -1.0, 1.0)


def gelu(x: np.ndarray) -> np.ndarray:
    """Exact GELU."""
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def unit_rows(x: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), floor)
