"""Packing token sequences into few bins of a fixed size.

Every text becomes pieces of at most ``capacity`` tokens. Pieces of one length are interchangeable, so what
is packed is a table of at most ``capacity`` counts, whatever the number of documents. The driver solves it:

* Martello-Toth reduction: a set of up to three lengths that dominates every other set its longest piece
  could be packed with is fixed for good, as often as the counts allow, and leaves the instance;
* best fit, longest first, packs what is left.

The outcome is a list of patterns with their numbers of repeats. Pieces are then numbered within their
length, from counts per (length, hash slice) and ranks inside a slice, and look their place up in the
patterns. No group, not even one length that most documents have, has to be in one task.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.sources.staging import stage

#: Words that a worker remembers at most.
REMEMBERED = 1_000_000
#: Rows per hash slice that ranks are taken in, about.
SLICE_ROWS = 100_000

#: Letters and the plain punctuation behind them, which such a tokenizer encodes apart.
SIMPLE = r"^(?P<letters>[A-Za-z]+)(?P<marks>[.,;:!?|*&%$#]*)$"
SEPARATOR = "\x00"
#: Units that are encoded in one call.
CALL = 500


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` one behind the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordIds:
    """Ids of words between ASCII white space, for a tokenizer that drops white space.

    Words of letters and plain punctuation are two units, others are one. A unit is encoded once as
    long as it is remembered; its ids are a slice of one pool.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # Spark gives a task one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        (self.separator,) = self._encoded(SEPARATOR)
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self.pool = np.empty(1 << 16, dtype=np.uint32)
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.sizes = np.empty(1 << 14, dtype=np.int64)
        self._used = 0

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _add(self, units: list[str], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self._row)
        while self._used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + len(units) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self._used : self._used + len(ids)] = ids
        self.starts[first : first + len(units)] = starts + self._used
        self.sizes[first : first + len(units)] = sizes
        self._used += len(ids)
        self._row.update(zip(units, range(first, first + len(units)), strict=True))

    def _learn(self, units: list[str]) -> None:
        for unit in units:
            if SEPARATOR in unit:
                ids = self._encoded(unit)
                self._add([unit], ids, np.zeros(1, np.int64), np.array([len(ids)]))
        plain = [unit for unit in units if SEPARATOR not in unit]
        for begin in range(0, len(plain), CALL):
            some = plain[begin : begin + CALL]
            ids = self._encoded(f" {SEPARATOR} ".join(some))
            cuts = np.flatnonzero(ids == self.separator)
            starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]])
            self._add(some, ids, starts, ends - starts)

    def rows(self, units: pa.Array) -> np.ndarray:
        """For different units their rows in ``starts`` and ``sizes``."""
        wanted = units.to_pylist()
        new = [unit for unit in wanted if unit not in self._row]
        if new:
            if len(self._row) + len(new) > REMEMBERED:
                self._forget()
                new = wanted
            self._learn(new)
        return np.fromiter(map(self._row.__getitem__, wanted), dtype=np.int64, count=len(wanted))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def flat_ids(encoder: WordIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids begin; equal words are looked up once."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    words = flat.dictionary
    simple = pc.extract_regex(words, SIMPLE)
    heads = pc.coalesce(pc.ascii_lower(pc.struct_field(simple, "letters")), words)
    tails = pc.coalesce(pc.struct_field(simple, "marks"), pa.scalar("", words.type))
    # A word is its head and its tail; an empty tail has no ids.
    units = pa.concat_arrays([heads, tails]).dictionary_encode()
    row = encoder.rows(units.dictionary)[units.indices.to_numpy()]
    row = np.stack([row[: len(words)], row[len(words) :]], axis=1).ravel()
    sizes = encoder.sizes[row]
    pool = gather(encoder.pool, encoder.starts[row], sizes)
    sizes = sizes.reshape(-1, 2).sum(axis=1)
    starts = np.cumsum(sizes) - sizes
    index = flat.indices.to_numpy()
    lengths = sizes[index]
    return gather(pool, starts[index], lengths), np.concatenate(([0], np.cumsum(lengths)))[offsets]


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of every text: key, piece, start, length, ids_crc32.

    A text's ids are those of the tokenizer and ``end_id`` after them, so a null or empty text is one piece
    of one token. Only texts of more than ``capacity`` ids are cut. Repeated rows give repeated pieces.
    """
    slim = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", slim.schema["key"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = flat_ids(encoder, batch.column("text"))
            ids = ids.astype("<u4", copy=False)
            sizes = np.diff(bounds) + 1
            pieces = -(-sizes // capacity)
            rows = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(capacity, sizes[rows] - start)
            crc = np.empty(len(rows), dtype=np.int64)
            last = start + length == sizes[rows]
            for i, (a, n, closing) in enumerate(
                zip((bounds[rows] + start).tolist(), length.tolist(), last.tolist(), strict=True)
            ):
                own = zlib.crc32(ids[a : a + n - closing].tobytes())
                crc[i] = zlib.crc32(tail.tobytes(), own) if closing else own
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows)), pa.array(number.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array(crc),
                ],
                names=[field.name for field in schema],
            )

    return slim.mapInArrow(cut, schema).withColumnRenamed("key", key)


@dataclass(frozen=True)
class Pattern:
    """Lengths that share a bin, in their order there, and the number of such bins."""

    lengths: tuple[int, ...]
    bins: int


class Lengths:
    """Counts by length, with the lengths in use kept sorted."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {length: n for length, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def largest(self, room: int) -> int | None:
        """The largest length in use of at most ``room``."""
        place = bisect.bisect_right(self.order, room)
        return self.order[place - 1] if place else None

    def smallest(self, n: int) -> list[int]:
        """The ``n`` smallest pieces, or fewer if there are not so many."""
        out: list[int] = []
        for length in self.order:
            out.extend([length] * min(self.count[length], n - len(out)))
            if len(out) == n:
                break
        return out


def _best_pair(rest: Lengths, room: int) -> tuple[int, int] | None:
    """The two pieces with the largest sum of at most ``room``; among equals the pair with the longest one."""
    best: tuple[int, int] | None = None
    low, high = 0, len(rest.order) - 1
    while low <= high:
        a, b = rest.order[low], rest.order[high]
        if a + b > room or (low == high and rest.count[a] < 2):
            high -= 1
            continue
        if best is None or a + b > sum(best):
            best = (b, a)
        low += 1
    return best


def _dominating(rest: Lengths, longest: int, capacity: int) -> tuple[int, ...] | None:
    """Companions of one ``longest`` piece, taken out of ``rest``, that dominate every other choice.

    One set dominates another if the other's pieces can be parted into groups that its own pieces can
    stand for. A single companion that fills the bin, or is at least the sum of the best pair where no
    three more fit, dominates; so does the best companion where no two more fit, and a pair that bounds
    every other pair piece by piece where no three more fit.
    """
    room = capacity - longest
    single = rest.largest(room)
    if single is None:
        return ()
    if single == room:
        return (single,)
    least = rest.smallest(3)
    if len(least) < 2 or least[0] + least[1] > room:
        return (single,)
    if len(least) == 3 and sum(least) <= room:
        return None
    pair = _best_pair(rest, room)
    if pair is None or single >= sum(pair):
        return (single,)
    # (a, b) with a >= b bounds all others if a is the largest that fits at all and no two pieces that
    # both exceed b fit together.
    a, b = pair
    if a == single:
        above = rest.order[bisect.bisect_right(rest.order, b) :]
        if not above:
            return pair
        second = above[0] if rest.count[above[0]] > 1 else above[1] if len(above) > 1 else None
        if second is None or above[0] + second > room:
            return pair
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some best packing has, and the counts of what is left.

    Lengths are gone through from the longest, again and again until nothing more is fixed. The pairs that
    fill a bin exactly come first, as many of them as there are.
    """
    rest, fixed = Lengths(counts), []
    for length in sorted(rest.count, reverse=True):
        other = capacity - length
        if other > length or length not in rest.count or other not in rest.count:
            continue
        n = rest.count[length] // 2 if other == length else min(rest.count[length], rest.count[other])
        if n:
            rest.take(length, n)
            rest.take(other, n)
            fixed.append(Pattern((length, other), n))
    again = True
    while again:
        again = False
        for length in sorted(rest.count, reverse=True):
            while length in rest.count:
                rest.take(length, 1)
                companions = _dominating(rest, length, capacity)
                if companions is None:
                    rest.count[length] = rest.count.get(length, 0) + 1
                    if rest.count[length] == 1:
                        bisect.insort(rest.order, length)
                    break
                again = True
                chosen = (length, *companions)
                need = {c: companions.count(c) for c in companions}
                # The same step holds while the counts of the chosen lengths last; three of each stay, so
                # that what else fits is looked at anew when a length runs out.
                repeats = min([rest.count.get(length, 0), *(rest.count[c] // need[c] for c in need)])
                bins = max(1, (repeats - 3) // (1 + need.get(length, 0)))
                for c, k in need.items():
                    rest.take(c, k * bins)
                if bins > 1:
                    rest.take(length, bins - 1)
                fixed.append(Pattern(chosen, bins))
    return fixed, dict(rest.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first: each piece goes where it leaves the least room, else into a new bin."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(lengths: tuple[int, ...], bins: int, room: int) -> None:
        if not room:
            done.append(Pattern(lengths, bins))
            return
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((lengths, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            place = bisect.bisect_left(rooms, length)
            if place == len(rooms):
                each = capacity // length
                bins, extra = divmod(left, each)
                if bins:
                    put((length,) * each, bins, capacity - each * length)
                if extra:
                    put((length,) * extra, 1, capacity - extra * length)
                break
            room = rooms[place]
            lengths, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(place)
            each = room // length
            full, extra = divmod(left, each)
            used = min(bins, full)
            if used:
                put(lengths + (length,) * each, used, room - each * length)
                left -= used * each
            if used < bins:
                if left:
                    put(lengths + (length,) * left, 1, room - left * length)
                    used += 1
                    left = 0
                if used < bins:
                    put(lengths, bins - used, room)
    done.extend(Pattern(lengths, bins) for found in open_bins.values() for lengths, bins in found)
    return done


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> dict[int, pd.DataFrame]:
    """For each length the runs of its places: number of the first one, first bin, places per bin, offsets."""
    rows: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
    taken: dict[int, int] = {}
    first_bin = 0
    for pattern in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in pattern.lengths:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            rows.setdefault(length, []).append((taken.get(length, 0), first_bin, tuple(places)))
            taken[length] = taken.get(length, 0) + pattern.bins * len(places)
        first_bin += pattern.bins
    return {n: pd.DataFrame(found, columns=["first", "bin", "offsets"]) for n, found in rows.items()}


def number_within(pieces: DataFrame, rows: int, key: str) -> DataFrame:
    """``pieces`` with a ``rank`` from 0 within each length, without bringing a length into one task."""
    slices = 1 + rows // SLICE_ROWS
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(slices)))
    counted = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy(key, "piece", "ids_crc32")
    ranked = sliced.withColumn("within", F.row_number().over(within) - 1)
    return (
        ranked.join(before, ["length", "slice"])
        .withColumn("rank", (F.col("before") + F.col("within")).cast("long"))
        .drop("slice", "within", "before")
    )


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """``pieces`` (key, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Pieces of a sequence lie behind each other from 0 without gaps. An empty table gives an empty one.
    """
    staged = stage(pieces)
    counts = {row["length"]: row["n"] for row in staged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = slots(solve(counts, capacity))
    ranked = number_within(staged, sum(counts.values()), key)
    schema = T.StructType(
        [
            *ranked.drop("rank").schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    columns = [field.name for field in schema.fields]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = np.empty(len(batch), dtype=np.int64)
            offsets = np.empty(len(batch), dtype=np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths).tolist():
                table = runs[length]
                at = np.nonzero(lengths == length)[0]
                run = np.searchsorted(table["first"].to_numpy(), ranks[at], side="right") - 1
                inside = ranks[at] - table["first"].to_numpy()[run]
                per_bin = table["offsets"].map(len).to_numpy()[run]
                bins[at] = table["bin"].to_numpy()[run] + inside // per_bin
                flat = np.concatenate([np.asarray(x) for x in table["offsets"]])
                starts = np.concatenate(([0], np.cumsum(table["offsets"].map(len).to_numpy())))[:-1]
                offsets[at] = flat[starts[run] + inside % per_bin]
            yield batch.assign(sequence_id=bins, offset=offsets)[columns]

    return ranked.mapInPandas(place, schema)
