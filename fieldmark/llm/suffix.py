"""Removal of byte strings that occur twice, by bucket-pointer refinement.

A string of ``length`` bytes that occurs again anywhere is removed wherever it is. Suffixes fall into
buckets by their first bytes, and only members of buckets with company are looked at further, by the bucket
identifiers of what follows at later offsets. A bucket's identifier is a fingerprint of its string, so it
needs no table of ranks, and the identifier of a longer string follows from those of its parts. Each round
uses what the round before has settled:

1. Not every suffix starts a bucket. Each window of ``length`` bytes has an anchor: the smallest
   q-gram among its first ``SPREAD`` places (the last of equals). Windows with one anchor stand side by
   side, about ``SPREAD / 2`` of them, and all hold the ``length + 1 - SPREAD`` bytes from the anchor on. These
   bytes are the first bucket; anchors alone in theirs are done, and so are their windows.
2. The bucket is refined by all bytes that the anchor's windows reach. Anchors that still have company
   are settled: all their windows occur twice.
3. The windows of the other anchors are refined one by one to their full length, together with those of
   one anchor for each settled bucket that shares a first bucket with them.

The first round leaves a set filter, so that the second one, a scan of the texts like the first, shuffles only
anchors that may have company. The filter is sized by its keys up to a bound. What it lets through by mistake is alone
in its first bucket, which the second round sees, so it never gets to the third: there only texts with anchors
to look at are moved, to the exact list of these. Should the filter be of no use any more, every anchor is
a candidate once, about one for 33 bytes of text, whatever the size of the table.

What a round has used is deleted when it ends, and the last two rounds count and join in as many slices of their
keys as it takes for one to need no more disk than the texts have bytes.

Counts are combined before the shuffle, and the join that hands a count back to the members of a bucket can be split, so
a string that a third of all documents hold is no harm. Settled buckets are told apart by 128 bits, windows by 96.

Strings do not reach over documents; a null text is empty; texts shorter than ``length`` lose nothing.
Repeated rows are documents of their own, so each loses what it shares with its twin.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm import bloom
from fieldmark.llm.rolling import CHUNK, SECOND_MULTIPLIER, mix, running_sums, sliding_minimum, windows
from fieldmark.sources.staging import Owner, stage

#: Places in front of a window among which its anchor is chosen, and bytes of the grams compared.
SPREAD = 64
GRAM = 17
#: Bits of a sort key that hold the place inside a chunk.
PLACE_BITS = np.uint64(21)
PLACE_MASK = np.uint64((1 << 21) - 1)

IDENTITY = ("k1", "k2")

#: Bytes of disk that a candidate needs while its class is counted or met, and a window until it is counted and joined.
CANDIDATE_BYTES = 80
WINDOW_BYTES = 90
#: Bytes that one slice may need in any case, however short the texts.
LEAST_ROOM = 1 << 28


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: its begin, its running sums, and the anchor, first and last window of each run of windows.

    A text longer than a chunk is cut with an overlap, so that all windows that begin in a chunk are whole.
    """
    spread = min(SPREAD, length)
    gram = min(GRAM, length + 1 - spread)
    for begin in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        sums = running_sums(part)
        places = np.arange(len(part) - gram + 1)
        grams = windows(sums, places, places + gram)
        keys = (grams & ~PLACE_MASK) | (PLACE_MASK - places.astype(np.uint64))
        least = sliding_minimum(keys, spread)[: len(part) - length + 1]
        anchor = (PLACE_MASK - (least & PLACE_MASK)).astype(np.int64)
        cut = np.nonzero(np.diff(anchor))[0] + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut - 1, [len(anchor) - 1]))
        yield begin, sums, anchor[first], first, last


def buckets(
    sums: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the first bucket of each anchor, and of its refinement by all bytes its windows reach."""
    start = windows(sums, anchor, anchor + length + 1 - min(SPREAD, length))
    reach = windows(sums, first, last + length)
    shape = ((anchor - first) << 32) + (last - first)
    with np.errstate(over="ignore"):
        refined = mix(start + np.uint64(3) * reach + mix(shape.astype(np.uint64)))
    return start, refined


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Two fingerprints that tell rows apart, and the text; equal rows are equal documents."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.xxhash64(F.col(f"`{key}`")).alias("k1"), F.xxhash64(body).alias("k2"), body.alias("body"))


def _row_mark() -> Column:
    return F.xxhash64("k1", "k2")


def _anchor_mark() -> Column:
    return F.xxhash64("k1", "k2", "begin")


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        k1 = batch.column("k1").to_numpy()
        k2 = batch.column("k2").to_numpy()
        body = batch.column("body").cast(pa.binary())
        for i in range(len(body)):
            yield k1[i], k2[i], np.frombuffer(body[i].as_buffer(), dtype=np.uint8)


class _Rows:
    """Gathers columns and hands them out as record batches of a bounded number of rows."""

    def __init__(self, names: list[str], rows: int = 50_000) -> None:
        self.names, self.rows, self.parts, self.size = names, rows, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        if len(columns[0]):
            self.parts.append(columns)
            self.size += len(columns[0])
        return self.size >= self.rows

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [pa.array(np.concatenate(c)) for c in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


def _slices(rows: int, row_bytes: int, text_bytes: int) -> int:
    """Into how many slices, a power of two, rows go so that one needs no more disk than the texts have bytes."""
    return 1 << (rows * row_bytes // max(text_bytes, LEAST_ROOM)).bit_length()


def _packed(begin: Column, end: Column) -> Column:
    return F.shiftleft(begin.cast("long"), 32) + end


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, parts)


def _joined_lists(parts: list[DataFrame], name: str) -> DataFrame:
    """One list for each row that has any."""
    lists = _union([part.select(*IDENTITY, name) for part in parts]).where(F.size(name) > 0)
    return lists.groupBy(*IDENTITY).agg(F.flatten(F.collect_list(name)).alias(name))


def _chosen(texts: DataFrame, listed: Broadcast, wanted: bool) -> DataFrame:
    """Rows that a filter of row marks lets through, or without ``wanted`` the others."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy().view(np.uint64)
            rows = batch.filter(pa.array(bloom.holds(listed.value, marks) == wanted))
            yield rows.drop_columns(["mark"])

    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in texts.schema)
    return texts.withColumn("mark", _row_mark()).mapInArrow(choose, schema)


def _row_filter(lists: DataFrame) -> Broadcast:
    return bloom.build(lists.select(_row_mark().alias("mark")), "mark", bloom.bits_for(lists.count()))


def _candidates(mine: Owner, texts: DataFrame, length: int) -> DataFrame:
    """Anchors whose first bucket may have company: k1, k2, both identifiers, first window and places to the last."""

    def first_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(["start"])
        for _, _, data in _each_text(batches):
            for _, sums, anchor, first, last in anchors(data, length):
                if rows.add(buckets(sums, anchor, first, last, length)[0].view(np.int64)):
                    yield from rows.flush()
        yield from rows.flush()

    counted = texts.mapInArrow(first_buckets, "start long").groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    starts = stage(counted.where("n > 1").select("start"))
    shared = bloom.build(starts, "start", bloom.bits_for(starts.count()))
    mine.done(starts)

    def refined_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(["k1", "k2", "start", "refined", "begin", "reach"])
        for k1, k2, data in _each_text(batches):
            for at, sums, anchor, first, last in anchors(data, length):
                start, refined = buckets(sums, anchor, first, last, length)
                keep = bloom.holds(shared.value, start)
                begin = first[keep]
                n = len(begin)
                if rows.add(
                    np.full(n, k1), np.full(n, k2), start[keep].view(np.int64), refined[keep].view(np.int64),
                    (at + begin).astype(np.int32), (last[keep] - begin).astype(np.int32),
                ):
                    yield from rows.flush()
        yield from rows.flush()

    candidates = stage(
        texts.mapInArrow(refined_buckets, "k1 long, k2 long, start long, refined long, begin int, reach int")
    )
    shared.destroy()
    return candidates


def _wanted_classes(mine: Owner, candidates: DataFrame) -> DataFrame:
    """Settled buckets, and those that share a first bucket with an anchor that is not settled.

    The latter have the mark of one of their anchors. An anchor alone in its first bucket is in neither.
    """
    # The refined identifier holds the first one, so that both together tell 128 bits.
    classes = stage(
        candidates.groupBy("start", "refined").agg(F.count(F.lit(1)).alias("n"), F.min(_anchor_mark()).alias("mark"))
    )
    mixed = (
        classes.groupBy("start").agg(F.min("n").alias("least"), F.sum("n").alias("total"))
        .where("least = 1 AND total > 1").select("start", F.lit(True).alias("mixed"))
    )
    wanted = stage(
        classes.join(mixed, "start", "left").where("n > 1 OR mixed")
        .select("start", "refined", (F.col("n") > 1).alias("settled"), F.when(F.col("mixed"), F.col("mark")).alias("mark"))
    )
    mine.done(classes)
    return wanted


def _anchor_lists(mine: Owner, candidates: DataFrame, length: int, text_bytes: int) -> list[DataFrame]:
    """By slice of the first buckets: k1, k2, ``found`` (spans of settled anchors), ``asked`` (first and last windows of
    anchors to look at) and ``n``, the number of these windows."""
    slices = _slices(candidates.count(), CANDIDATE_BYTES, text_bytes)
    last = F.col("begin") + F.col("reach")
    lists = []
    for part in range(slices):
        own = candidates.where(F.col("start").bitwiseAND(F.lit(slices - 1)) == part)
        wanted = _wanted_classes(mine, own)
        rows = (
            own.join(wanted, ["start", "refined"])
            .withColumn("asked", F.col("mark") == _anchor_mark()).where("settled OR asked")
        )
        lists.append(
            stage(
                rows.groupBy(*IDENTITY).agg(
                    F.collect_set(F.when(F.col("settled"), _packed(F.col("begin"), last + length))).alias("found"),
                    F.collect_set(F.when(F.col("asked"), _packed(F.col("begin"), last))).alias("asked"),
                    F.sum(F.when(F.col("asked"), F.col("reach") + 1).otherwise(0)).alias("n"),
                )
            )
        )
        mine.done(wanted)
    return lists


def listed_windows(data: np.ndarray, packed: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By chunk: its begin, its bytes, and the places in it of all windows of the runs listed by first and last one."""
    runs, ends = packed >> 32, packed & 0xFFFFFFFF
    chunk = runs // CHUNK
    for number in np.unique(chunk).tolist():
        own, at = chunk == number, number * CHUNK
        sizes = (ends - runs + 1)[own]
        until = np.cumsum(sizes)
        begin = np.repeat(runs[own] - at - (until - sizes), sizes) + np.arange(until[-1])
        yield at, data[at : at + CHUNK + length - 1], begin


def _window_lists(mine: Owner, texts: DataFrame, lists: list[DataFrame], length: int, text_bytes: int) -> list[DataFrame]:
    """By slice of the windows: k1, k2 and ``found``, spans of the windows asked for that occur twice."""
    asked = stage(_joined_lists(lists, "asked"))
    listed = _row_filter(asked)
    met = _chosen(texts, listed, True).join(asked.hint("shuffle_hash"), list(IDENTITY)).select(*IDENTITY, "body", "asked")
    n_windows = _union([part.select("n") for part in lists]).agg(F.sum("n")).first()[0] or 0
    slices = _slices(n_windows, WINDOW_BYTES, text_bytes)

    def of_slice(part: int):
        def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _Rows(["w1", "w2", "k1", "k2", "begin"])
            for batch in batches:
                packed = batch.column("asked")
                for i, (k1, k2, data) in enumerate(_each_text([batch])):
                    for at, chunk, begin in listed_windows(data, packed[i].values.to_numpy(), length):
                        w1 = windows(running_sums(chunk), begin, begin + length)
                        own = w1 & np.uint64(slices - 1) == part
                        w1, begin = w1[own], begin[own]
                        second = running_sums(chunk, SECOND_MULTIPLIER)
                        w2 = windows(second, begin, begin + length, SECOND_MULTIPLIER) >> np.uint64(32)
                        n = len(begin)
                        if rows.add(
                            w1.view(np.int64), w2.astype(np.uint32).view(np.int32), np.full(n, k1), np.full(n, k2),
                            (at + begin).astype(np.int32),
                        ):
                            yield from rows.flush()
            yield from rows.flush()

        return single_windows

    found = []
    for part in range(slices):
        single = stage(met.mapInArrow(of_slice(part), "w1 long, w2 int, k1 long, k2 long, begin int"))
        twice = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
        span = _packed(F.col("begin"), F.col("begin") + length)
        repeated = single.join(twice, ["w1", "w2"])
        found.append(stage(repeated.groupBy(*IDENTITY).agg(F.collect_set(span).alias("found"))))
        mine.done(single)
    mine.done(asked)
    listed.destroy()
    return found


def repeated_spans(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 (of the row) and ``found``: begins and ends of runs of windows that occur twice.

    Rows without such a window are not listed. The table is staged.
    """
    texts = _identified(docs, key, text)
    with Owner() as mine:
        text_bytes = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        candidates = _candidates(mine, texts, length)
        lists = _anchor_lists(mine, candidates, length, text_bytes)
        mine.done(candidates)
        lists += _window_lists(mine, texts, lists, length, text_bytes)
        return mine.hand_over(stage(_joined_lists(lists, "found")))


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, ``spans`` (begin and end of each maximal removed run) and ``kept`` (binary)."""
    found = repeated_spans(docs, length, key, text)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{key}`")).alias("k1"), F.xxhash64(body).alias("k2"),
        body.cast("binary").alias("body"),
    )
    affected = _row_filter(found)
    kind = slim.schema["key"].dataType.simpleString()

    # Texts that lose nothing stay where they are; only the others meet their spans.
    joined = _chosen(slim, affected, True).join(found.hint("shuffle_hash"), list(IDENTITY), "left").select("key", "body", "found")
    whole = _chosen(slim, affected, False).select(
        "key", F.octet_length("body").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<begin:long,end:long>>").alias("spans"), F.col("body").alias("kept"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, spans, kept = batch.column("body"), [], []
            lists = batch.column("found")
            for i in range(batch.num_rows):
                data = np.frombuffer(bodies[i].as_buffer(), dtype=np.uint8)
                packed = lists[i].values
                if packed is None or not len(packed):
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                values = packed.to_numpy()
                edges = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edges, values >> 32, 1)
                np.add.at(edges, values & 0xFFFFFFFF, -1)
                gone = np.cumsum(edges[:-1]) > 0
                turns = np.nonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))[0]
                spans.append([{"begin": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pc.binary_length(bodies).cast(pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["key", "n_bytes", "spans", "kept"],
            )

    schema = f"key {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    return joined.mapInArrow(cut, schema).unionAll(whole).withColumnRenamed("key", key)
