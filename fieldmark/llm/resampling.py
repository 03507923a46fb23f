"""Importance resampling of documents towards a target distribution of hashed n-grams.

A document is weighed by how much likelier its runs of one to three words are in the target texts than in the corpus,
over a fixed number of hash buckets with one added to each; Gumbel noise that depends on the document id
alone turns the highest scores into a weighted sample without replacement.

Inside a task the runs of a slice of words are interned in an open-addressed NumPy table: the key of a run is its
xxhash64, an occurrence probes slots one by one until it meets an empty one or one whose run has the same hash
and, byte by byte, the same text. A slot stores the run's bucket and count, and every occurrence keeps the number of its
slot, so a bucket is computed once per distinct run and gains are gathered by slot number. Slices end
between words, also inside a document, so very long texts need no more memory than others beyond their own bytes.

Two passes over the texts: bucket counts (a row per bucket and task), then weights (a row per document, written
once). What the driver gets is a row per bucket. The drawn rows are found by the distinct scores and a range
sort of the rows from the last drawn score on.

Null texts are empty; documents without words have weight 0. A null id is hashed as an empty one. Repeated rows count and
are drawn like others; rows with equal id and score take ranks in any order. Empty tables give empty
results, an empty target is one without runs. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.hashing import SPARE, crc32, words_at, xxhash64
from fieldmark.operators.ranking import running_total
from fieldmark.sources.staging import stage

#: Longest run of words.
LONGEST = 3
#: Words whose runs share one table.
SLICE_WORDS = 1 << 16
#: Bytes of text that are cut into words at once, unless one text is longer.
TEXT_BYTES = 1 << 22

#: What each byte is as a part of a word: digits, letters in lower case and bytes beyond ASCII; 0 parts words.
FOLDED = np.zeros(256, dtype=np.uint8)
FOLDED[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLDED[0x80:] = np.arange(0x80, 0x100)


class Words:
    """The words of some texts, in lower case with one space behind each, and the text each word is from."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
        folded = FOLDED[data[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        inside = folded != 0
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        # Words do not run on from one text into the next.
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(folded))]
        begins[edges] |= inside[edges]
        closes[edges - 1] |= inside[edges - 1]
        first = np.flatnonzero(begins)
        self.lengths = np.flatnonzero(closes) + 1 - first
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.text = np.searchsorted(offsets, first, side="right") - 1
        self.data = np.full(int((self.lengths + 1).sum()) + SPARE, 0x20, dtype=np.uint8)
        self.data[np.arange(int(self.lengths.sum())) + np.repeat(np.arange(len(first)), self.lengths)] = folded[inside]

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, last byte and text of every run that starts with the words from ``begin`` to ``end``."""
        found = []
        for n in range(LONGEST):
            a = np.arange(begin, min(end, len(self) - n))
            a = a[self.text[a] == self.text[a + n]]
            found.append((self.starts[a], self.starts[a + n] + self.lengths[a + n], self.text[a]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether ``data`` holds the same bytes from ``a`` on and from ``b`` on; eight bytes at a time."""
    eights = words_at(data, "<u8")
    same = np.ones(len(a), dtype=bool)
    left = np.flatnonzero(lengths > 0)
    done = 0
    while len(left):
        differ = eights[a[left] + done] ^ eights[b[left] + done]
        spare = np.maximum(8 - (lengths[left] - done), 0).astype(np.uint64)
        same[left] &= (differ << (spare * np.uint64(8))) == 0
        done += 8
        left = left[(lengths[left] > done) & same[left]]
    return same


class RunTable:
    """Open-addressed table of distinct runs: ``bucket`` and ``count`` by slot, ``slots`` by occurrence."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> None:
        lengths = ends - starts
        hashes = xxhash64(data, starts, lengths)
        size = 1 << max(4, (2 * len(starts)).bit_length())
        self.owner = np.full(size, -1, dtype=np.int64)
        self.slots = (hashes & np.uint64(size - 1)).astype(np.int64)
        waiting = np.arange(len(starts))
        while len(waiting):
            slot = self.slots[waiting]
            empty = self.owner[slot] < 0
            # Of those that meet an empty slot, the one written last owns it.
            self.owner[slot[empty]] = waiting[empty]
            owner = self.owner[slot]
            alike = (hashes[owner] == hashes[waiting]) & (lengths[owner] == lengths[waiting])
            told = np.flatnonzero(alike & (owner != waiting))
            alike[told] = same_bytes(data, starts[owner[told]], starts[waiting[told]], lengths[waiting[told]])
            waiting = waiting[~alike]
            self.slots[waiting] = (self.slots[waiting] + 1) & (size - 1)
        self.count = np.bincount(self.slots, minlength=size)
        used = np.flatnonzero(self.owner >= 0)
        first = self.owner[used]
        self.bucket = np.zeros(size, dtype=np.int64)
        self.bucket[used] = crc32(data, starts[first], lengths[first]) % buckets


def tables(words: Words, buckets: int) -> Iterator[tuple[RunTable, np.ndarray]]:
    """A table for each slice of words, and the text of each of its occurrences."""
    for begin in range(0, len(words), SLICE_WORDS):
        starts, ends, text = words.runs(begin, begin + SLICE_WORDS)
        yield RunTable(words.data, starts, ends, buckets), text


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows with about ``TEXT_BYTES`` of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> DataFrame:
    """bucket, n: how many runs of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in parts(batch):
                for table, _ in tables(Words(part.column("text")), buckets):
                    used = table.count > 0
                    np.add.at(total, table.bucket[used], table.count[used])
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int, text: str, target_text: str) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the corpus, rounded down."""
    corpus, aim = np.zeros(buckets, dtype=object), np.zeros(buckets, dtype=object)
    for counts, texts, name in ((corpus, docs, text), (aim, target, target_text)):
        for row in bucket_counts(texts, name, buckets).collect():
            counts[row["bucket"]] = row["n"]
    all_corpus, all_aim = float(int(corpus.sum()) + buckets), float(int(aim.sum()) + buckets)
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * all_corpus / (float(s + 1) * all_aim)))
            for s, t in zip(corpus.tolist(), aim.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, key: str, text: str) -> DataFrame:
    """key, n_words, n_features and weight of every document."""
    buckets = len(gains)
    numbers = ["n_words", "n_features", "weight"]
    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in numbers)]
    )

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                words = Words(part.column("text"))
                features = np.zeros(part.num_rows, dtype=np.int64)
                total = np.zeros(part.num_rows, dtype=np.int64)
                for table, text in tables(words, buckets):
                    features += np.bincount(text, minlength=part.num_rows)
                    np.add.at(total, text, gains[table.bucket][table.slots])
                counts = np.bincount(words.text, minlength=part.num_rows)
                yield pa.record_batch(
                    [part.column("key"), pa.array(counts), pa.array(features), pa.array(total)], names=["key", *numbers]
                )

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(weights, schema)


def gumbel(key: str, seed: int) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from the first 32 bits of the SHA-256 of seed and key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(rows: DataFrame, percent: int, key: str, score: str, eligible: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 for the highest scores of the eligible ones, ``percent`` of these; else null.

    ``rows`` are read several times: stage them if they are costly.
    """
    pool = rows.where(eligible)
    wanted = pool.count() * percent // 100
    out = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select("*", out)
    # Scores are whole numbers: there are far fewer of them than rows.
    scores = pool.groupBy(F.negative(score).alias("down")).agg(F.count(F.lit(1)).alias("n"))
    last = running_total(scores, ["down"], "n", "upto").where(F.col("upto") >= wanted).agg(F.min("down")).first()[0]
    near = F.coalesce(eligible & (-F.col(score) <= F.lit(last)), F.lit(False))
    sorted_rows = rows.where(near).withColumn("down", F.negative(score))
    ranked = running_total(sorted_rows, ["down", key], out="rank").drop("down")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return rows.where(~near).select("*", out).unionByName(ranked)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42,
    key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """key, n_features, weight, score and rank (null where not drawn) of every document."""
    gains = bucket_gains(docs, target, buckets, text, target_text)
    rows = stage(weigh(docs, gains, key, text).withColumn("score", F.col("weight") + gumbel("key", seed)))
    drawn = draw(rows, percent, "key", "score", F.col("n_words") >= least_words)
    return drawn.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
