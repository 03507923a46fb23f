"""Exact token counts at every prefix of a text.

A byte-level tokenizer cuts a text into words first and encodes each word alone. For a word, one pass of the
prefix programme (``bpe.PrefixEncoder``) stores the number of tokens at each of its byte prefixes; a text's
counts are those of its words added up. How many tokens a text has, how much of it fits into a budget, and
how many tokens a cut at any byte leaves are then looked up, not encoded again.

One pass over the texts, no shuffle. Inside an Arrow batch equal words are counted once; a worker keeps the
prefix counts of a bounded number of words between batches.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldmark.llm.bpe import REMEMBERED, byte_level_encoder

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space after white space; elsewhere a single space always begins a word.
SPACE_AFTER_SPACE = r"[\s\x1c-\x1f\x{0085}\p{Z}] "


class PrefixCounts:
    """Token counts of prefixes for one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.encoder, self.ids, special = byte_level_encoder(path)
        self.words = regex.compile(WORDS)
        self.special = special
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._ends: dict[str, tuple[int, ...]] = {}

    def word_ends(self, word: str) -> tuple[int, ...]:
        """Byte places in a word at which its tokens end."""
        ends = self._ends.get(word)
        if ends is None:
            data = word.encode()
            lasts, _ = self.encoder.prefixes(data)
            end, places = len(data), []
            while end:
                places.append(end)
                end -= lasts[end]
            ends = tuple(reversed(places))
            if len(self._ends) >= REMEMBERED:
                self._ends.clear()
            self._ends[word] = ends
        return ends

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The words of a text and its special strings, which are one token each."""
        at = 0
        for match in self.specials.finditer(text) if self.specials else ():
            yield from ((word, False) for word in self.words.findall(text, at, match.start()))
            yield match[0], True
            at = match.end()
        yield from ((word, False) for word in self.words.findall(text[at:] if at else text))

    def ends(self, text: str) -> list[int]:
        """Byte places in a text at which its tokens end."""
        out, at = [], 0
        for word, special in self.segments(text):
            if special:
                at += len(word.encode())
                out.append(at)
            else:
                ends = self.word_ends(word)
                out.extend(at + end for end in ends)
                at = out[-1]
        return out

    def count(self, text: str) -> int:
        return sum(1 if special else len(self.word_ends(word)) for word, special in self.segments(text))

    def at_every_prefix(self, text: str) -> list[int]:
        """Tokens of each byte prefix of a text: those of its whole words and of the begun word's prefix."""
        out = [0]
        for word, special in self.segments(text):
            data, before = word.encode(), out[-1]
            if special:
                out.extend([before + 1] * len(data))
            else:
                out.extend(before + n for n in self.encoder.prefixes(data)[1][1:])
        return out


@functools.lru_cache(maxsize=2)
def counts_of(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def _batch(counter: PrefixCounts, texts: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the bytes that its first ``limit`` tokens cover."""
    texts = pc.fill_null(texts, "")
    mixed = pc.match_substring_regex(texts, SPACE_AFTER_SPACE).to_numpy(zero_copy_only=False)
    rows = len(texts)
    tokens = np.zeros(rows, dtype=np.int64)
    # Elsewhere a text is its first part and " " + part for each further one, each encoded alone.
    parts = pc.split_pattern(pc.if_else(pa.array(mixed), "", texts), " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    units = flat.dictionary.to_pylist()
    index = flat.indices.to_numpy().astype(np.int64)
    first = offsets[:-1]
    after = np.array([counter.count(" " + unit) for unit in units], dtype=np.int64)
    each = after[index]
    alone = {u: counter.count(units[u]) for u in np.unique(index[first]).tolist()}
    each[first] = [alone[u] for u in index[first].tolist()]
    running = np.concatenate(([0], np.cumsum(each)))
    tokens[:] = running[offsets[1:]] - running[first]
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    covered = sizes.copy()
    for row in np.nonzero(mixed)[0].tolist():
        ends = counter.ends(texts[row].as_py())
        tokens[row] = len(ends)
        if len(ends) > limit:
            covered[row] = ends[limit - 1] if limit else 0
    lengths = np.array([len(unit.encode()) for unit in units], dtype=np.int64)[index] + 1
    lengths[first] -= 1
    reached = np.concatenate(([0], np.cumsum(lengths)))
    for row in np.nonzero(~mixed & (tokens > limit))[0].tolist():
        begin, end = offsets[row], offsets[row + 1]
        at = begin + bisect.bisect_right(running[begin + 1 : end + 1] - running[begin], limit)
        left = limit - int(running[at] - running[begin])
        unit = units[index[at]] if at == begin else " " + units[index[at]]
        inside = counter.ends(unit)[left - 1] if left else 0
        covered[row] = reached[at] - reached[begin] + inside
    return tokens, covered


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit and limit_bytes (the bytes of the first ``limit`` tokens).

    Special strings inside texts count as one token, as the tokenizer's default has it. A null text is an
    empty one and has no token; every row has its result, repeated rows too.
    """
    slim = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", slim.schema["key"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
            T.StructField("limit_bytes", T.LongType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counts_of(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            if not len(texts):
                continue
            tokens, covered = _batch(counter, texts, limit)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), sizes, pa.array(tokens), pa.array(tokens > limit), pa.array(covered)],
                names=[field.name for field in schema],
            )

    return slim.mapInArrow(count, schema).withColumnRenamed("key", key)
