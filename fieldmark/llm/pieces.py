"""SentencePiece encoding and decoding over sorted words.

A text becomes marked words: spaces are written as a mark, one mark stands in front, and a word begins at a
mark that follows another character. No piece reaches over the beginning of a word, so each distinct word is
encoded once. The distinct words of a batch are sorted, which is a walk through their trie in depth-first
order: the forward states up to the prefix that a word shares with the one before it stay as they are.

A forward state holds, for one prefix, the best last piece. In a model of the unigram kind that is the piece
with the highest summed score. In a model of the BPE kind it is the piece that the merges leave there: the
one path through the lattice whose neighbours do not merge (see ``bpe``), whose scores are not compared.
Characters without a piece become byte pieces, or the unknown piece in a model without them.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldmark.llm.bpe import PrefixEncoder, merged, merged_halves
from fieldmark.llm.packing import gather

MARK = "\u2581"
#: Words that a worker remembers at most.
REMEMBERED = 1_000_000


class UnigramStates:
    """Forward scores for pieces with additive scores; an unknown character costs ``penalty``."""

    def __init__(self, scores: dict[str, float], penalty: float) -> None:
        self.scores, self.penalty = scores, penalty
        self.longest = max(map(len, scores), default=1)

    def extend(self, word: str, lasts: list[int], best: list[float]) -> None:
        for end in range(len(lasts), len(word) + 1):
            top, length = -float("inf"), 1
            for begin in range(max(0, end - self.longest), end):
                score = self.scores.get(word[begin:end])
                if score is None and end - begin == 1:
                    score = self.penalty
                if score is not None and best[begin] + score > top:
                    top, length = best[begin] + score, end - begin
            lasts.append(length)
            best.append(top)


class BpeStates:
    """Forward states for merges; words with a run of marks, whose merges tie, are merged plainly."""

    def __init__(self, scores: dict[str, float]) -> None:
        def rank(a: str, b: str) -> float | None:
            score = scores.get(a + b)
            return None if score is None else -score

        self.rank = rank
        halves = {}
        for piece in scores:
            if len(piece) > 1 and MARK * 2 not in piece:
                pair = merged_halves(piece, rank)
                if pair:
                    halves[piece] = pair
        self.prefixes: PrefixEncoder[str] = PrefixEncoder(halves, rank)

    def extend(self, word: str, lasts: list[int], best: list[float]) -> None:
        self.prefixes.extend(word, lasts, best)


def shared_length(a: str, b: str) -> int:
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least
    at = 0
    while a[at] == b[at]:
        at += 1
    return at


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, kind: str = "bpe") -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.unknown = model.unk_id()
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        written = [
            b"" if model.is_control(i) else bytes([int(piece[3:5], 16)]) if model.is_byte(i)
            else piece.replace(MARK, " ").encode()
            for i, piece in enumerate(self.pieces)
        ]
        self.byte_lengths = np.array([len(w) for w in written], dtype=np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.byte_pool = np.frombuffer(b"".join(written), dtype=np.uint8)
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        worst = min(scores.values(), default=0.0) - 10.0
        self.states = BpeStates(scores) if kind == "bpe" else UnigramStates(scores, worst)
        self._forget()

    def _forget(self) -> None:
        """No word is remembered; the ids of word number i are ``sizes[i]`` values of ``pool`` from ``starts[i]`` on."""
        self._row: dict[str, int] = {}
        self.pool = np.empty(0, dtype=np.uint32)
        self.starts = self.sizes = np.empty(0, dtype=np.int64)

    def _ids(self, tokens: list[str]) -> list[int]:
        out = list(map(self.ids.get, tokens))
        if None not in out:
            return out
        out = []
        for token in tokens:
            if token in self.ids:
                out.append(self.ids[token])
            elif self.bytes:
                out.extend(self.bytes[b] for b in token.encode())
            else:
                out.append(self.unknown)
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of marked words, depth first through their trie."""
        out: dict[str, list[int]] = {}
        before, lasts, best = "", [0], [0]
        tied = isinstance(self.states, BpeStates)
        for word in sorted(set(words)):
            if tied and MARK * 2 in word:
                out[word] = self._ids(merged(word, self.states.rank))
                continue
            shared = shared_length(before, word)
            del lasts[shared + 1 :], best[shared + 1 :]
            self.states.extend(word, lasts, best)
            out[word] = self._ids(PrefixEncoder.tokens(word, lasts))
            before = word
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        """For different marked words their rows in ``starts`` and ``sizes``; a bounded number of words is kept."""
        new = [word for word in words if word not in self._row]
        if new:
            if len(self._row) + len(new) > REMEMBERED:
                self._forget()
                new = words
            coded = self.encode_words(new)
            sizes = np.fromiter(map(len, coded.values()), dtype=np.int64, count=len(coded))
            ids = np.fromiter(itertools.chain.from_iterable(coded.values()), dtype=np.uint32, count=int(sizes.sum()))
            self._row.update(zip(coded, range(len(self._row), len(self._row) + len(coded)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, ids])
        return np.fromiter(map(self._row.__getitem__, words), dtype=np.int64, count=len(words))

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, list[int], list[int]]:
        """The bytes of all ids, and where each run of ids begins and ends in them; marks are spaces, the first one goes."""
        lengths = self.byte_lengths[ids]
        data = gather(self.byte_pool, self.byte_starts[ids], lengths).tobytes()
        places = np.concatenate(([0], np.cumsum(lengths)))[bounds].tolist()
        begins = [a + (a < b and data[a] == 32) for a, b in zip(places[:-1], places[1:], strict=True)]
        return data, begins, places[1:]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids: marks are spaces, the first one goes, byte pieces are read as UTF-8."""
        data, begins, ends = self.decode_bytes(ids, bounds)
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(begins, ends, strict=True)]


@functools.lru_cache(maxsize=2)
def model_of(path: str, kind: str) -> PieceModel:
    return PieceModel(path, kind)


def marked_words(texts: pa.Array) -> pa.ListArray:
    """Marked words of each text, cut before each mark that follows another character; none for empty texts."""
    marked = pc.replace_substring(pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""), " ", MARK)
    cut = pc.replace_substring_regex(marked, f"([^{MARK}\\x00]){MARK}", f"\\1\x00{MARK}")
    return pc.split_pattern(cut, "\x00")


def _encode(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids begin."""
    texts = pc.fill_null(texts, "")
    zero = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    parts = marked_words(pc.if_else(pa.array(zero), "", texts))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    index = flat.indices.to_numpy().astype(np.int64)
    row = model.rows(flat.dictionary.to_pylist())[index]
    lengths = model.sizes[row]
    ids = gather(model.pool, model.starts[row], lengths)
    bounds = np.concatenate(([0], np.cumsum(lengths)))[offsets]
    # Texts without words, and the rare ones that hold the character used for cutting.
    if not (empty.any() or zero.any()):
        return ids, bounds
    rows = []
    for row in range(len(texts)):
        if empty[row]:
            rows.append(np.zeros(0, dtype=np.uint32))
        elif zero[row]:
            rows.append(np.array(encode_text(model, texts[row].as_py()), dtype=np.uint32))
        else:
            rows.append(ids[bounds[row] : bounds[row + 1]])
    return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text, so that the arrays of ids stay small; a row is never cut."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("value")), 0).to_numpy().astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = int(upto[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def encode_text(model: PieceModel, text: str) -> list[int]:
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    cuts = [0, *(i for i in range(1, len(marked)) if marked[i] == MARK != marked[i - 1]), len(marked)]
    words = [marked[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    coded = model.encode_words(words)
    return [i for word in words for i in coded[word]]


def _key_frame(docs: DataFrame, key: str, column: str) -> DataFrame:
    return docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{column}`"].alias("value"))


def encode(docs: DataFrame, path: str, kind: str = "bpe", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; a null or empty text has no ids."""
    slim = _key_frame(docs, key, text)
    schema = T.StructType(
        [T.StructField("key", slim.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path, kind)
        for batch in slices(batches):
            if batch.num_rows:
                ids, bounds = _encode(model, batch.column("value"))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "ids"])

    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, kind: str = "bpe", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of every row of ids; null ids give an empty text."""
    slim = _key_frame(rows, key, ids)
    schema = T.StructType(
        [T.StructField("key", slim.schema["key"].dataType), T.StructField("text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path, kind)
        for batch in batches:
            found = batch.column("value").to_pylist()
            bounds = np.concatenate(([0], np.cumsum([len(ids or ()) for ids in found]))).astype(np.int64)
            flat = np.fromiter((i for ids in found for i in ids or ()), dtype=np.int64, count=int(bounds[-1]))
            texts = model.decode(flat, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, kind: str = "bpe", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of encoding and decoding every text: ``key``, n_tokens, ids_crc32, lossless.

    Encoding and decoding meet in one pass, so that ids of a whole corpus need not be kept. ``lossless``
    says that decoding gives the text back; texts that hold the mark itself come back with spaces.
    """
    slim = _key_frame(docs, key, text)
    schema = T.StructType(
        [
            T.StructField("key", slim.schema["key"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("lossless", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path, kind)
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("value"), "")
            ids, bounds = _encode(model, texts)
            pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in pairs]
            data, begins, ends = model.decode_bytes(ids, bounds)
            same = [
                data[a:b] == text.as_buffer().to_pybytes()
                for a, b, text in zip(begins, ends, texts.cast(pa.binary()), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(same)],
                names=[field.name for field in schema],
            )

    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)
