"""Byte-pair encodings by prefixes instead of merges.

The encoding of a word's prefix ends with one token, and a sequence of tokens is the encoding of its text
exactly if each neighbouring pair is the encoding of its own text. So the last token of every prefix can be
found from shorter prefixes: it is the one token that stands well behind the last token of what is left.
One pass over a word thus gives the encodings, and the token counts, of all its prefixes.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Sequence
from typing import AnyStr, Generic

#: Pairs and words that a worker remembers at most.
REMEMBERED = 400_000


def merged(
    symbols: Sequence[AnyStr],
    rank: Callable[[AnyStr, AnyStr], float | None],
    tell: Callable[[tuple[AnyStr, AnyStr]], None] | None = None,
) -> list[AnyStr]:
    """Plain merging: the pair of lowest rank first, the leftmost of equals. ``tell`` hears of every merge."""
    parts: list[AnyStr | None] = list(symbols)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    queue: list[tuple[float, int, AnyStr, AnyStr]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < len(parts):
            r = rank(parts[left], parts[right])
            if r is not None:
                heapq.heappush(queue, (r, left, parts[left], parts[right]))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, left, a, b = heapq.heappop(queue)
        if parts[left] != a or after[left] >= len(parts) or parts[after[left]] != b:
            continue
        right = after[left]
        if tell:
            tell((a, b))
        parts[left], parts[right] = a + b, None
        after[left] = after[right]
        if after[left] < len(parts):
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [part for part in parts if part is not None]


class PrefixEncoder(Generic[AnyStr]):
    """Last token and token count of every prefix of a word.

    ``rank`` gives the place of a pair among the merges, if it merges at all. ``halves`` has, for each token
    of more than one symbol, the pair whose merge makes it.
    """

    def __init__(
        self,
        halves: dict[AnyStr, tuple[AnyStr, AnyStr]],
        rank: Callable[[AnyStr, AnyStr], float | None],
    ) -> None:
        self.rank = rank
        self.halves = halves
        self.made = {token: rank(*pair) for token, pair in halves.items()}
        self.endings = {token[i:] for token in halves for i in range(len(token))}
        self._fits: dict[tuple[AnyStr, AnyStr], bool] = {}

    def apart(self, left: AnyStr, right: AnyStr) -> bool:
        """Whether merging the joined text of two tokens never merges across their border.

        The merges that made both tokens are taken back, the latest first. Two parts that met at the border
        would have merged if their merge comes before the one that took either of them; of equal merges
        the left one comes first.
        """
        made, halves = self.made, self.halves
        bound = float("inf")
        while True:
            crossing = self.rank(left, right)
            if crossing is not None and crossing < bound:
                return False
            of_left, of_right = made.get(left, -1), made.get(right, -1)
            if of_left > of_right:
                bound, left = of_left, halves[left][1]
            elif of_right >= 0:
                bound, right = of_right + 0.5, halves[right][0]
            else:
                return True

    def extend(self, word: AnyStr, lasts: list[int], counts: list[int]) -> None:
        """Carry on both lists, which cover some prefix of ``word`` (at least the empty one), to its end."""
        halves, endings, known = self.halves, self.endings, self._fits
        for end in range(len(lasts), len(word) + 1):
            for begin in range(end - 1, -1, -1):
                token = word[begin:end]
                if token in halves or end - begin == 1:
                    if not begin:
                        break
                    pair = (word[begin - lasts[begin] : begin], token)
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        fits = known[pair] = self.apart(*pair)
                    if fits:
                        break
                elif token not in endings:
                    raise ValueError(f"no token ends the prefix {word[:end]!r}")
            else:
                raise ValueError(f"no token ends the prefix {word[:end]!r}")
            lasts.append(end - begin)
            counts.append(counts[begin] + 1)

    def prefixes(self, word: AnyStr) -> tuple[list[int], list[int]]:
        """Length of the last token, and token count, of each prefix from the empty one to the whole word."""
        lasts, counts = [0], [0]
        self.extend(word, lasts, counts)
        return lasts, counts

    @staticmethod
    def tokens(word: AnyStr, lasts: Sequence[int]) -> list[AnyStr]:
        """The tokens of the whole word, read off from its end."""
        end, out = len(word), []
        while end:
            out.append(word[end - lasts[end] : end])
            end -= lasts[end]
        return out[::-1]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_encoder(path: str) -> tuple[PrefixEncoder[bytes], dict[bytes, int], list[str]]:
    """Encoder, ids and special strings of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    letters = byte_letters()

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    special = [token["content"] for token in described["added_tokens"]]
    ids = {raw(t): i for t, i in described["model"]["vocab"].items() if t not in special}
    merges = [(raw(a), raw(b)) for a, b in described["model"]["merges"]]
    ranks = {pair: place for place, pair in enumerate(merges)}
    halves = {a + b: (a, b) for a, b in reversed(merges)}
    return PrefixEncoder(halves, lambda a, b: ranks.get((a, b))), ids, special


def merged_halves(
    token: AnyStr, rank: Callable[[AnyStr, AnyStr], float | None]
) -> tuple[AnyStr, AnyStr] | None:
    """The last merge that makes ``token`` from its symbols; None if merging does not end in one token."""
    made: list[tuple[AnyStr, AnyStr]] = []
    parts = merged([token[i : i + 1] for i in range(len(token))], rank, made.append)
    return made[-1] if len(parts) == 1 and made else None
