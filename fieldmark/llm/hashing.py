"""Hashes of many byte strings at once, as NumPy columns: xxhash64 and crc32.

The strings are slices of one buffer, given by first byte and length; they may overlap. The buffer has
``SPARE`` bytes behind the last string, whose values do not matter.
"""

from __future__ import annotations

import numpy as np

SPARE = 8

#: The five odd multipliers of xxhash64.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _crc_table() -> np.ndarray:
    """What a byte adds to a checksum, by the reversed polynomial of crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def words_at(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian number of ``kind`` that begins at each byte."""
    width = np.dtype(kind).itemsize
    return np.ndarray((max(len(data) - width + 1, 0),), dtype=kind, buffer=data, strides=(1,))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    return _turned(x * P2, 31) * P1


def xxhash64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The 64-bit xxhash (seed 0) of each string."""
    eights, fours = words_at(data, "<u8"), words_at(data, "<u4")
    out = np.full(len(starts), P5)
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        out[long] = _striped(eights, starts[long], lengths[long])
    out += lengths.astype(np.uint64)
    at, end = starts + (lengths & ~31), starts + lengths
    for _ in range(3):
        some = np.flatnonzero(end - at >= 8)
        if not len(some):
            break
        out[some] = _turned(out[some] ^ _mixed(eights[at[some]]), 27) * P1 + P4
        at[some] += 8
    some = np.flatnonzero(end - at >= 4)
    out[some] = _turned(out[some] ^ fours[at[some]].astype(np.uint64) * P1, 23) * P2 + P3
    at[some] += 4
    for _ in range(3):
        some = np.flatnonzero(end > at)
        out[some] = _turned(out[some] ^ data[at[some]].astype(np.uint64) * P5, 11) * P1
        at[some] += 1
    for shift, factor in ((33, P2), (29, P3)):
        out = (out ^ (out >> np.uint64(shift))) * factor
    return out ^ (out >> np.uint64(32))


def _striped(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What whole stripes of 32 bytes make, before the length and the tail."""
    seeds = (int(P1) + int(P2), int(P2), 0, -int(P1))
    lanes = [np.full(len(starts), seed % 2**64, dtype=np.uint64) for seed in seeds]
    left, at = np.arange(len(starts)), 0
    while len(left):
        for place, lane in enumerate(lanes):
            lane[left] = _turned(lane[left] + eights[starts[left] + (at + 8 * place)] * P2, 31) * P1
        at += 32
        left = left[lengths[left] >= at + 32]
    out = sum(_turned(lane, bits) for lane, bits in zip(lanes, (1, 7, 12, 18), strict=True))
    for lane in lanes:
        out = (out ^ _mixed(lane)) * P1 + P4
    return out


def crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of each string, as unsigned 32-bit numbers."""
    # Longest first, so that the strings with a byte at a place are always the first ones.
    order = np.argsort(-lengths, kind="stable")
    at, some = starts[order], lengths[order]
    state = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    ends = len(at) - np.searchsorted(some[::-1], np.arange(some[0] if len(some) else 0), side="right")
    for place, n in enumerate(ends.tolist()):
        byte = data[at[:n] + place]
        state[:n] = CRC_TABLE[(state[:n] ^ byte) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out
