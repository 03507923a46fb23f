"""Fingerprints of every window of a byte string, from one running sum.

A window's fingerprint depends on its bytes alone, so equal windows of different documents have equal
fingerprints without any table shared between tasks. Work is done on at most CHUNK + MARGIN bytes at a
time; the power tables have that length once per Python worker.
"""

from __future__ import annotations

import functools

import numpy as np

CHUNK = 1 << 20
MARGIN = 1 << 12
MULTIPLIER = 0x9E3779B97F4A7C15
SECOND_MULTIPLIER = 0xD1B54A32D192ED03


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits of the result."""
    with np.errstate(over="ignore"):
        z = values ^ (values >> np.uint64(31))
        z *= np.uint64(0x7FB5D329728EA185)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x81DADEF4BC2DD44D)
        return z ^ (z >> np.uint64(33))


@functools.lru_cache(maxsize=4)
def tables(multiplier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, the powers of the multiplier, and their inverses modulo 2**64."""
    size = CHUNK + MARGIN + 1
    numbers = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(multiplier))
    inverse = pow(multiplier, -1, 1 << 64)

    def powers(base: int) -> np.ndarray:
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return numbers, powers(multiplier), powers(inverse)


def running_sums(data: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Weighted sums of all prefixes of at most CHUNK + MARGIN bytes."""
    numbers, powers, _ = tables(multiplier)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(numbers[data], powers[: len(data)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def windows(
    sums: np.ndarray, begin: np.ndarray, end: np.ndarray, multiplier: int = MULTIPLIER
) -> np.ndarray:
    """Fingerprints of data[begin:end], pair by pair."""
    inverse = tables(multiplier)[2]
    return mix((sums[end] - sums[begin]) * inverse[begin])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
