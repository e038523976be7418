"""Words and rolling hashes over text buffers, vectorised."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: A random 64-bit value for each byte, so that the rolling hash has no weak low bits to speak of.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = 1 << max(12, (n - 1).bit_length())
        found = np.full(size, base, np.uint64)
        found[0] = 1
        with np.errstate(over="ignore"):
            found = np.multiply.accumulate(found)
        _powers[base] = found
    return found[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * BASE**j for j < i, modulo 2**64, for i = 0 ... n."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that doesn't depend on where they stand."""
    return (prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in data of the words [^\\x20\\x09-\\x0D]+ of each row, and how many each row has. at: where rows start."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix = prefix_hash(BYTE_VALUES[data])
    return mixed(span_hash(prefix, starts, ends) + (ends - starts).astype(np.uint64))
