"""Words and rolling word hashes of many texts at once, in numpy over Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit polynomials over the
whole word (or run of words), so equal words have equal hashes in every task and on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are hashed in slices of about so many bytes; a longer text is a slice of its own
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}
WORD_BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64), 1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**n modulo 2**64, kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            known = np.multiply.accumulate(steps)
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = known
    return known


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum(values[j] * base**(j - start)) over start <= j < end, modulo 2**64."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(base, len(values))[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * _powers(_inverse(base), len(values))[starts]


@dataclass
class Words:
    """Words of a run of texts: ``first[d]:first[d + 1]`` are those of text d; bounds are byte offsets in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def string_array(column) -> pa.Array:
    """One large_string array with nulls as empty texts."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    return array.cast(pa.large_string()).fill_null("")


def slices(column, limit: int = SLICE_BYTES):
    """(first row, array) pieces of a text column, each of about ``limit`` bytes and of one row at least."""
    array = string_array(column)
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, array.slice(at, to - at)
        at = to


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 2) -> np.ndarray:
    """Hash of the bytes of every run start <= i < end."""
    return mix(_runs(_BYTES[data], starts, ends, WORD_BASE), salt)


def split(array: pa.Array, lower: bool = False, blank: np.ndarray = _BLANK) -> Words:
    """The words of every text of a large_string array; ``blank`` says which bytes part words."""
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = _LOWER[data]
    inside = ~blank[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edge] |= inside[edge]
    stops[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, bounds)
    return Words(data, starts, ends, first, byte_hashes(data, starts, ends))


def grams(words: Words, n: int, salt: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words of one text: (hash, index of the first word, text)."""
    counts = np.maximum(words.counts() - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    at = np.arange(len(text)) - ahead[text] + words.first[text]
    return run_hashes(words.hashes, at, at + n, salt), at, text


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hash of every run of word hashes."""
    return mix(_runs(hashes, starts, ends, GRAM_BASE), salt)
