"""Words of Arrow text columns as byte spans, and 64-bit hashes of words and word runs, in numpy.

Everything works on the UTF-8 buffers of a whole Arrow batch: no Python object per word.  Hashes are
polynomials over bytes (or over word hashes) modulo 2**64 with fixed random coefficients, finished by a
bit mixer, so the hash of any run of words follows from two prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Byte classes that end a word: ASCII white space; ASCII that is no letter and no digit.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = [_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
BASES = [int(x) * 2 + 1 for x in _RANDOM.integers(1 << 60, 1 << 62, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a lane's base and of its inverse modulo 2**64, at least *size* of them."""
    if lane not in _POWERS or len(_POWERS[lane][0]) < size:
        pair = []
        for base in (BASES[lane], pow(BASES[lane], -1, 1 << 64)):
            steps = np.full(max(size, CHUNK + 1), base % (1 << 64), dtype=np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[lane] = tuple(pair)
    return _POWERS[lane]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of the rows of a batch: word i is data[start[i]:end[i]], row r has words first[r]:first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), dtype=np.uint64)
        values, i = BYTE_VALUES[lane], 0
        while i < len(out):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + CHUNK, side="right")))
            high = self.end[j - 1]
            up, down = powers(lane, int(high - low) + 1)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(values[self.data[low:high]] * up[:high - low], out=sums[1:])
            out[i:j] = (sums[self.end[i:j] - low] - sums[self.start[i:j] - low]) * down[self.start[i:j] - low]
            i = j
        return mix(out)


def words_of(column: pa.Array, stops: np.ndarray = BLANKS, lower: bool = False) -> Words:
    """Maximal runs of bytes that are no stop byte, row by row."""
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    inside = ~stops[data]
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | opens[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


class Runs:
    """Hashes of runs of consecutive words from two prefix sums, in one lane."""

    def __init__(self, hashes: np.ndarray, lane: int):
        up, self.down = powers(lane, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def slices(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most *size* units each (one row at least), given row offsets."""
    out, row = [], 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        out.append((row, stop))
        row = stop
    return out
