"""Elias-Fano sequences and an n-gram trie made of them, for numpy.

A monotone sequence is kept as packed low bits and a unary bitmap of high parts: about two bits a number more than the
low bits.  The trie's levels are plain arrays that can be written to a folder and opened memory-mapped.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

FINGERPRINT_BITS = 40
# Quantised numbers of a trie: codes are STEP apart in log10; the last code is no successor.
STEP = 0.05
UNSEEN = 255


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest *width* bits of each number, one after another."""
    return np.packbits(((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if width else np.zeros(0, np.uint8)


def unpack(packed: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    """The numbers at the given places of a packed array of *width* bits each."""
    out = np.zeros(len(index), dtype=np.uint64)
    if not width:
        return out
    padded = np.concatenate([packed, np.zeros(9, np.uint8)])
    first = index.astype(np.int64) * width
    byte, shift = first >> 3, (first & 7).astype(np.uint64)
    for k in range((width + 14) // 8):
        piece = padded[byte + k].astype(np.uint64)
        out |= (piece << np.uint64(8 * k)) >> shift if k < 8 else piece << (np.uint64(64) - shift)
    return out & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence of numbers below *universe*."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: int, width: int):
        self.low, self.high, self.size, self.width = low, high, size, width
        self._parts = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        size = len(values)
        width = max(0, (universe // max(1, size)).bit_length() - 1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(size)
        bitmap = np.zeros((universe >> width) + size + 1, dtype=np.uint8)
        bitmap[ones] = 1
        packed = np.concatenate([pack(values[i:i + (1 << 15)], width) for i in range(0, size, 1 << 15)]) if size else np.zeros(0, np.uint8)
        return cls(packed, np.packbits(bitmap, bitorder="little"), size, width)

    def parts(self) -> np.ndarray:
        """The high part of every number: the zeros before its one in the bitmap."""
        if self._parts is None:
            self._parts = np.flatnonzero(np.unpackbits(np.asarray(self.high), bitorder="little"))[:self.size] - np.arange(self.size)
        return self._parts

    def at(self, index: np.ndarray) -> np.ndarray:
        return (self.parts()[index].astype(np.uint64) << np.uint64(self.width)) | unpack(np.asarray(self.low), self.width, index)

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Place of the first number not below each wanted one: its bucket of equal high parts, then the low bits."""
        high = (wanted >> np.uint64(self.width)).astype(np.int64)
        first, last = np.searchsorted(self.parts(), high, side="left"), np.searchsorted(self.parts(), high, side="right")
        low = wanted & np.uint64((1 << self.width) - 1)
        packed = np.asarray(self.low)
        while (open_ := first < last).any():
            at = np.flatnonzero(open_)
            middle = (first[at] + last[at]) // 2
            less = unpack(packed, self.width, middle) < low[at]
            first[at[less]], last[at[~less]] = middle[less] + 1, middle[~less]
        return first


class Trie:
    """Contexts in hash order, monotone pointers to their successors, successors relative to their context, codes."""

    NAMES = ("contexts", "totals", "pointers_low", "pointers_high", "successors_low", "successors_high", "codes", "shape")

    def __init__(self, contexts, totals, pointers: EliasFano, successors: EliasFano, codes):
        self.contexts, self.totals, self.pointers, self.successors, self.codes = contexts, totals, pointers, successors, codes

    @classmethod
    def of(cls, contexts: np.ndarray, totals: np.ndarray, counts: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> Trie:
        """*contexts* ascending with *counts* successors each; *successors* ascending inside their context."""
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), counts)
        keys = (owner << np.uint64(FINGERPRINT_BITS)) | successors.astype(np.uint64)
        return cls(contexts, totals, EliasFano.of(ends, len(keys) + 1), EliasFano.of(keys, max(1, len(contexts)) << FINGERPRINT_BITS), codes)

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each (context, successor), UNSEEN where the trie has none."""
        out = np.full(len(contexts), UNSEEN, dtype=np.uint8)
        if not len(self.contexts) or not len(contexts):
            return out
        owner = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        at = np.flatnonzero(self.contexts[owner] == contexts)
        owner = owner[at].astype(np.uint64)
        wanted = (owner << np.uint64(FINGERPRINT_BITS)) | successors[at].astype(np.uint64)
        place = self.successors.successor(wanted)
        # The place has to lie before the context's pointer, and hold the very successor.
        inside = place < self.pointers.at(owner.astype(np.int64)).astype(np.int64)
        at, place, wanted = at[inside], place[inside], wanted[inside]
        same = self.successors.at(place) == wanted
        out[at[same]] = self.codes[place[same]]
        return out

    def save(self, folder: Path) -> None:
        p, s = self.pointers, self.successors
        for name, level in zip(self.NAMES, (self.contexts, self.totals, p.low, p.high, s.low, s.high, self.codes, np.array([p.size, p.width, s.size, s.width]))):
            np.save(folder / f"{name}.npy", level)

    @classmethod
    def open(cls, folder: Path) -> Trie:
        """The saved levels, memory-mapped."""
        level = {name: np.load(folder / f"{name}.npy", mmap_mode="r" if (folder / f"{name}.npy").stat().st_size > 128 else None) for name in cls.NAMES}
        a, b, c, d = (int(x) for x in level["shape"])
        return cls(level["contexts"], level["totals"], EliasFano(level["pointers_low"], level["pointers_high"], a, b),
                   EliasFano(level["successors_low"], level["successors_high"], c, d), level["codes"])
