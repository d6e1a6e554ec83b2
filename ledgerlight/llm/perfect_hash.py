"""Minimal perfect hashing of distinct 32-bit numbers, bucket by bucket, in numpy.

Level by level every key of a bucket is hashed into a bit array of GAMMA bits a key; a bit is set where exactly one key
falls, and the other keys go on to the next level until none is left.  A key's index is the number of set bits before its
own, so buckets laid one after another share one numbering.  A lookup of a number that is no key gives any index or -1;
whoever needs to know compares the key stored at the index.
"""

from __future__ import annotations

import numpy as np

from ledgerlight.llm.textual import mix

GAMMA = 2.0


def places(keys: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels of one bucket, and their bits in 64-bit words."""
    sizes, words, left = [], [np.zeros(0, np.uint64)], keys
    while len(left):
        size = -(-int(len(left) * GAMMA) // 64) * 64
        place = places(left, len(sizes), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, np.uint8)
        bits[place[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~alone]
    return np.array(sizes, np.int64), np.concatenate(words)


class PerfectHash:
    """The bit arrays of several buckets, looked up together."""

    def __init__(self, buckets: list[tuple[np.ndarray, np.ndarray]]):
        levels = max((len(s) for s, _ in buckets), default=0)
        self.sizes = np.zeros((len(buckets), levels), np.int64)
        for i, (sizes, _) in enumerate(buckets):
            self.sizes[i, :len(sizes)] = sizes
        self.low = np.append(0, np.cumsum(self.sizes.ravel()))[:-1].reshape(self.sizes.shape)
        self.words = np.concatenate([*(w for _, w in buckets), np.zeros(1, np.uint64)])
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def index(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The index of every key among those of all buckets, given its bucket's place in the list."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[bucket[open_], level]
            if not size.all():
                open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            place = places(keys[open_], level, size) + self.low[bucket[open_], level]
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[place[hit] >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out
