"""Benchmark decontamination by suffix arrays over the training documents.

Every task turns the words of its documents into suffix arrays, shard by shard (a shard is a bounded slice of the
words of an Arrow batch; slices overlap by one window).  Suffixes are ordered by their first twelve words with three
rounds of prefix doubling.  Every suffix of every benchmark item is then searched in every shard by binary search;
the interval found holds all places where its window occurs verbatim, and neighbouring windows on one diagonal join
to the longest matches.  Documents never leave their task, so nothing is shuffled.

The benchmark is the query set.  It is cut into blocks of bounded size, counted before, and each block is one
broadcast: memory does not depend on the benchmark's size, only the number of searches does.

Defined cases: null texts have no words; an item of fewer words than a window is one window, an item without words
none; repeated items count once by id, an item without id is named by the empty text; repeated documents are
reported alike; empty tables give no hits; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlight.llm.textual import NON_ALNUM, words_of

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20


class Patterns:
    """The different windows of a block of items, and the items and places that each comes from.

    A width's windows are searched once, however many items share them: windows[i] is a row of word hashes that stands
    at item[k], place[k] for k in first[i]:first[i + 1].
    """

    def __init__(self, ids: list, texts: pa.Array, window: int):
        words = words_of(texts, NON_ALNUM, lower=True)
        hashes, counts = words.hashes(), words.counts
        self.ids, self.window = ids, window
        self.whole = self._windows(hashes, words.first, counts, window, counts >= window)
        self.short = [self._windows(hashes, words.first, counts, n, counts == n) for n in range(1, window) if (counts == n).any()]

    @staticmethod
    def _windows(hashes, first, counts, width, rows):
        rows = np.flatnonzero(rows)
        many = counts[rows] - width + 1
        item = np.repeat(rows, many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        every = hashes[(first[item] + place)[:, None] + np.arange(width)] if len(item) else np.zeros((0, width), np.uint64)
        windows, which = np.unique(every, axis=0, return_inverse=True)
        order = np.argsort(which.reshape(-1), kind="stable")
        return Windows(windows, np.searchsorted(which.reshape(-1)[order], np.arange(len(windows) + 1)), item[order], place[order])


@dataclass
class Windows:
    windows: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def sources(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window of *which* its sources: (index into which, index into item and place)."""
        many = self.first[which + 1] - self.first[which]
        return np.repeat(np.arange(len(which)), many), np.arange(many.sum()) + np.repeat(self.first[which] - np.cumsum(many) + many, many)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions ordered by the twelve numbers that follow (numbers below 2**21, zero after the end)."""
    rank, size = ids.astype(np.int64), len(ids)
    padded = np.concatenate([rank, np.zeros(2, np.int64)])
    key = (padded[:size] << 42) | (padded[1:size + 1] << 21) | padded[2:size + 2]
    for step in (3, 6, None):
        order = np.argsort(key)
        if step is None:
            return order
        steps = np.ones(size, dtype=np.int64)
        steps[1:] = np.diff(key[order]) != 0
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(steps)
        after = np.zeros(size, dtype=np.int64)
        after[:max(0, size - step)] = rank[step:]
        key = (rank << 32) | after


def search(ids: np.ndarray, order: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place in the suffix array of the suffixes that begin with each pattern."""
    padded = np.concatenate([ids, np.zeros(patterns.shape[1], ids.dtype)])
    steps = np.arange(patterns.shape[1])

    def bound(past_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            middle = (low[at] + high[at]) // 2
            there = padded[order[middle][:, None] + steps]
            differs = there != patterns[at]
            column = differs.argmax(axis=1)
            rows = np.arange(len(at))
            less = there[rows, column] < patterns[at][rows, column]
            less |= past_equal & ~differs[rows, column]
            low[at[less]] = middle[less] + 1
            high[at[~less]] = middle[~less]
        return low

    return bound(False), bound(True)


def occurrences(words, blocks: list[Callable[[], Patterns]]) -> Iterator[tuple[Patterns, np.ndarray, np.ndarray, Windows]]:
    """Per block and width: flat word position and number of the window of every occurrence of a different window.

    The flat positions count one separator after every document.
    """
    hashes = words.hashes()
    rows = words.rows()
    flat = np.zeros(len(hashes) + len(words.counts), dtype=np.uint64)
    real = np.zeros(len(flat), dtype=bool)
    flat[np.arange(len(hashes)) + rows] = hashes
    real[np.arange(len(hashes)) + rows] = True
    shards = []
    for low in range(0, len(flat), SHARD_WORDS):
        # Hash order is as good an order of words as any other; zero is the separator.
        part, own = flat[low:low + SHARD_WORDS + WINDOW - 1], real[low:low + SHARD_WORDS + WINDOW - 1]
        known, inverse = np.unique(part[own], return_inverse=True)
        ids = np.zeros(len(part), dtype=np.int64)
        ids[own] = inverse + 1
        shards.append((low, known, ids, suffix_array(ids)))
    for block in blocks:
        patterns = block()
        for own in [patterns.whole, *patterns.short]:
            parts = []
            for low, known, ids, order in shards:
                if not len(own.windows) or not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, own.windows), len(known) - 1)
                there = np.flatnonzero((known[at] == own.windows).all(axis=1))
                first, last = search(ids, order, at[there] + 1)
                many = last - first
                total = int(many.sum())
                spots = order[np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)] + low
                parts.append((spots, np.repeat(there, many)))
            if parts:
                yield (patterns, *(np.concatenate(x) for x in zip(*parts)), own)


def _blocks(benchmark: DataFrame) -> list[Callable[[], Patterns]]:
    """The benchmark as broadcast blocks of about BLOCK_BYTES of text each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    many = int(-(-size // BLOCK_BYTES))
    out = []
    for b in range(many):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).toArrow()
        sent = spark.sparkContext.broadcast((part["item_id"].to_pylist(), part["text"].cast(pa.large_string()).combine_chunks()))
        out.append(_Opened(sent, uuid.uuid4().hex))
    return out


class _Opened:
    """A broadcast block; a worker keeps the one it opened last."""

    last: tuple[str, Patterns | None] = ("", None)

    def __init__(self, sent, key: str):
        self.sent, self.key = sent, key

    def __call__(self) -> Patterns:
        if _Opened.last[0] != self.key:
            _Opened.last = (self.key, Patterns(*self.sent.value, WINDOW))
        return _Opened.last[1]


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(n_words, n_hit, n_items, items_sha256, contaminated, row): the last holds the columns of the input row."""
    blocks = _blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch["text"], NON_ALNUM, lower=True)
            counts, documents = words.counts, len(words.counts)
            bounds = words.first + np.arange(documents + 1)
            edges = np.zeros(int(bounds[-1]) + 1, dtype=np.int32)
            items: list[set] = [set() for _ in range(documents)]
            for patterns, spots, which, own in occurrences(words, blocks):
                np.add.at(edges, spots, 1)
                np.add.at(edges, spots + own.windows.shape[1], -1)
                # Each different window counts once a document, then each of its items once.
                row = np.searchsorted(bounds, spots, side="right") - 1
                row, which = np.divmod(np.unique(row * len(own.windows) + which), max(1, len(own.windows)))
                at, source = own.sources(which)
                for r, i in zip(*np.divmod(np.unique(row[at] * len(patterns.ids) + own.item[source]), max(1, len(patterns.ids)))):
                    items[r].add(patterns.ids[i])
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
            hit = covered[bounds[1:]] - covered[bounds[:-1]] if documents else np.zeros(0, np.int64)
            digests = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                 pa.array(digests, pa.string()), pa.array(hit > 0, pa.bool_()), batch["row"]],
                ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "row"])

    whole = docs.select("text", F.struct("*").alias("row"))
    out = StructType.fromDDL("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean").add(whole.schema["row"])
    return whole.mapInArrow(run, out)


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): the longest verbatim matches of a window or more, and where they are."""
    blocks = _blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch["text"], NON_ALNUM, lower=True)
            bounds = words.first + np.arange(len(words.counts) + 1)
            for patterns, spots, which, own in occurrences(words, blocks):
                at, source = own.sources(which)
                spots, item, place = spots[at], own.item[source], own.place[source]
                keys = np.unique(np.stack([item, spots - place, spots, np.full(len(spots), own.windows.shape[1])], axis=1), axis=0)
                item, diagonal, spots, width = keys.T
                opens = np.ones(len(keys), dtype=bool)
                opens[1:] = (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(spots) != 1)
                first = np.flatnonzero(opens)
                last = np.append(first[1:], len(keys)) - 1
                row = np.searchsorted(bounds, spots[first], side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row)), pa.array([patterns.ids[i] for i in item[first]], pa.string()),
                     pa.array(spots[first] - bounds[row], pa.int64()), pa.array(spots[first] - diagonal[first], pa.int64()),
                     pa.array(spots[last] - spots[first] + width[first], pa.int64())],
                    ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id string, doc_word bigint, item_word bigint, n_words bigint")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return marked(docs, benchmark).where("not contaminated").select("row.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = marked(docs.select("doc_id", "text"), benchmark)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
