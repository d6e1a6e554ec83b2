"""Substring dedup: seed and extend over winnowed anchors.

A window is LENGTH consecutive words.  Its anchor is the ANCHOR words with the smallest hash in it (the first such), so
equal windows have equal anchors at equal places; neighbouring windows mostly share theirs and form a run.  A document
of n words has about n / 20 runs.

Seed: documents meet on anchor hashes; anchors that only one document has are dropped.
Extend: a run's whole reach, the words that all its windows cover to the left and right of the anchor, is one hash.
Runs of equal reach match completely, and copies need no more than that, however many there are: the smallest doc_id
of each reach is one partial aggregate.  Where runs on one anchor differ, only the first document of each reach is
extended word by word: its windows are shuffled by hash, and a window that an earlier document has is a repeat.
Repeats that touch are one maximal repeat; every word in one is removed.

No pairs of documents are made, so a passage that all documents share costs one row a document.  Hashes of reaches and
windows have 128 bits.  Texts are shuffled by document, never by content.

Defined cases: a null text has no words; a document is judged against smaller ids only, so repeats inside a document
stay and rows that share a doc_id don't judge each other; a null doc_id is larger than any other; texts of fewer words
than a window stay whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.textual import Runs, buffers, slices, words_of
from ledgerlight.session import written

LENGTH = 50
ANCHOR = 10
SLICE_BYTES = 2 << 20


def text_runs(texts: pa.Array, length: int, anchor: int) -> Iterator[dict[str, np.ndarray]]:
    """Runs of the windows of each text: row, first window, number of windows, anchor hash; and the words' hash sums."""
    _, offsets = buffers(texts)
    for low, high in slices(offsets, SLICE_BYTES):
        words = words_of(texts.slice(low, high - low))
        if not len(words.start):
            continue
        lanes = [Runs(words.hashes(lane), lane) for lane in (0, 1)]
        size, row = len(words.start), words.rows()
        if size < length:
            continue
        first = np.arange(size - anchor + 1)
        grams = lanes[0].of(first, first + anchor)
        place = np.lib.stride_tricks.sliding_window_view(grams, length - anchor + 1).argmin(axis=1)
        window = np.flatnonzero(row[:size - length + 1] == row[length - 1:])
        at = window + place[window]
        opens = np.ones(len(window), dtype=bool)
        opens[1:] = (np.diff(at) != 0) | (np.diff(window) != 1)
        start = np.flatnonzero(opens)
        yield {"lanes": lanes, "row": row[window[start]] + low, "flat": window[start], "start": window[start] - words.first[row[window[start]]],
               "windows": np.diff(np.append(start, len(window))), "anchor": grams[at[start]]}


def runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(doc_id, key, start, windows, anchor, reach_a, reach_b) of every run of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in text_runs(batch["text"], length, anchor):
                rows = pa.array(found["row"])
                reach = [lane.of(found["flat"], found["flat"] + found["windows"] + length - 1).view(np.int64) for lane in found["lanes"]]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(rows), batch["key"].take(rows), pa.array(found["start"], pa.int32()), pa.array(found["windows"], pa.int32()),
                     pa.array(found["anchor"].view(np.int64)), pa.array(reach[0]), pa.array(reach[1])],
                    ["doc_id", "key", "start", "windows", "anchor", "reach_a", "reach_b"])

    return docs.mapInArrow(run, "doc_id bigint, key bigint, start int, windows int, anchor bigint, reach_a bigint, reach_b bigint")


def windows_of(marked: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, at, hash_a, hash_b) of every window in the stretches of each document: rows (doc_id, key, text, stretches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch["text"])
            for low, high in slices(offsets, SLICE_BYTES):
                part = batch.slice(low, high - low)
                words, stretches = words_of(part["text"]), part["stretches"]
                owner = np.repeat(np.arange(high - low), np.asarray(stretches.value_lengths()))
                flat = stretches.flatten()
                start, many = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("windows")).astype(np.int64)
                total = int(many.sum())
                at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
                owner = np.repeat(owner, many)
                place = at + words.first[owner]
                hashes = [Runs(words.hashes(lane), lane).of(place, place + length).view(np.int64) for lane in (0, 1)]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(rows), part["key"].take(rows), pa.array(at, pa.int32()), pa.array(hashes[0]), pa.array(hashes[1])],
                                                 ["doc_id", "key", "at", "hash_a", "hash_b"])

    return marked.select("doc_id", "key", "text", "stretches").mapInArrow(run, "doc_id bigint, key bigint, at int, hash_a bigint, hash_b bigint")


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, key, start, windows): stretches of windows that a document with a smaller id has too.

    *docs* has doc_id, key (a hash of the text) and text.  Stretches may touch or overlap.
    """
    # A null id sorts last: it takes the largest number while documents are compared.
    last = F.lit((1 << 63) - 1)
    found = written(runs(docs, length, anchor).withColumn("order", F.coalesce("doc_id", last)), "substring-runs")
    # Sums are written before they are joined, so that a frequent anchor, reach or window can be split in the join.
    seeds = found.groupBy("anchor").agg(F.min("order").alias("low"), F.max("order").alias("high"), (F.min("reach_a") < F.max("reach_a")).alias("differ")).where("low < high")
    seeds = written(seeds.select("anchor", "differ"), "substring-seeds")
    shared = written(found.join(seeds, "anchor"), "substring-shared")
    reaches = written(shared.groupBy("reach_a", "reach_b").agg(F.min("order").alias("first")), "substring-reaches")
    judged = written(shared.join(reaches, ["reach_a", "reach_b"]).select("doc_id", "key", "start", "windows", (F.col("first") < F.col("order")).alias("repeat"), "differ")
                     .where("repeat or differ"), "substring-judged")
    whole = judged.where("repeat").select("doc_id", "key", "start", "windows")
    open_ = judged.where("not repeat").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "windows")).alias("stretches"))
    marked = docs.alias("d").join(open_.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.key") == F.col("o.key"))).select("d.*", "o.stretches")
    tried = written(windows_of(marked, length).withColumn("order", F.coalesce("doc_id", last)), "substring-windows")
    earliest = tried.groupBy("hash_a", "hash_b").agg(F.min("order").alias("first"), F.max("order").alias("final")).where("first < final")
    earliest = written(earliest.drop("final"), "substring-earliest")
    extended = tried.join(earliest, ["hash_a", "hash_b"]).where("first < order").select("doc_id", "key", F.col("at").alias("start"), F.lit(1).alias("windows"))
    return whole.union(extended)


def cut(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): every document without its repeats."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    marks = repeats(keyed, length, anchor).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "windows")).alias("stretches"))
    joined = keyed.alias("d").join(marks.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.key") == F.col("m.key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, high - low) for whole in batches for low, high in slices(buffers(whole["text"])[1], SLICE_BYTES)):
            sizes, gone, kept, digests = [], [], [], []
            for text, stretches in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["stretches"]):
                words, removed = text.split(), 0
                if stretches.is_valid and len(stretches):
                    flat = stretches.values
                    start, end = np.asarray(flat.field("start")), np.asarray(flat.field("start")) + np.asarray(flat.field("windows")) + length - 1
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, end, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    removed = len(words) - int(stays.sum())
                    words = [w for w, s in zip(words, stays) if s]
                joined = b" ".join(words)
                sizes.append(len(words) + removed)
                gone.append(removed)
                kept.append(joined)
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined.select("d.doc_id", "d.text", "m.stretches").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def cut_report(docs: DataFrame) -> DataFrame:
    return cut(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
