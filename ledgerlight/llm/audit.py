"""Filter interaction audit by truth-table survival words.

Every document becomes one 32-bit word: bit S is set when the document survives the set S of filters (S is itself a
word of five bits, one a filter).  Positional popcounts of these words, by part and label, are the survivors of all 32
subsets; every figure of every filter order is a difference of two of them, so the 120 orders cost nothing more than
one pass over the texts.

The popcounts are carry-save sums: three words of one weight become a word of the same weight (their parity) and one
of twice the weight (their majority) until at most two words of each weight are left; only those are read bit by bit.
A task returns at most 32 numbers for each part and label class, which Spark adds up.

The text conditions are built-in functions.  Copies are found by the SHA-256 of the whole text: the smallest doc_id of
each hash that occurs more than once is joined back to the narrow rows, where Spark splits a hash with many copies.

Defined cases: a null text is the empty text (so it is a copy of an empty one); a null source is the part named by the
empty text; a null doc_id is larger than any other, has no label, and rows that share one doc_id are no copies of each
other by that id; a document with several label rows has a label when any of them says so; very long texts are scanned
whole; an empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)


def carry_save(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits set."""
    counts, weight = np.zeros(32, np.int64), 0
    level, bits = words.astype(np.uint32), np.arange(32, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n:2 * n], level[2 * n:3 * n]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, level[3 * n:]])
        for word in level:
            counts += ((word >> bits) & np.uint32(1)).astype(np.int64) << weight
        level, weight = np.concatenate(carries) if carries else level[:0], weight + 1
    return counts


def survival_word(failed: np.ndarray) -> np.ndarray:
    """The word of a document that fails the filters of the five-bit number *failed*."""
    every = np.arange(SUBSETS)
    table = [(1 << every[(every & f) == 0].astype(np.uint64)).sum() for f in every]
    return np.array(table, dtype=np.uint32)[failed]


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D on a text without null."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def failure_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic), one narrow row per document."""
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(text))), F.lit(0))
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.alias("failed"), F.sha2(text, 256).alias("digest"))
    rows = written(rows, "audit-rows")
    last = F.lit((1 << 63) - 1)
    copies = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first")
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copied = F.coalesce(F.coalesce("doc_id", last) > F.col("first"), F.lit(False))
    joined = rows.join(copies, "digest", "left").join(label, "doc_id", "left")
    return joined.select("doc_id", "part", (F.col("failed") + F.when(copied, 1 << 4).otherwise(0)).alias("failed"),
                         F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def subset_survivors(rows: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents of each part that survive each set of filters, all and by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            parts = batch["part"].dictionary_encode()
            names, code = parts.dictionary.to_pylist(), np.asarray(parts.indices).astype(np.int64)
            group = code * 4 + np.asarray(batch["good"].cast(pa.int8())) * 2 + np.asarray(batch["toxic"].cast(pa.int8()))
            order = np.argsort(group, kind="stable")
            words, group = survival_word(np.asarray(batch["failed"]))[order], group[order]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(group))):
                counts, kind = carry_save(words[a:b]), int(group[a]) & 3
                sums = total.setdefault(names[group[a] >> 2], np.zeros((3, SUBSETS), np.int64))
                sums += counts * np.array([[1], [kind >> 1], [kind & 1]])
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * SUBSETS), pa.array(np.arange(SUBSETS, dtype=np.int32)), *map(pa.array, sums)], ["part", "subset", "n", "good", "toxic"])

    found = rows.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, subset int, n bigint, good bigint, toxic bigint")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(survivors: DataFrame) -> DataFrame:
    """The rows of every part, filter order and step from the survivors of the 32 subsets."""
    table = survivors.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", "good", "toxic")))).alias("at"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[i] for i in order)
        for step, k in enumerate(order, 1):
            steps.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'before', {before}, 'own', {1 << k})")
            before |= 1 << k
    everything, n = SUBSETS - 1, lambda subset, what="n": F.col("at")[subset][what]

    def shapley(own: int) -> str:
        """Removed documents of a filter, each set of filters before it as often as it comes first in an order."""
        before = [s for s in range(SUBSETS) if not s & own]
        times = {s: math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) for s in before}
        return " + ".join(f"{times[s]} * (at[{s}].n - at[{s | own}].n)" for s in before)

    # The sums over all orders are five numbers a part; every row then picks its own.
    shares = F.expr("map(" + ", ".join(f"{1 << k}, {shapley(1 << k)}" for k in range(len(FILTERS))) + ")")
    rows = table.select("part", "at", shares.alias("shares")).select("part", "at", "shares", F.expr(f"inline(array({', '.join(steps)}))"))
    before, own = F.col("before"), F.col("own")
    after = before.bitwiseOR(own)
    removed = n(before) - n(after)
    return rows.select("part", "filter_order", "step", n(after).alias("kept"), removed.alias("removed"),
                       (n(F.lit(0)) - n(own) - removed).alias("redundant"), (n(F.lit(everything).bitwiseXOR(own)) - n(F.lit(everything))).alias("unique_fails"),
                       (n(before, "good") - n(after, "good")).alias("good_lost"), (n(before, "toxic") - n(after, "toxic")).alias("toxic_lost"), F.col("shares")[own].alias("shapley"))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """How the five filters work together in every order, by part."""
    return audit(written(subset_survivors(failure_rows(documents, labels)), "audit-survivors"))
