"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

A fingerprint bit is set if it is set in more than half of the hashes of a document's word shingles.  Two
fingerprints link if they differ in few bits (three by default).

Links are found without comparing all pairs.  Of three disjoint blocks of 21 bits one can be set aside so that the
other 43 bits differ in at most two places.  For each choice, every distinct fingerprint emits all variants of the
kept bits within half that radius: itself and its 43 one-bit neighbours.  Variants are shuffled; two fingerprints
meet at a variant in the middle between them, once for each choice (the join keeps one of the possible middles), and
the full distance is verified in the join.  No side of it ever goes through the driver.  Copies are one fingerprint, so a group of any size costs one row, and a
fingerprint has no more than C(64,1)+C(64,2)+C(64,3) neighbours, whatever the table holds.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a
shingle are one shingle; repeated rows are copies; a null doc_id gets its group's component, and none if the group
has null ids only; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import components
from ledgerlight.session import written

SHINGLE = 3
SEED = 42
DISTANCE = 3
KEPT = 43
DROPPED = 21


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    last = max(1, len(words) - shingle + 1)
    width = min(shingle, len(words))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, last, 1 << 16):
        stop = min(last, at + (1 << 16))
        hashes = [digest(joined[a:b - 1], seed) for a, b in zip(starts[at:stop], starts[at + width:stop + width])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key): the fingerprint as a signed number and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"].cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64)), batch["key"]], ["doc_id", "fp", "key"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "doc_id bigint, fp bigint, key bigint")


def ball_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(f, g) with f < g: all pairs of distinct fingerprints that differ in at most *distance* (three or fewer) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("blocks and radius hold for at most three differing bits")
    variants = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(i).alias("off"), F.lit(1 << (i - 1) if i else 0).cast("long").alias("flip"))
                         for part in range(3) for i in range(KEPT + 1)])
    ball = fps.select("fp", F.explode(variants).alias("v"))
    turned = F.col("fp")
    for part in (1, 2):
        shift = part * DROPPED
        turned = F.when(F.col("v.part") == part, F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift))).otherwise(turned)
    key = turned.bitwiseAND(F.lit((1 << KEPT) - 1)).bitwiseXOR(F.col("v.flip")) + F.shiftleft(F.col("v.part").cast("long"), KEPT)
    ball = ball.select(key.alias("key"), F.col("v.off").cast("tinyint").alias("off"), "fp")
    # Spark sizes the ball as the fingerprints it is exploded from and would broadcast 132 times as many rows; sorted, both sides are one shuffle.
    left, right = (ball.toDF("key", f"{side}_off", side).hint("merge") for side in "fg")
    met = left.join(right, (left["key"] == right["key"]) & (F.col("f") < F.col("g"))
                    & ((F.col("f_off") == 0) | (F.col("f_off") < F.col("g_off")))
                    & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= distance))
    return met.select("f", "g").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, key, root, component_id), one row per input row; root is the smallest fingerprint of the group."""
    marked = written(fingerprints(docs), "simhash-fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(ball_links(distinct.select("fp")), "simhash-links").toDF("fp", "root")
    grouped = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(grouped.select("fp", "root").join(named, "root"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (then text hash), once."""
    found = near_duplicates(docs)
    choice = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("kept"))
    same = found.groupBy("doc_id", "key").agg(F.count("*").alias("times")).toDF("same_id", "same_key", "times")
    kept = choice.select(F.col("kept.doc_id").alias("id"), F.col("kept.key").alias("key")).distinct()
    kept = written(kept.join(same, F.col("id").eqNullSafe(F.col("same_id")) & (F.col("key") == F.col("same_key"))).select("id", "key", "times"), "simhash-kept")
    whole = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"), F.struct("*").alias("row"))

    def chosen(some: DataFrame) -> DataFrame:
        return whole.join(some, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))

    once = chosen(kept.where("times = 1")).select("row.*")
    # Only rows that occur several times have to meet; their table is mostly small enough to leave the texts where they are.
    again = written(kept.where("times > 1"), "simhash-kept-again")
    return once.union(chosen(again).dropDuplicates(["own_id", "own_key"]).select("row.*"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
