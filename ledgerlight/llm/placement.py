"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, (offset + i * skip) mod size.
The shards take turns; each claims the first slot of its order that is still free, until the table is full.  So
every shard holds the same number of slots (one more or less), and taking a shard away moves little but its own
slots.  A document's slot is a hash of its id; the table, whose size is a parameter and not a matter of the data,
is one literal array of the plan, so placement costs one array access a row, without shuffle.

Defined cases: a null id is placed like an empty text; repeated ids go to the same shard; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

SHARDS = 64
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot."""
    if not is_prime(slots) or not 0 < len(names) <= slots or len(set(names)) != len(names):
        raise ValueError("the number of slots has to be a prime not below the number of shards, and names differ")
    seeds = [hashlib.md5(name.encode()).digest() for name in names]
    offsets = [int.from_bytes(s[:8], "big") % slots for s in seeds]
    skips = [int.from_bytes(s[8:], "big") % (slots - 1) + 1 for s in seeds]
    owner = np.full(slots, -1, dtype=np.int32)
    at, left = list(offsets), slots
    while True:
        for shard, skip in enumerate(skips):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + skip) % slots
            owner[slot] = shard
            at[shard] = (slot + skip) % slots
            left -= 1
            if not left:
                return owner


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    """The slot of an id: the first 60 bits of the MD5 of its decimal text, modulo the table's size."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """(slot, shard, row): the last holds the columns of the input row."""
    owner = lookup_table(names or [f"shard-{i:05d}" for i in range(SHARDS)], slots)
    table = F.from_json(F.lit(str(owner.tolist())), ArrayType(IntegerType()))
    slot = slot_of(F.col("doc_id"), slots)
    return docs.select(slot.alias("slot"), F.get(table, slot).alias("shard"), F.struct("*").alias("row"))


def placement_report(docs: DataFrame) -> DataFrame:
    return place(docs.select("doc_id")).select("row.doc_id", "slot", "shard")
