"""Near-duplicate vectors by collision-counting projections.

Every vector is projected on many random directions.  A list is the vectors sorted by one direction, inside cells of a
few other directions that are cut into wide intervals, so that lists stay short as the table grows.  Around each vector
of a list lies a window; vectors in it collide with it.  A pair's collisions are counted over all lists; pairs that reach
the threshold are verified by the exact cosine in double precision.

Window, interval and threshold follow from the wanted recall: for a pair at the linking cosine the difference on any
direction is normal with a known spread, which gives the chance of a collision in one list, and the number of lists is
raised until the chance to reach the threshold is the recall.  The number of cell directions grows with the logarithm of
the table's size.

Since a cell's vectors carry all their lists' keys, a pair's collisions are counted where it first meets: only the first
list in which it collides verifies it, so no pair is shuffled, and what a task returns are link counts and, for the
components, one link for each vector to the root of its tree in the task.  Cells of many vectors are cut into blocks; every pair of
blocks is a group of its own, so no group exceeds two blocks.  Equal vectors are one row with a multiplicity.

Defined cases: null or empty vectors, those with a null or non-finite component, and zero vectors link with nothing, not
even with their copies; repeated rows (also with one vec_id) are vectors of their own; vectors of different lengths never
link, each length has a plan, lists and groups of its own; a null vec_id takes part but names no component; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import components
from ledgerlight.session import written

COSINE = 0.95
RECALL = 0.99
INTERVAL = 2.4
WINDOW = 0.6
THRESHOLD = 2
BLOCK = 2048
GROUP_ROWS = 16_384
SEED = 20_240_117


@dataclass(frozen=True)
class Plan:
    """Directions and widths of the lists."""

    size: int
    cells: int
    lists: int
    threshold: int

    @classmethod
    def of(cls, rows: int, size: int, cosine: float = COSINE, recall: float = RECALL, threshold: int = THRESHOLD) -> Plan:
        cells = max(1, round(math.log2(max(rows, 2)) * 0.6))
        spread = math.sqrt(2 - 2 * cosine)
        one = (1 - spread * math.sqrt(2 / math.pi) / INTERVAL) ** cells * math.erf(WINDOW / spread / math.sqrt(2))
        lists = threshold
        while sum(math.comb(lists, k) * one ** k * (1 - one) ** (lists - k) for k in range(threshold)) > 1 - recall:
            lists += 1
        return cls(size, cells, lists, threshold)

    def keys(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (a hash) and place on the sorted direction, for every vector and list."""
        random = np.random.Generator(np.random.PCG64(SEED))
        directions = random.standard_normal((self.lists * (self.cells + 1), self.size))
        offsets = random.uniform(0, INTERVAL, (self.lists, self.cells))
        factors = random.integers(1, 1 << 62, (self.lists, self.cells), dtype=np.int64) * 2 + 1
        places = (units @ directions.T).reshape(len(units), self.lists, self.cells + 1)
        steps = np.floor((places[:, :, 1:] + offsets) / INTERVAL).astype(np.int64)
        cell = (steps * factors).sum(axis=2)
        return cell ^ (cell >> 29) * 0x2545F4914F6CDD1D, places[:, :, 0]


def unit_rows(vectors: pa.Array, size: int) -> np.ndarray:
    raw = np.asarray(vectors.flatten().cast(pa.float64())).reshape(-1, size)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def listed(distinct: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(size, list, cell, node) of every vector in every list of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                some = batch.slice(low, 4096)
                sizes = np.asarray(some["size"])
                for size in np.unique(sizes).tolist():
                    part, plan = some.filter(pa.array(sizes == size)), plans[size]
                    cell, _ = plan.keys(unit_rows(part["vector"], size))
                    number = np.tile(np.arange(plan.lists, dtype=np.int32), len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), size, np.int32)), pa.array(number), pa.array(cell.ravel()), pa.array(np.repeat(np.asarray(part["node"]), plan.lists))],
                                                     ["size", "list", "cell", "node"])

    return distinct.select("size", "node", "vector").mapInArrow(run, "size int, list int, cell bigint, node bigint")


def block_pairs(left: np.ndarray, right: np.ndarray | None, number: int, units, cells, places, plan: Plan, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of two blocks of a cell (or of one with itself) whose first collision is in list *number*."""
    other = left if right is None else right
    order = np.argsort(places[other, number])
    sorted_places = places[other[order], number]
    first = np.searchsorted(sorted_places, places[left, number] - WINDOW, side="left")
    last = np.searchsorted(sorted_places, places[left, number] + WINDOW, side="right")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    rows = max(1, (1 << 20) // max(1, len(other)))
    for low in range(0, len(left), rows):
        many = last[low:low + rows] - first[low:low + rows]
        total = int(many.sum())
        a = np.repeat(left[low:low + rows], many)
        b = other[order[np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[low:low + rows], many)]]
        if right is None:
            keep = a < b
            a, b = a[keep], b[keep]
        collisions = np.ones(len(a), dtype=np.int16)
        for n in range(plan.lists):
            if n == number or not len(a):
                continue
            meets = (cells[a, n] == cells[b, n]) & (np.abs(places[a, n] - places[b, n]) <= WINDOW)
            if n < number:
                a, b, collisions = a[~meets], b[~meets], collisions[~meets]
            else:
                collisions += meets
        enough = collisions >= plan.threshold
        a, b = a[enough], b[enough]
        close = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
        found.append((a[close], b[close]))
    return tuple(np.concatenate(x) for x in zip(*found))


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of the linked x and y; a label is the smallest member of a tree."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def linked(rows: DataFrame, plans: dict[int, Plan], cosine: float) -> DataFrame:
    """(node, links, tree): partial link counts, weighted by multiplicity, and the smallest node of its tree, from groups of cells of one length."""

    def run(table: pa.Table) -> pa.Table:
        plan = plans[table["size"][0].as_py()]
        node, times = np.asarray(table["node"]), np.asarray(table["times"])
        # Each vector once, however many cells of the group it is in.
        every, at = np.unique(node, return_index=True)
        vectors = table["vector"].take(pa.array(at)).combine_chunks()
        units = unit_rows(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors, plan.size)
        copies = times[at]
        cells, places = plan.keys(units)
        row = np.searchsorted(every, node)
        number, low, high, own = (np.asarray(table[c]) for c in ("list", "low", "high", "own"))
        cell = np.asarray(table["cell"])
        order = np.lexsort((own, high, low, cell, number))
        change = np.ones(len(order), dtype=bool)
        for column in (number, cell, low, high):
            change[1:] &= column[order][1:] == column[order][:-1]
        starts = np.flatnonzero(~change | (np.arange(len(order)) == 0))
        links, tree = np.zeros(len(every), np.int64), np.arange(len(every))
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            part = order[a:b]
            if low[part[0]] == high[part[0]]:
                x, y = block_pairs(row[part], None, number[part[0]], units, cells, places, plan, cosine)
            else:
                mine = own[part] == low[part]
                x, y = block_pairs(row[part[mine]], row[part[~mine]], number[part[0]], units, cells, places, plan, cosine)
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            unite(tree, x, y)
        touched = links > 0
        return pa.table([pa.array(every[touched]), pa.array(links[touched]), pa.array(every[tree[touched]])], ["node", "links", "tree"])

    return rows.groupBy("size", "group").applyInArrow(run, "node bigint, links bigint, tree bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    length = F.size("vector")
    sound = F.col("vector").isNotNull() & (length > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # A vector's node is a hash of its components; the hashes of different vectors are taken as different.
    rows = written(rows.withColumn("node", F.when(F.col("sound"), F.xxhash64("vector"))), "vector-rows")
    distinct = written(rows.where("sound").groupBy("node").agg(F.first("vector").alias("vector"), F.first(length).alias("size"), F.count("*").alias("times"), F.min("vec_id").alias("smallest")), "vector-distinct")
    plans = {r["size"]: Plan.of(r["count"], r["size"], cosine, recall) for r in distinct.groupBy("size").count().collect()}
    lists = written(listed(distinct, plans), "vector-lists")
    cells = written(lists.groupBy("size", "list", "cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "vector-cells")
    # A vector of block i meets every block; (low, high) names the pair of blocks.
    own = F.pmod(F.xxhash64("node", "list"), F.col("blocks")).cast("int")
    met = lists.join(cells, ["size", "list", "cell"]).select("size", "list", "cell", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("size", "list", "cell", "node", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    # Rare lengths get few groups, or each of their cells would be a task's call of its own.
    groups = [F.lit(x) for r in lists.groupBy("size").count().collect() for x in (r["size"], -(-r["count"] // GROUP_ROWS))]
    met = met.withColumn("group", F.pmod(F.xxhash64("list", "cell", "low", "high"), F.create_map(*groups)[F.col("size")] if groups else F.lit(1)))
    found = written(linked(met.join(distinct.select("node", "vector", "times"), "node"), plans, cosine), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.select("node", "times", F.coalesce("smallest", F.lit((1 << 63) - 1)).alias("smallest"))
    roots = components(found.where("node != tree").select("node", "tree"), "vector-components").toDF("node", "root")
    grouped = named.join(roots, "node", "left").select("node", "times", "smallest", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("smallest").alias("component"))
    nodes = grouped.join(least, "root").join(counts, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component")
    component = F.when(F.col("component") == (1 << 63) - 1, F.lit(None)).otherwise(F.coalesce("component", "vec_id"))
    out = rows.select("vec_id", "node").join(nodes, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
