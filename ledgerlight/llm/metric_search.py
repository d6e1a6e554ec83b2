"""Exact top-k search by inner product in an M-tree.

Inner products become distances by one more coordinate: a row x gets sqrt(M - |x|^2), where M is the largest squared
norm, a query gets zero, and then |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest rows are those with the largest scores.

The rows are cut into metric cells around a bounded sample of pivots, and a cell into shards of bounded size, so that
equal or crowded rows never make a large one.  A task builds the M-tree of a shard: pages of at most PAGE entries; an
entry of an inner page holds a routing row, its distance to the routing row of the page, and the covering radius of the
page below; an entry of a leaf holds a row and its distance to the page's routing row.  Shards are a table.

Queries are cut into blocks of neighbours.  A block first visits the shards of its own cell; its k best so far bound
the distance, and only cells whose ball can hold something nearer are visited after that.  Within a tree the search is
best-first for the queries of a block together: pages wait in a heap, with the queries that may need them, by the least
distance that their ball allows; an entry is skipped without computing a distance when |d(q, parent) - d(entry, parent)|
minus its radius is already too far.  Bounds carry a slack beyond the
rounding of doubles; scores are exact integers.  Nothing is approximate, so recall is 1 by construction.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
never meet, empty ones score zero among themselves; a row without vec_id is a candidate, never a query, and is last among
ties; repeated rows are rows of their own, and a query leaves out its own row only; components and scores beyond BIGINT
count as its bounds; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import written

TOP = 5
PAGE = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 512
# Pivots are taken from a sample of so many rows of a length; so many cells at most.
SAMPLE = 2048
CELLS = 256
LONGEST = (1 << 63) - 1
NO_ID = np.iinfo(np.int64).max
# No score: the k best are not known yet.
NOTHING = np.iinfo(np.int64).min


def whole(column: Column) -> Column:
    """floor(256 x) of every component; null for a vector that takes no part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # The cast of a double beyond BIGINT gives its bound outside of ANSI mode; the comparison does it in both.
    step = lambda x: F.when(256 * x >= float(LONGEST), F.lit(LONGEST)).when(256 * x <= -float(LONGEST), F.lit(-LONGEST)).otherwise(F.floor(256 * x))
    return F.when(~bad, F.transform(column, step))


def scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of every query and row; *exact*: doubles hold every partial sum."""
    if exact:
        return np.rint(queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    found = queries.astype(object) @ rows.astype(object).T if queries.shape[1] else np.zeros((len(queries), len(rows)), object)
    return np.clip(found, -LONGEST, LONGEST).astype(np.int64)


class Space:
    """The metric of the rows of one length."""

    def __init__(self, largest: float, size: int, widest: float):
        self.largest, self.size = largest, size
        self.exact = widest * widest * max(size, 1) < 2 ** 53
        self.slack = 1e-6 * (1 + np.sqrt(largest))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        plain = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", plain, plain), 0))
        return np.column_stack([plain, rest])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors.astype(np.float64), np.zeros(len(vectors))])

    def reach(self, base: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """The distances beyond which rows score below *worst*; *base* is a query's squared norm and the largest of the rows."""
        return np.where(worst == NOTHING, np.inf, np.sqrt(np.maximum(base - 2.0 * worst, 0)) + self.slack)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From every row of a to every row of b; the rounding is far below a space's slack."""
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class MTree:
    """Pages of metric entries over the rows of a shard, in arrays.

    Page p has entries first[p]:first[p + 1]; child[e] is the page below an entry, -1 in a leaf; entry e stands for
    row item[e], lies parent[e] away from the routing row of its page and covers everything within radius[e].
    """

    FIELDS = ("first", "item", "child", "parent", "radius", "router")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 7) -> MTree:
        """Bulk load from the top: rows go to the nearest of a sample of them, until they fit a page."""
        random = np.random.Generator(np.random.PCG64(seed))
        pages: list[list[tuple[int, int, float, float]]] = []
        router: list[int] = []

        def page(rows: np.ndarray, centre: int) -> int:
            number = len(pages)
            pages.append([])
            router.append(centre)
            away = distances(points[rows], points[[centre]])[:, 0]
            if len(rows) <= PAGE:
                pages[number] = [(int(r), -1, float(d), 0.0) for r, d in zip(rows, away)]
                return number
            seeds = random.choice(rows, min(PAGE, -(-len(rows) // (PAGE // 2))), replace=False)
            near = distances(points[rows], points[seeds]).argmin(axis=1)
            if np.bincount(near).max() > max(PAGE, 0.9 * len(rows)):
                # Rows that do not part (copies of one another) are dealt evenly.
                near = np.arange(len(rows)) % len(seeds)
            entries = []
            for k in np.unique(near):
                own = rows[near == k]
                radius = float(distances(points[own], points[[seeds[k]]]).max())
                entries.append((int(seeds[k]), page(own, int(seeds[k])), float(distances(points[[seeds[k]]], points[[centre]])[0, 0]), radius))
            pages[number] = entries
            return number

        if len(points):
            page(np.arange(len(points)), 0)
        flat = [e for p in pages for e in p]
        return cls(first=np.cumsum([0, *map(len, pages)]).astype(np.int32), item=np.array([e[0] for e in flat], np.int32), child=np.array([e[1] for e in flat], np.int32),
                   parent=np.array([e[2] for e in flat]), radius=np.array([e[3] for e in flat]), router=np.array(router, np.int32))

    def pack(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name in self.FIELDS]

    @classmethod
    def unpack(cls, raw: list[bytes]) -> MTree:
        kinds = (np.int32, np.int32, np.int32, np.float64, np.float64, np.int32)
        return cls(**{name: np.frombuffer(data, kind) for name, data, kind in zip(cls.FIELDS, raw, kinds)})


class Shard:
    """A tree with its rows, ready for searches."""

    def __init__(self, tree: MTree, vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray, space: Space):
        self.tree, self.space, self.ids, self.numbers = tree, space, ids, numbers
        self.vectors, self.points = vectors, space.rows(vectors)
        # Entries of a page are read together, so their rows lie together.
        self.entry_points, self.entry_rows = self.points[tree.item], vectors[tree.item]
        self.computed = 0

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, worst: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For every query of a block the k best rows as (-score, id, row number).

        *own* rows are left out, and so may be rows that score below *worst* (NOTHING where no bound is known).  A page
        waits in the heap with those queries that may need it and leaves it by the least of their distances.
        """
        found: list[list[tuple[int, int, int]]] = [[] for _ in queries]
        if not len(self.tree.router) or not len(queries):
            return found
        space, tree, worst = self.space, self.tree, worst.copy()
        points = space.queries(queries)
        base = np.einsum("ij,ij->i", points, points) + space.largest
        limit, everyone = space.reach(base, worst), np.arange(len(queries))
        heap = [(0.0, 0, everyone, np.zeros(len(queries)), distances(points, self.points[tree.router[:1]])[:, 0])]
        while heap:
            _, number, active, least, to_router = heapq.heappop(heap)
            open_ = least <= limit[active]
            active, to_router = active[open_], to_router[open_]
            low, high = tree.first[number], tree.first[number + 1]
            # Stored distances first: what they rule out for all queries is never computed.
            may = np.abs(to_router[:, None] - tree.parent[low:high]) - tree.radius[low:high] <= limit[active][:, None]
            entries, rows = np.flatnonzero(may.any(axis=0)), np.flatnonzero(may.any(axis=1))
            if not len(entries):
                continue
            active, at = active[rows], entries + low
            self.computed += len(active) * len(at)
            if tree.child[low] < 0:
                value = scores(queries[active], self.entry_rows[at], space.exact)
                better = value >= worst[active][:, None]
                for row in np.flatnonzero(better.any(axis=1)).tolist():
                    q = active[row]
                    mine = np.flatnonzero(better[row])
                    items = tree.item[at[mine]]
                    some = [(-int(s), int(i), int(n)) for s, i, n in zip(value[row][mine], self.ids[items], self.numbers[items]) if n != own[q]]
                    found[q] = sorted(found[q] + some)[:k]
                    if len(found[q]) == k:
                        worst[q] = max(worst[q], -found[q][-1][0])
                limit[active] = space.reach(base[active], worst[active])
            else:
                away = distances(points[active], self.entry_points[at])
                floor = np.maximum(away - tree.radius[at], 0)
                near = floor <= limit[active][:, None]
                for j in np.flatnonzero(near.any(axis=0)).tolist():
                    keep = near[:, j]
                    heapq.heappush(heap, (float(floor[keep, j].min()), int(tree.child[at[j]]), active[keep], floor[keep, j], away[keep, j]))
        return found


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), size)


def celled(rows: DataFrame, spaces: dict[int, Space], pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows with the nearest pivot and the distance to it; the query side of a row has a distance of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["size"])
            for size in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == size))
                vectors = matrix(some["vector"], size)
                away = distances(spaces[size].rows(vectors), pivots[size])
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*[some[c] for c in ("number", "vec_id", "size", "vector")], pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])],
                                                 ["number", "vec_id", "size", "vector", "cell", "away"])

    return rows.select("number", "vec_id", "size", "vector").mapInArrow(run, "number bigint, vec_id bigint, size int, vector array<bigint>, cell int, away double")


def trees(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """One row a shard: its pages and its rows."""

    def run(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        vectors = matrix(table["vector"].combine_chunks(), size)
        tree = MTree.build(spaces[size].rows(vectors))
        ids = np.asarray(table["vec_id"].fill_null(NO_ID))
        return pa.table([table["size"][:1], table["cell"][:1], table["shard"][:1], pa.array([tree.pack()], pa.list_(pa.binary())), pa.array([vectors.astype(np.int64).tobytes()]),
                         pa.array([ids.tobytes()]), pa.array([np.asarray(table["number"]).tobytes()])], ["size", "cell", "shard", "pages", "vectors", "ids", "numbers"])

    return rows.groupBy("size", "cell", "shard").applyInArrow(run, "size int, cell int, shard int, pages array<binary>, vectors binary, ids binary, numbers binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    """One row a block of queries of one cell."""

    def run(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        vectors = matrix(table["vector"].combine_chunks(), size)
        return pa.table([table["size"][:1], table["cell"][:1], table["block"][:1], pa.array([vectors.astype(np.int64).tobytes()]), pa.array([np.asarray(table["vec_id"]).tobytes()]),
                         pa.array([np.asarray(table["number"]).tobytes()])], ["size", "cell", "block", "asked", "query_ids", "query_numbers"])

    return queries.groupBy("size", "cell", "block").applyInArrow(run, "size int, cell int, block int, asked binary, query_ids binary, query_numbers binary")


FOUND = "query_number bigint, query_id bigint, score bigint, vec_id bigint, number bigint"


def searched(pairs: DataFrame, spaces: dict[int, Space], k: int) -> DataFrame:
    """The k best rows of a shard for every query of a block, for pairs of a block and a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda name: batch[name][row].as_py()  # noqa: E731, B023
                size = get("size")
                longs = lambda name: np.frombuffer(get(name), np.int64)  # noqa: E731, B023
                shard = Shard(MTree.unpack(get("pages")), longs("vectors").reshape(-1, size) if size else np.zeros((len(longs("ids")), 0), np.int64), longs("ids"), longs("numbers"), spaces[size])
                ids, numbers = longs("query_ids"), longs("query_numbers")
                asked = longs("asked").reshape(-1, size) if size else np.zeros((len(ids), 0), np.int64)
                bounds = np.array([NOTHING if x is None else x for x in get("bounds") or [None] * len(ids)], dtype=np.int64)
                out = [(numbers[i], ids[i], -s, v, n) for i, found in enumerate(shard.best(asked, numbers, k, bounds)) for s, v, n in found]
                columns = [pa.array(np.array([x[c] for x in out], dtype=np.int64)) for c in range(5)]
                yield pa.RecordBatch.from_arrays(columns, ["query_number", "query_id", "score", "vec_id", "number"])

    return pairs.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner products for every row where *is_query* holds."""
    rows = vectors.select("vec_id", whole(F.col("embedding").cast("array<double>")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = written(rows.where("vector is not null").select(F.monotonically_increasing_id().alias("number"), "vec_id", "asked", F.size("vector").alias("size"), "vector"), "metric-rows")
    double = F.transform("vector", lambda x: x.cast("double"))
    norm = F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x)
    widest = F.aggregate(double, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    known = rows.groupBy("size").agg(F.count("*").alias("n"), F.max(norm).alias("largest"), F.max(widest).alias("widest"), F.count_if("asked").alias("queries")).collect()
    spaces = {r["size"]: Space(r["largest"], r["size"], r["widest"]) for r in known}
    pivots = {r["size"]: chosen(rows.where(F.col("size") == r["size"]), r["n"], spaces[r["size"]]) for r in known}
    cells = written(celled(rows, spaces, pivots), "metric-cells")
    balls = {(r["size"], r["cell"]): (r["away"], r["n"]) for r in cells.groupBy("size", "cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect()}
    # How many shards a cell is cut into; at most CELLS cells a length.
    code = F.col("size") * CELLS + F.col("cell")
    parts = lookup({s * CELLS + c: -(-n // SHARD_ROWS) for (s, c), (_, n) in balls.items()}, code)
    forest = written(trees(cells.withColumn("shard", F.pmod(F.xxhash64("number"), parts).cast("int")), spaces), "metric-trees")
    asked = cells.join(rows.where("asked").select("number"), "number", "left_semi")
    many = asked.groupBy("size", "cell").agg(F.count("*").alias("n")).collect()
    cuts = lookup({r["size"] * CELLS + r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in many}, code)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("number"), cuts).cast("int"))
    blocks = written(query_blocks(asked), "metric-blocks")
    # A block meets every shard of a cell; rows are dealt by shard, where a tree is one row and Spark can split its blocks.
    met = lambda rows: rows.withColumn("shard", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).join(forest, ["size", "cell", "shard"])
    # First the shards of the block's own cell ...
    home = blocks.withColumn("bounds", F.lit(None).cast("array<bigint>"))
    first = written(searched(met(home), spaces, k), "metric-home")
    # ... then those of every cell that may hold something nearer than the k best of them.
    worst = best_of(first, k).where(F.col("rank") == k).select(F.col("query_number").alias("number"), F.col("score").alias("worst"))
    bounds = asked.join(worst, "number", "left").groupBy("size", "cell", "block").agg(F.map_from_entries(F.collect_list(F.struct("number", "worst"))).alias("known"))
    visits = written(visiting(blocks.join(bounds, ["size", "cell", "block"]), spaces, pivots, balls), "metric-visits")
    second = written(searched(met(visits), spaces, k), "metric-away")
    ranked = best_of(first.union(second), k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def lookup(values: dict[int, int], code: Column) -> Column:
    """The value of a code, from a bounded table; 1 where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[code], F.lit(1)) if values else F.lit(1)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    order = Window.partitionBy("query_number").orderBy(F.desc("score"), "vec_id", "number")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def chosen(rows: DataFrame, n: int, space: Space) -> np.ndarray:
    """Pivots of the cells of one length: some rows of a sample of at most SAMPLE."""
    sample = rows.orderBy(F.xxhash64("number"), "number").limit(SAMPLE).select("vector").collect()
    points = space.rows(np.array([r["vector"] for r in sample], dtype=np.int64).reshape(len(sample), space.size))
    count = max(1, min(CELLS, len(points), round(n / SHARD_ROWS * 2)))
    random = np.random.Generator(np.random.PCG64(11))
    return points[random.choice(len(points), count, replace=False)] if count > 1 else points[:1]


def visiting(blocks: DataFrame, spaces: dict[int, Space], pivots: dict[int, np.ndarray], balls: dict) -> DataFrame:
    """Each block once for every other cell whose ball can hold a row that one of its queries needs."""
    fields = "size int, block int, asked binary, query_ids binary, query_numbers binary, cell int, bounds array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, own = row["size"], row["cell"]
                space, numbers = spaces[size], np.frombuffer(row["query_numbers"], np.int64)
                ids = np.frombuffer(row["query_ids"], np.int64)
                asked = np.frombuffer(row["asked"], np.int64).reshape(-1, size) if size else np.zeros((len(ids), 0), np.int64)
                points = space.queries(asked)
                known = dict(row["known"])
                bounds = [known[n] for n in numbers.tolist()]
                base = np.einsum("ij,ij->i", points, points) + space.largest
                reach = space.reach(base, np.array([NOTHING if x is None else x for x in bounds], dtype=np.int64))
                away = distances(points, pivots[size])
                for (_, cell), (radius, _n) in sorted(x for x in balls.items() if x[0][0] == size and x[0][1] != own):
                    need = np.flatnonzero(away[:, cell] - radius - space.slack <= reach)
                    if len(need):
                        yield pa.RecordBatch.from_pylist([{"size": size, "block": own * (1 << 22) + row["block"], "asked": asked[need].tobytes(), "query_ids": ids[need].tobytes(), "query_numbers": numbers[need].tobytes(),
                                                           "cell": cell, "bounds": [bounds[i] for i in need]}],
                                                         pa.schema([("size", pa.int32()), ("block", pa.int32()), ("asked", pa.binary()), ("query_ids", pa.binary()), ("query_numbers", pa.binary()), ("cell", pa.int32()),
                                                                    ("bounds", pa.list_(pa.int64()))]))

    return blocks.mapInArrow(run, fields)
