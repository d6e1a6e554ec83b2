"""Retrieval preparation: chunks, vector search, context."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import written

# Fixed values.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")
CONTEXT_END = "\n\n"
# Rows of the sample that trains the centroids, their number, and rows of a part of a list and of a block of queries.
TRAINING_ROWS, CENTROIDS = 4096, 64
ROWS_PER_CELL, MAX_QUERY_BLOCK = 8192, 1024
# Beyond the rounding of angles, and the ninth decimal of scores.
SLACK = 1e-7


# ---- chunks ----------------------------------------------------------------
def _filled(starts: np.ndarray, ends: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of neighbouring pieces of at most *size* characters; the next span begins with about *overlap* of the last."""
    first, reached = 0, 0
    while first < len(starts):
        last = max(reached, int(np.searchsorted(ends, starts[first] + size, side="right")) - 1)
        yield int(starts[first]), int(ends[last])
        if last + 1 == len(starts):
            return
        first = max(first, min(last, int(np.searchsorted(starts, ends[last] - overlap))))
        reached = last + 1


def chunk_spans(text: str, low: int, high: int, separators: Sequence[str], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of the chunks of text[low:high]: every chunk is a stretch of the text, so only offsets are moved.

    The stretch is cut at the coarsest separator it holds; pieces of *size* or more are cut at finer ones, or into
    equal steps when there is none.
    """
    level = next((i for i, s in enumerate(separators) if not s or text.find(s, low, high) >= 0), len(separators) - 1)
    glue, finer = separators[level], separators[level + 1:]
    cuts = np.array([m.start() for m in re.compile(re.escape(glue)).finditer(text, low, high)] if glue else range(low + 1, high), dtype=np.int64)
    starts, ends = np.concatenate([[low], cuts + len(glue)]), np.concatenate([cuts, [high]])
    large = np.flatnonzero(ends - starts >= size)
    after = 0
    for piece in [*large, len(starts)]:
        yield from _filled(starts[after:piece], ends[after:piece], size, overlap)
        after = piece + 1
        if piece < len(starts):
            a, b = int(starts[piece]), int(ends[piece])
            if finer:
                yield from chunk_spans(text, a, b, finer, size, overlap)
            else:
                yield from ((i, min(i + size, b)) for i in range(a, max(a + 1, b - overlap), size - overlap))


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """The chunks of a text, stripped, without empty ones."""
    stripped = (text[a:b].strip() for a, b in chunk_spans(text, 0, len(text), separators, size, overlap))
    return [chunk for chunk in stripped if chunk]


def chunk_documents(docs: DataFrame, doc_id: str, text: str, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk; only the id and the text travel to Python."""
    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [split_text(t or "", size, overlap) for t in batch["text"]]
            lengths = [len(p) for p in pieces]
            yield pd.DataFrame({
                "doc_id": np.repeat(batch["doc_id"].to_numpy(), lengths),
                "chunk_no": [i for p in pieces for i in range(len(p))], "chunk": [c for p in pieces for c in p]})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(split, "doc_id bigint, chunk_no int, chunk string").withColumnRenamed("doc_id", doc_id)


def chunk_fixed(docs: DataFrame, doc_id: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows with overlap, entirely in the JVM."""
    column = F.col(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(column) - overlap - 1), F.lit(size - overlap))
    pieces = docs.select(doc_id, F.posexplode(F.transform(starts, lambda s: F.regexp_replace(
        F.substr(column, s + 1, F.lit(size)), r"^\s+|\s+$", ""))).alias("chunk_no", "chunk"))
    return pieces.where(F.col("chunk") != "")


def chunk_stats(chunks: DataFrame, doc_id: str) -> DataFrame:
    """Chunks per document and their size distribution."""
    size = F.length("chunk")
    per_doc = chunks.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.max(size).alias("longest"),
                                         F.min(size).alias("shortest"))
    return per_doc.groupBy(F.col("n").alias("chunks_per_document")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("total").alias("characters"), F.max("longest").alias("longest"),
        F.min("shortest").alias("shortest"))


# ---- vector search ---------------------------------------------------------
def _unit(rows: Sequence) -> np.ndarray:
    matrix = np.asarray(list(rows), dtype=np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best columns by (score, id), ties by the smaller id."""
    rounded = np.round(scores, 9)
    if len(rounded) > k:
        floor = max(floor, np.partition(rounded, -k)[-k])
    allowed = np.flatnonzero(rounded >= floor)
    order = allowed[np.lexsort((ids[allowed], -rounded[allowed]))][:k]
    return ids[order], rounded[order]


HITS = "query_id bigint, vec_id bigint, score double"
LISTS = "cell int, part int, members array<bigint>, units binary, radius double"


def centroids(vectors: DataFrame) -> np.ndarray:
    """Unit centroids of the inverted lists, by a few rounds of spherical k-means over at most TRAINING_ROWS vectors."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS).toPandas()
    if not len(sample):
        return np.zeros((0, 0))
    units = _unit(sample["embedding"])
    units = units[np.isfinite(units).all(axis=1)]
    if not len(units):
        return np.ones((1, len(sample["embedding"][0])))
    centres = units[:: max(1, len(units) // CENTROIDS)][:CENTROIDS]
    for _ in range(5):
        near = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def inverted_lists(rows: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """(cell, part, members, units, radius): the vectors nearest to each centroid, in parts of about *size* of them.

    The radius is the widest angle of a part to its centroid.  A cell with very many vectors has many parts.
    """
    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                units = _unit(batch["embedding"])
                cell = np.nan_to_num(units @ centres.T, nan=-2.0).argmax(axis=1)
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "cell": cell.astype(np.int32), "unit": list(units)})

    placed = rows.mapInPandas(assign, "id bigint, cell int, unit array<double>")
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(size))
    cut = placed.join(counts, "cell").select("id", "cell", "unit", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        units, cell = np.stack(group["unit"].to_numpy()), int(group["cell"].iloc[0])
        away = _angles(units, centres[cell:cell + 1])[:, 0]
        return pd.DataFrame({"cell": [cell], "part": [int(group["part"].iloc[0])], "members": [group["id"].to_numpy().astype(np.int64)], "units": [units.tobytes()],
                             "radius": [float(np.nanmax(away, initial=0.0))]})

    return cut.groupBy("cell", "part").applyInPandas(pack, LISTS)


def _searched(pairs: DataFrame, k: int, min_score: float) -> DataFrame:
    """Best k of a list's part for each query of a block; *floors* are scores that a query has already."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, asked, floors = np.asarray(row.members), np.asarray(row.queries), np.asarray(row.floors)
                scores = np.frombuffer(row.query_units).reshape(len(asked), -1) @ np.frombuffer(row.units).reshape(len(ids), -1).T
                found = [_best(s, ids, k, max(min_score, floor)) for s, floor in zip(scores, floors)]
                yield pd.DataFrame({"query_id": np.repeat(asked, [len(i) for i, _ in found]), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

    return pairs.mapInPandas(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0) -> DataFrame:
    """Exact k nearest vectors by cosine for every query (columns query_id, embedding).

    Inverted lists over centroids hold the vectors, and blocks over the same centroids the queries; both are cut into parts
    of bounded size.  A block first meets the list of its own centroid.  The k-th best score so far then rules out every
    list whose vectors are all at a wider angle: the angle to its centroid less its radius.  What is left is searched, so
    nothing is lost.  The plan does not depend on the number of queries or vectors.
    """
    base = vectors.select(F.col("vec_id").cast("bigint").alias("id"), "embedding")
    centres = centroids(base)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], HITS + ", rank int")
    lists = written(inverted_lists(base, centres, ROWS_PER_CELL), "vector-lists")
    asked = inverted_lists(queries.select(F.col("query_id").cast("bigint").alias("id"), "embedding"), centres, MAX_QUERY_BLOCK)
    asked = written(asked.select("cell", F.col("part").alias("block"), F.col("members").alias("queries"), F.col("units").alias("query_units")), "vector-queries")

    def visits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a block those queries that may find something in a cell."""
        for batch in batches:
            for row in batch.itertuples():
                ids = np.asarray(row.queries)
                units = np.frombuffer(row.query_units).reshape(len(ids), -1)
                known = dict(zip(row.known_ids, row.known_scores)) if row.known_ids is not None else {}
                floors = np.array([known.get(q, -np.inf) for q in ids.tolist()])
                least = np.cos(np.clip(_angles(units, centres[row.cell:row.cell + 1])[:, 0] - row.radius, 0, np.pi))
                need = ~(least + SLACK < np.maximum(floors, min_score))
                if need.any():
                    yield pd.DataFrame({"cell": [row.cell], "block": [0], "queries": [ids[need]], "query_units": [units[need].tobytes()], "floors": [floors[need]]})

    nothing = F.transform("queries", lambda q: F.lit(float("-inf")))
    home = written(_searched(asked.withColumn("floors", nothing).join(lists, "cell"), k, min_score), "vector-home")
    kth = _ranked(home, k).where(F.col("rank") == k).select("query_id", "score")
    owner = asked.select("cell", "block", F.explode("queries").alias("query_id"))
    known = owner.join(kth, "query_id").groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "score")).alias("k")).select(
        F.col("cell").alias("own"), "block", F.col("k.query_id").alias("known_ids"), F.col("k.score").alias("known_scores"))
    cells = lists.groupBy("cell").agg(F.max("radius").alias("radius"))
    others = asked.withColumnRenamed("cell", "own").join(known, ["own", "block"], "left").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(centres) - 1)))))
    others = others.where(F.col("cell") != F.col("own")).join(cells, "cell")
    wider = others.mapInPandas(visits, "cell int, block int, queries array<bigint>, query_units binary, floors array<double>")
    return _ranked(home.union(_searched(wider.join(lists, "cell"), k, min_score)), k)


def nearest_anchor(vectors: DataFrame, anchors: DataFrame, threshold: float) -> DataFrame:
    """Best anchor of every vector, where its similarity reaches the threshold: the same search with the sides exchanged."""
    hits = vector_topk(anchors.select(F.col("anchor_id").alias("vec_id"), "embedding"), vectors.select(F.col("vec_id").alias("query_id"), "embedding"), 1, threshold)
    return hits.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("anchor_id"), "score")


def semantic_tool_select(vectors: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k best tools above the threshold; a query without any keeps all tools (vec_id null)."""
    hits = vector_topk(vectors, queries, k, threshold)
    return queries.select("query_id").join(hits, "query_id", "left").select(
        "query_id", "vec_id", "score", F.col("vec_id").isNull().alias("keep_all"))


def semantic_cache_hits(vectors: DataFrame, stored: DataFrame, similarity: float) -> DataFrame:
    """Nearest stored prompt whose distance is at most 1 − similarity."""
    hits = nearest_anchor(vectors, stored, similarity)
    return hits.withColumn("vector_distance", F.lit(1.0) - F.col("score"))


# ---- after the search ------------------------------------------------------
def rerank_pick(hits: DataFrame, reranked: DataFrame) -> DataFrame:
    """Hits in reranked order: *reranked* holds (query_id, index, relevance), index counting hits from zero."""
    indexed = hits.withColumn("index", F.col("rank") - 1)
    return reranked.join(indexed, ["query_id", "index"]).select("query_id", "vec_id", "index", "relevance")


def context_build(hits: DataFrame, texts: DataFrame, prefix: str) -> DataFrame:
    """Hit texts of every query in rank order behind a prefix; at most k texts meet per query."""
    joined = hits.join(texts, "vec_id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    return joined.groupBy("query_id").agg(F.concat(
        F.lit(prefix), F.array_join(ordered, CONTEXT_END), F.lit(CONTEXT_END)).alias("context"))
