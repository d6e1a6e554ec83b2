"""Queries on chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import retrieval as R
from ledgerlight.plans.oracle_views import add_view
from ledgerlight.plans.registry import query
from ledgerlight.sources.adapters import Tables

# One query vector per label: the label's vector with the smallest id.
add_view("query_vectors", """
    SELECT label::BIGINT AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY 1""")
add_view("vector_hits", """
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, query_vectors)""")


def query_vectors(t: Tables):
    return t.vectors().groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding"))


def anchors(t: Tables):
    return query_vectors(t).withColumnRenamed("query_id", "anchor_id")


@query("chunk_documents")
def chunk_documents(t: Tables):
    return R.chunk_documents(t.documents(), "doc_id", "text")


@query("chunk_fixed", r"""
SELECT doc_id, chunk_no, chunk FROM (SELECT doc_id, (s // 800)::INT AS chunk_no,
  regexp_replace(substr(text, s + 1, 1000), '^\s+|\s+$', '', 'g') AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 201) + 1, 800)) AS s FROM documents)) WHERE chunk <> ''""")
def chunk_fixed(t: Tables):
    return R.chunk_fixed(t.documents(), "doc_id", "text")


@query("chunk_stats", r"""
SELECT n AS chunks_per_document, count(*)::BIGINT AS documents, sum(total)::BIGINT AS characters, max(longest)::INT AS longest,
       min(shortest)::INT AS shortest
FROM (SELECT doc_id, count(*)::BIGINT AS n, sum(length(chunk)) AS total, max(length(chunk)) AS longest, min(length(chunk)) AS shortest
 FROM (SELECT doc_id, regexp_replace(substr(text, s + 1, 1000), '^\s+|\s+$', '', 'g') AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 201) + 1, 800)) AS s FROM documents)) WHERE chunk <> '' GROUP BY 1)
GROUP BY 1""")
def chunk_stats(t: Tables):
    return R.chunk_stats(R.chunk_fixed(t.documents(), "doc_id", "text"), "doc_id")


@query("vector_topk", "SELECT * FROM vector_hits WHERE rank <= 10")
def vector_topk(t: Tables):
    return R.vector_topk(t.vectors(), query_vectors(t), 10)


@query("rerank_pick", """
SELECT query_id, vec_id, (rank - 1)::INT AS index, 1.0::DOUBLE / rank AS relevance FROM vector_hits WHERE rank <= 10 AND rank % 2 = 0""")
def rerank_pick(t: Tables):
    """A reranker that keeps every other hit and also names positions that do not exist."""
    hits = R.vector_topk(t.vectors(), query_vectors(t), 10)
    positions = hits.select("query_id", F.explode(F.array(F.col("rank") * 2 - 1, F.col("rank") + 100)).alias("index")).select(
        "query_id", "index", (F.lit(1.0) / (F.col("index") + 1)).alias("relevance"))
    return R.rerank_pick(hits, positions)


PREFIX = "Use this context:\n\n"


@query("context_build", """
SELECT query_id, 'Use this context:' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10)
  AS context FROM vector_hits JOIN documents ON doc_id = vec_id WHERE rank <= 5 GROUP BY 1""")
def context_build(t: Tables):
    hits = R.vector_topk(t.vectors(), query_vectors(t), 5)
    return R.context_build(hits, t.documents().select(F.col("doc_id").alias("vec_id"), "text"), PREFIX)


@query("semantic_tool_select", """
SELECT q.query_id, vec_id, score, vec_id IS NULL AS keep_all FROM query_vectors q LEFT JOIN (
  SELECT query_id, vec_id, -score AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM vector_hits WHERE -score >= 0.3) WHERE r <= 3) h
  ON q.query_id = h.query_id""")
def semantic_tool_select(t: Tables):
    """Requests pointing away from every label, so that some find no tool and keep them all."""
    queries = query_vectors(t).withColumn("embedding", F.transform("embedding", lambda x: -x))
    return R.semantic_tool_select(t.vectors(), queries, 3, 0.3)


NEAREST_SQL = """
SELECT vec_id, arg_max(query_id, (score, -query_id)) AS anchor_id, max(score) AS score FROM vector_hits GROUP BY 1"""


@query("semantic_cache_hit", f"""
SELECT vec_id, anchor_id, score, 1.0::DOUBLE - score AS vector_distance FROM ({NEAREST_SQL}) WHERE score >= 0.2""")
def semantic_cache_hit(t: Tables):
    return R.semantic_cache_hits(t.vectors(), anchors(t), 0.2)


@query("semantic_route", f"""
SELECT anchor_id AS route, count(*)::BIGINT AS texts, round(min(score), 9) AS weakest FROM ({NEAREST_SQL}) WHERE score >= 0.1 GROUP BY 1""")
def semantic_route(t: Tables):
    routed = R.nearest_anchor(t.vectors(), anchors(t), 0.1)
    return routed.groupBy(F.col("anchor_id").alias("route")).agg(F.count(F.lit(1)).alias("texts"), F.min("score").alias("weakest"))
