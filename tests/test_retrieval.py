import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import retrieval as R

TEXTS = ["", "short", "word " * 900, "para one\n\n" * 300, "x" * 3500, "a\nb " * 700 + "y" * 1000, "é" * 999 + " " + "z" * 1000]


@pytest.mark.parametrize("text", TEXTS)
def test_chunks_are_bounded_and_complete(text):
    chunks = R.split_text(text)
    assert all(0 < len(c) <= R.CHUNK_SIZE and c == c.strip() for c in chunks)
    kept = set("".join(chunks)) - set(" \n")
    assert kept == set(text) - set(" \n")
    words = text.split()
    if all(len(w) < R.CHUNK_SIZE for w in words):
        joined = " ".join(chunks)
        assert all(w in joined for w in words)


def test_overlap_carries_words_over():
    chunks = R.split_text(" ".join(f"w{i:04d}" for i in range(600)))
    assert len(chunks) > 1
    assert all(set(a.split()[-20:]) & set(b.split()[:40]) for a, b in zip(chunks, chunks[1:]))


def test_exact_size_counts_as_too_big():
    assert R.split_text("a" * 1000) == ["a" * 1000]
    assert R.split_text("b " + "a" * 1000) == ["b", "a" * 1000]


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5), rows


def brute(rows, queries, k, floor=-1.0):
    vectors = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    out = set()
    for q in queries:
        scores = np.round(vectors @ vectors[q], 9)
        best = sorted((-s, i) for i, s in enumerate(scores) if s >= floor)[:k]
        out |= {(q, i) for _, i in best}
    return out


def test_topk_both_paths_equal_brute_force(spark, space, monkeypatch):
    frame, rows = space
    queries = frame.where("vec_id < 12").select(F.col("vec_id").alias("query_id"), "embedding")
    expected = brute(rows, range(12), 5, 0.1)
    near = {(r.query_id, r.vec_id) for r in R.vector_topk(frame, queries, 5, 0.1).collect()}
    monkeypatch.setattr(R, "MAX_QUERY_BLOCK", 5)
    monkeypatch.setattr(R, "ROWS_PER_CELL", 70)
    grid = {(r.query_id, r.vec_id) for r in R.vector_topk(frame, queries, 5, 0.1).collect()}
    assert near == grid == expected


def test_nearest_anchor_both_paths(space, monkeypatch):
    frame, _ = space
    anchors = frame.where("vec_id < 9").select(F.col("vec_id").alias("anchor_id"), "embedding")
    one = {(r.vec_id, r.anchor_id) for r in R.nearest_anchor(frame, anchors, 0.2).collect()}
    monkeypatch.setattr(R, "MAX_QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "ROWS_PER_CELL", 3)
    assert one == {(r.vec_id, r.anchor_id) for r in R.nearest_anchor(frame, anchors, 0.2).collect()} and one


def test_reranked_positions_out_of_range_are_ignored(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, vec_id bigint, rank int")
    ranked = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.5), (1, 7, 0.4)], "query_id bigint, index int, relevance double")
    got = R.rerank_pick(hits, ranked).orderBy(F.desc("relevance")).collect()
    assert [r.vec_id for r in got] == [11, 10]


def test_user_sketches_merge_days_into_months(spark):
    from ledgerlight.operators import audience as A
    import datetime as dt
    rows = spark.range(20_000).select(
        F.lit("t").alias("tag"), F.concat(F.lit("u"), (F.col("id") % 700).cast("string")).alias("user_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 28) * 86400).cast("timestamp_ntz").alias("start_time"))
    as_of = dt.date(2024, 1, 30)
    exact = {r.bucket: r.active_users for r in A.active_users(rows, as_of, 30).collect()}
    near = {r.bucket: r.active_users for r in A.active_users_from_sketches(A.active_user_sketches(rows), as_of, 30).collect()}
    assert exact.keys() == near.keys() and all(abs(near[b] - exact[b]) <= 0.05 * exact[b] for b in exact)
