"""Top-k search, tokenizer alignment and filter audit against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import alignment, audit, metric_search, perfect_hash
from ledgerlight.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm import brute
from tests.llm.test_operators import pairs, plain, table_rows

# 11


def top_rows(rows, asks, k=5):
    """Rows (query_id, rank, vec_id, score) over whole components; a null id is last among ties."""
    whole = [None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v] for _, v in rows]
    last = lambda d: math.inf if d is None else d
    out = []
    for i, (q, _) in enumerate(rows):
        if q is None or not asks(q) or whole[i] is None:
            continue
        bounded = lambda x: max(-metric_search.LONGEST, min(metric_search.LONGEST, x))
        found = [(-bounded(sum(a * b for a, b in zip(whole[i], w))), last(d), d) for j, ((d, _), w) in enumerate(zip(rows, whole)) if j != i and w is not None and len(w) == len(whole[i])]
        found.sort(key=lambda x: x[:2])
        out += [(q, n + 1, d, -s) for n, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


SEARCH = ("query_id", "rank", "vec_id", "score")


def vectors(llm, rows):
    return llm.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, number string").repartition(3)


def test_search_odd(llm):
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(8).tolist()) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(30)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, [0.5] * 8), (None, None), (300, None), (350, [None] + [1.0] * 7), (400, [math.nan] * 8), (401, [math.inf] * 8), (450, [0.0] * 8),
             (500, []), (501, []), (550, [1.0, 2.0]), (551, [-1.0, 2.0]), (552, [1e9, 1e9]), (600, [1.0] * 3), (0, [1e15] * 5), (1, [-3e15] * 5)]
    expected = top_rows(rows, lambda d: d % 50 == 0)
    assert plain(metric_search.top_k(vectors(llm, rows), F.col("vec_id") % 50 == 0), *SEARCH) == expected
    assert metric_search.top_k(vectors(llm, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert metric_search.top_k(vectors(llm, rows), F.lit(False)).count() == 0


def test_search_scores_beyond_bigint(llm):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1.0, 1.0])]
    got = plain(metric_search.top_k(vectors(llm, rows), F.col("vec_id") == 0), *SEARCH)
    assert [r[2] for r in got] == [1, 3, 2] and got[0][3] == metric_search.LONGEST and got[2][3] == -metric_search.LONGEST


def test_search_over_many_shards_and_ties(llm, monkeypatch):
    monkeypatch.setattr(metric_search, "SHARD_ROWS", 90)
    monkeypatch.setattr(metric_search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(metric_search, "PAGE", 6)
    draw = np.random.default_rng(9)
    # A third of the rows are copies, the others lie around few centres with coarse components, so scores tie.
    centres = draw.integers(-3, 4, (12, 6))
    rows = [(i, (centres[i % 12] / 4 + draw.integers(-1, 2, 6) / 64).tolist()) for i in range(600)] + [(1000 + i, [0.25] * 6) for i in range(300)]
    expected = top_rows(rows, lambda d: d % 20 == 0, 8)
    assert plain(metric_search.top_k(vectors(llm, rows), F.col("vec_id") % 20 == 0, 8), *SEARCH) == expected


def test_bounds_avoid_distances():
    """In clustered rows most entries are ruled out by stored distances, and the result is that of a scan."""
    draw = np.random.default_rng(2)
    points = (draw.integers(-2000, 2000, (40, 16))[draw.integers(0, 40, 4000)] + draw.integers(-20, 21, (4000, 16))).astype(np.int64)
    norm = (points ** 2).sum(axis=1)
    space = metric_search.Space(float(norm.max()), 16, float(np.abs(points).max()))
    tree = metric_search.MTree.unpack(metric_search.MTree.build(space.rows(points)).pack())
    shard = metric_search.Shard(tree, points, np.arange(4000), np.arange(4000), space)
    asked = np.arange(0, 4000, 400)
    nothing = np.full(len(asked), metric_search.NOTHING)
    scans = [sorted((-int(s), i, i) for i, s in enumerate(points @ points[q]) if i != q)[:5] for q in asked]
    assert shard.best(points[asked], asked, 5, nothing) == scans
    assert shard.computed < len(asked) * 4000 * 0.5
    # Known bounds rule out more and lose nothing.
    before, shard.computed = shard.computed, 0
    assert shard.best(points[asked], asked, 5, np.array([-s[-1][0] for s in scans])) == scans
    assert shard.computed <= before


def test_search_table(llm, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.1"):
        assert compare(llm, "op11", QUERIES["op11_exact_top_k"], ORACLES["op11_exact_top_k"], folder, connect(folder))[0].startswith("ok")


# 12


@pytest.fixture(scope="module")
def whole_encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")


def alignment_rows(docs, encoders):
    """Rows of the report, from whole texts encoded at once by the libraries of the vocabularies."""
    a_model, b_model = encoders
    letters = alignment.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a_model.get_vocab().items() if t != "<|endoftext|>"}
    b_bytes = {i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in range(b_model.get_piece_size())}
    parts, holds = [], Counter()
    for _, text in docs:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            whole = (" " + text).encode()
            if b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
                a, b = [], []
        ends = [np.cumsum([0] + [size[x] for x in ids]).tolist() for ids, size in ((a, {i: len(t) for i, t in a_bytes.items()}), (b, {i: len(t) for i, t in b_bytes.items()}))]
        i = j = 0
        for end in sorted(set(ends[0][1:]) & set(ends[1][1:])):
            i2, j2 = ends[0].index(end), ends[1].index(end)
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links += [(a[x], b[y]) for x in range(i, i2) for y in range(j, j2) if ends[0][x] < ends[1][y + 1] and ends[1][y] < ends[0][x + 1]]
            i, j = i2, j2
        parts.append((a, b, groups, links))
        holds.update(set(links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    return sorted(((d, len(a), len(b), len(g), len(ls), sum(holds[p] == most[p[0]] for p in ls), sum(holds[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
                   for (d, _), (a, b, g, ls) in zip(docs, parts)), key=repr)


ALIGNMENT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
BITS = [" ", "  ", "a", "b ", "é", " \n", "\t", " ", "　", " ", "x▁y", "日本", "'s", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\x1c", "\x85", "\r\n", "12", "…", "\U0001f642", "!", "word",
        "​", "ﬁ", "\x00", "é", "﻿", "؀", "ำ"]


def test_alignment_odd(llm, odd_frame, odd_docs, no_docs, whole_encoders):
    draw = random.Random(3)
    texts = ["".join(draw.choice(BITS) for _ in range(draw.randint(1, 30))) for _ in range(300)]
    extra = [(1000 + i, t, "en", "a", 1, "r", "k", "s", "x", "y") for i, t in enumerate(texts)]
    expected = alignment_rows(pairs(odd_docs) + [(d[0], d[1]) for d in extra], whole_encoders)
    frame = odd_frame.unionByName(llm.createDataFrame(extra, odd_frame.schema))
    assert plain(alignment.alignment_report(frame), *ALIGNMENT) == expected
    # Small buckets and blocks: several passes, several rounds of sums.
    assert plain(alignment.alignment_report(frame.repartition(40), bucket_pairs=60, block_buckets=5), *ALIGNMENT) == expected
    assert alignment.alignment_report(no_docs).count() == 0
    assert [r[1:] for r in plain(alignment.alignment_report(odd_frame.where("text is null")), *ALIGNMENT)] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_table(llm, sf_dir, whole_encoders):
    docs = table_rows(llm, sf_dir, "documents", "doc_id", "text")
    assert plain(QUERIES["op12_tokenizer_alignment"](llm, sf_dir), *ALIGNMENT) == alignment_rows(docs, whole_encoders)


def test_long_texts_and_known_pieces(whole_encoders, monkeypatch):
    """A text longer than a slice, and a worker that forgets its pieces, give the ids of the whole text."""
    monkeypatch.setattr(alignment, "TEXT_BYTES", 1000)
    pair = alignment.Pair(alignment.FOLDER)
    monkeypatch.setattr(alignment, "KNOWN_PIECES", 3)
    texts = ["".join(random.Random(i).choice(BITS) for _ in range(3000)) for i in range(4)] + ["word " * 2000, "x" * 5000]
    for low, high in alignment.text_slices(pa.array(texts), alignment.TEXT_BYTES):
        for side, (ids, t) in enumerate(zip(alignment.encoded_slice(pa.array(texts[low:high]), pair), [0, 1])):
            for raw, text in zip(ids.to_pylist(), texts[low:high]):
                whole = whole_encoders[0].encode(" " + text, add_special_tokens=False).ids if side == 0 else whole_encoders[1].encode(text)
                assert np.frombuffer(raw, np.uint16).tolist() == ([] if "▁" in text else whole), t


def test_perfect_hash_is_minimal_and_verified():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 32, 50_000, dtype=np.uint32))
    buckets = 7
    of = alignment.bucket_of(keys, buckets)
    assert np.bincount(of).max() < 1.3 * len(keys) / buckets
    rows = []
    for b in range(buckets):
        sizes, words = perfect_hash.build(keys[of == b])
        by_index = np.empty((of == b).sum(), np.uint32)
        by_index[perfect_hash.PerfectHash([(sizes, words)]).index(keys[of == b], np.zeros(len(by_index), np.int64))] = keys[of == b]
        rows.append((b, [sizes.tobytes(), words.tobytes()], by_index.tobytes()))
    block = alignment.Block(buckets, rows)
    assert sorted(block.index(keys).tolist()) == list(range(len(keys)))
    assert (block.index(np.setdiff1d(draw.integers(0, 1 << 32, 10_000, dtype=np.uint32), keys)) == -1).all()
    part = alignment.Block(buckets, rows[2:4])
    assert ((part.index(keys) >= 0) == np.isin(of, [2, 3])).all()


def test_bucket_column_is_the_bucket(llm):
    keys = np.random.default_rng(2).integers(0, 1 << 32, 500)
    got = llm.createDataFrame([(int(k),) for k in keys], "k bigint").select("k", alignment.bucket_column(F.col("k"), 11).alias("b")).collect()
    assert [r.b for r in got] == alignment.bucket_of(np.array([r.k for r in got], np.uint32), 11).tolist()


# 13


def audit_rows(docs, labels):
    """Every order applied left to right, document by document."""
    firsts, good, toxic = {}, set(), set()
    order = lambda d: math.inf if d is None else d
    for d, t, *_ in docs:
        firsts[t or ""] = min(firsts.get(t or "", math.inf), order(d))
    for d, q, x in labels:
        if d is not None:
            good |= {d} if q == 1 else set()
            toxic |= {d} if x == 1 else set()
    fails = defaultdict(list)
    for d, t, source in docs:
        t = t or ""
        w = brute.words(t)
        failed = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), order(d) > firsts[t])) if bad}
        fails[source or ""].append((failed, d in good, d in toxic))
    out, total = {}, Counter()
    for part, rows in fails.items():
        for order_ in permutations("ABCDE"):
            alive = rows
            for step, f in enumerate(order_):
                removed = [r for r in alive if f in r[0]]
                alive = [r for r in alive if f not in r[0]]
                total[part, f] += len(removed)
                out[part, "".join(order_), step + 1] = (len(alive), len(removed), sum(f in r[0] for r in rows) - len(removed), sum(r[0] == {f} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed))
    return sorted(((*key, *values, total[key[0], key[1][key[2] - 1]]) for key, values in out.items()), key=repr)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_odd(llm, odd_frame, odd_docs, no_docs):
    draw = random.Random(5)
    more = [(30 + i, " ".join(draw.choice(["aa", "Bb", "c#", "dd", f"w{j}"]) for j in range(draw.choice([20, 250]))), "en", "", 1, "r", "k", "s", "x", "y") for i in range(20)]
    more += [(draw.choice([5, 40, None]), more[i % 4][1], "en", "Z", 1, "r", "k", "s", "x", "y") for i in range(8)]
    rows = odd_docs + more
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (30, 1, 1), (31, None, 1), (None, 1, 1), (40, 1, 0), (40, 1, 0), (9999, 1, 1)]
    frame = odd_frame.unionByName(llm.createDataFrame(more, odd_frame.schema))
    marks = llm.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    got = plain(audit.filter_audit(frame, marks), *AUDIT)
    assert got == audit_rows([(d[0], d[1], d[3]) for d in rows], labels) and sum(r[4] for r in got) > 1000
    assert audit.filter_audit(no_docs, marks).count() == 0
    assert audit.filter_audit(frame, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_positional_popcount():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 1000, 12_345):
        words = draw.integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.carry_save(words).tolist() == [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
    for failed in range(32):
        assert int(audit.survival_word(np.array([failed]))[0]) == sum(1 << s for s in range(32) if not s & failed)


def test_audit_table(llm, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        assert compare(llm, "op13", QUERIES["op13_filter_audit"], ORACLES["op13_filter_audit"], folder, connect(folder))[0].startswith("ok")
    docs, labels = table_rows(llm, sf_dir, "documents", "doc_id", "text", "source"), table_rows(llm, sf_dir, "labels", "doc_id", "quality", "toxic")
    assert plain(QUERIES["op13_filter_audit"](llm, sf_dir), *AUDIT) == audit_rows(docs, labels)
