"""The operators against brute force: on odd rows (null, empty, long, repeated, clashing names), on empty tables and on a small table."""

import base64
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import collisions, common, decontaminate, lm, mixing, placement, simhash, substrings, toxicity, urls, warc
from ledgerlight.llm.eliasfano import UNSEEN, EliasFano, Trie
from ledgerlight.llm.queries import ORACLES, QUERIES
from ledgerlight.llm.textual import NON_ALNUM, words_of
from tests.compare import compare, connect
from tests.llm import brute

ITEMS = [(1, "Größe ÉTÉ, größe été!"), (2, "one"), (3, None), (4, ""), (None, "same end"), (5, "x-x x x x x x x x x x x x"), (5, "no such words here")]


def plain(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def pairs(docs):
    return [(d[0], d[1]) for d in docs]


def table_rows(spark, sf_dir, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()]


def test_words_are_those_of_the_patterns():
    texts = ["a b", None, "", " x\u00a0y\tZ\x0b", "é-É_9", "\x00\x1f", "q" * 3_000_000]
    for stops, pattern, lower in ((None, brute.BLANK, False), (NON_ALNUM, brute.ALNUM, True)):
        found = words_of(pa.array(texts), lower=lower) if stops is None else words_of(pa.array(texts), stops, lower)
        expected = [pattern.findall((t or "").translate(brute.LOWER) if lower else t or "") for t in texts]
        got = [[found.data[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b])] for a, b in zip(found.first, found.first[1:])]
        assert got == expected
        by_hash = dict(zip(found.hashes().tolist(), (w for ws in expected for w in ws)))
        assert len(by_hash) == len({w for ws in expected for w in ws})


def test_components(llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (7, 3)] + [(300, i) for i in range(301, 340)]
    got = dict(common.components(llm.createDataFrame(edges, "a bigint, b bigint"), "test").collect())
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100, **dict.fromkeys(range(301, 340), 300)} | {k: v for k, v in got.items() if k == v}
    assert common.components(llm.createDataFrame([], "a bigint, b bigint"), "test").count() == 0


# 1


def test_substrings_odd(odd_frame, odd_docs):
    expected = brute.substring_rows(pairs(odd_docs))
    assert sum(r[2] for r in expected) > 500
    assert plain(substrings.cut_report(odd_frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)


def test_substrings_short_windows(odd_frame, odd_docs):
    assert plain(substrings.cut(odd_frame, 5, 2), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_rows(pairs(odd_docs), 5), key=repr)


def test_substrings_table(llm, sf_dir):
    docs = table_rows(llm, sf_dir, "documents", "doc_id", "text")
    assert plain(QUERIES["op1_substring_dedup"](llm, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_rows(docs), key=repr)


# 2


PAGES = [(1, "http://B.example.com/x?a=1#f", "<p>é</p>"), (2, "http://b.example.com/x?a=1#f", "<p>é</p>"), (2, "http://b.example.com/x?a=1#f", "<p>é</p>"), (3, None, None), (4, "no scheme\r\nX: y", ""),
         (5, "https://a.example.org", "z" * 400_000), (None, "http://a.example.org/", "<p>é</p>"), (6, "http://a.example.org/", "line\r\n\r\nline")]


def capture_rows(pages):
    first = {}
    for p, _, html in pages:
        body = (html or "").encode()
        if p is not None:
            first[body] = min(first.get(body, p), p)
    out = []
    for p, _, html in pages:
        body = (html or "").encode()
        owner = first.get(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((p, len(body), digest, "response" if p == owner else "revisit", None if p == owner else owner))
    return sorted(out, key=repr)


WARC_COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_warc_odd(llm):
    pages = llm.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, file string")
    assert plain(warc.round_trip(llm, pages), *WARC_COLUMNS) == capture_rows(PAGES)
    assert warc.round_trip(llm, pages.limit(0)).count() == 0


def test_warc_blocks_and_files(llm, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "LINES_PER_FILE", 20)
    pages = [(i % 90, f"http://h{i % 7}.example.com/{i % 11}", f"body {i % 50}") for i in range(180)]
    frame = llm.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    assert plain(warc.round_trip(llm, frame), *WARC_COLUMNS) == capture_rows(pages)


def test_warc_table(llm, sf_dir):
    assert plain(QUERIES["op2_warc_index"](llm, sf_dir), *WARC_COLUMNS) == capture_rows(table_rows(llm, sf_dir, "pages", "page_id", "url", "html"))


# 3


HIT_COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_odd(llm, odd_frame, odd_docs, monkeypatch):
    items = ITEMS + [(9, odd_docs[6][1]), (10, " ".join(odd_docs[14][1].split()[8990:9100]))]
    bench = llm.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(brute.contamination_rows(pairs(odd_docs), items), key=repr)
    assert plain(decontaminate.contamination_report(odd_frame, bench), *HIT_COLUMNS) == expected
    # Several blocks of the benchmark.
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert plain(decontaminate.contamination_report(odd_frame, bench), *HIT_COLUMNS) == expected
    clean = decontaminate.remove_contaminated(odd_frame, bench)
    assert clean.columns == odd_frame.columns and clean.count() == sum(not r[-1] for r in expected)


def test_contamination_across_shards():
    """Matches that run over the ends of suffix-array shards are found."""
    words = [f"w{i % 40}" for i in range(400)]
    item = words[35:60]
    before, decontaminate.SHARD_WORDS = decontaminate.SHARD_WORDS, 16
    try:
        found = words_of(pa.array([" ".join(words)]), NON_ALNUM, lower=True)
        block = decontaminate.Patterns(["1"], pa.array([" ".join(item)]), 10)
        spots = np.concatenate([s for _, s, *_ in decontaminate.occurrences(found, [lambda: block])])
    finally:
        decontaminate.SHARD_WORDS = before
    expected = [p for p in range(391) for q in range(16) if words[p:p + 10] == item[q:q + 10]]
    assert sorted(spots.tolist()) == expected


def test_longest_matches(llm):
    text = [f"t{i}" for i in range(100)]
    docs = llm.createDataFrame([(1, " ".join(["a"] + text[10:40] + ["b"] + text[60:72]))], "doc_id bigint, text string")
    bench = llm.createDataFrame([(5, " ".join(text))], "item_id bigint, text string")
    assert plain(decontaminate.longest_matches(docs, bench), "doc_id", "item_id", "doc_word", "item_word", "n_words") == [(1, "5", 1, 10, 30), (1, "5", 32, 60, 12)]


def test_repeated_words_are_searched_once():
    """Twenty thousand equal words against as many: one window, found at every place, in time that does not grow with the product."""
    started = time.monotonic()
    found = words_of(pa.array(["x " * 20_000]), NON_ALNUM, lower=True)
    block = decontaminate.Patterns(["1", "2"], pa.array(["x " * 20_000, "X " * 15_000]), 10)
    (_, spots, which, own), = decontaminate.occurrences(found, [lambda: block])
    assert len(own.windows) == 1 and len(spots) == 19_991 and not which.any()
    assert time.monotonic() - started < 10


def test_repeated_words_report(llm):
    docs = llm.createDataFrame([(1, "x " * 20_000), (2, "x " * 9)], "doc_id bigint, text string")
    bench = llm.createDataFrame([(i, "x " * 4_000) for i in range(40)], "item_id bigint, text string")
    assert plain(decontaminate.contamination_report(docs, bench), "doc_id", "n_hit", "n_items") == [(1, 20_000, 40), (2, 0, 0)]


def test_contamination_empty(llm, odd_frame, no_docs):
    bench = llm.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.contamination_report(odd_frame, bench).collect())
    assert decontaminate.contamination_report(no_docs, bench).count() == 0


def test_contamination_table(llm, sf_dir):
    docs, items = table_rows(llm, sf_dir, "documents", "doc_id", "text"), table_rows(llm, sf_dir, "benchmark", "item_id", "text")
    assert plain(QUERIES["op3_suffix_decontamination"](llm, sf_dir), *HIT_COLUMNS) == sorted(brute.contamination_rows(docs, items), key=repr)


# 4


def test_simhash_odd(odd_frame, odd_docs, no_docs):
    assert plain(simhash.near_duplicate_report(odd_frame), "doc_id", "fingerprint", "component_id") == sorted(brute.simhash_rows(pairs(odd_docs)), key=repr)
    assert simhash.near_duplicate_report(no_docs).count() == 0
    kept = simhash.keep_one(odd_frame)
    assert kept.columns == odd_frame.columns
    fps = [brute.simhash(t) for _, t in pairs(odd_docs)]
    groups = {}
    for (d, _), root in zip(pairs(odd_docs), brute.reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)):
        groups.setdefault(root, []).append(math.inf if d is None else d)
    assert sorted(math.inf if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert simhash.keep_one(no_docs).count() == 0


def test_ball_links(llm):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 20, dtype=np.uint64) * np.uint64(2)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(15):
            fps.add(b ^ sum(1 << int(i) for i in draw.choice(64, int(draw.integers(1, 6)), replace=False)))
    ordered = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    expected = [(f, g) for i, f in enumerate(ordered) for g in ordered[i + 1:] if ((f ^ g) & (1 << 64) - 1).bit_count() <= 3]
    assert plain(simhash.ball_links(llm.createDataFrame([(f,) for f in ordered], "fp bigint")), "f", "g") == sorted(expected, key=repr)


def test_ball_is_never_broadcast(llm):
    """However few fingerprints there are: Spark takes their exploded variants for as small as they are."""
    fps = llm.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.ball_links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_table(llm, sf_dir):
    docs = table_rows(llm, sf_dir, "documents", "doc_id", "text")
    assert plain(QUERIES["op4_simhash_balls"](llm, sf_dir), "doc_id", "fingerprint", "component_id") == sorted(brute.simhash_rows(docs), key=repr)


# 5


def test_toxicity_held_out(llm):
    sf_dir = "/root/testdata/sf0.1"
    labels = dict(table_rows(llm, sf_dir, "labels", "doc_id", "toxic"))
    rows = [r for r in QUERIES["op5_weak_toxicity"](llm, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert right >= 0.75 * sum(labels[r.doc_id] for r in rows)
    assert right >= 0.95 * sum(r.predicted for r in rows)


def test_toxicity_odd(llm, odd_frame, odd_docs, no_docs):
    rude = [(100 + i, f"you {'grimble' if i % 2 else 'fine'}{'abc'[i % 3]} thing number {i}") for i in range(120)]
    docs = odd_frame.unionByName(llm.createDataFrame([(d, t, "en", "a", 1, "r", "k", "s", "x", "y") for d, t in rude], odd_frame.schema))
    labels = llm.createDataFrame([(100 + i, 1, i % 2, "n") for i in range(120)] + [(100, 1, None, "n"), (101, 1, 1, "n"), (None, 1, 1, "n")], "doc_id bigint, quality int, toxic int, note string")
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == len(odd_docs) + 120
    score = {r.doc_id: r.score for r in rows}
    assert all((score[100 + i] > 0.7) == (i % 2 == 1) for i in range(120))
    assert score[1] == score[2] == min(score.values())
    clean = toxicity.reject_toxic(docs, labels)
    assert clean.columns == docs.columns and clean.count() == len(odd_docs) + 60
    assert {r.score for r in toxicity.toxicity_report(odd_frame, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_report(no_docs, labels).count() == 0


# 6


def test_lookup_table_takes_turns():
    names = ["a", "b", "c"]
    owner = placement.lookup_table(names, 13)
    offsets, skips = [], []
    for n in names:
        digest = hashlib.md5(n.encode()).digest()
        offsets.append(int.from_bytes(digest[:8], "big") % 13)
        skips.append(int.from_bytes(digest[8:], "big") % 12 + 1)
    wish = [[(o + i * s) % 13 for i in range(13)] for o, s in zip(offsets, skips)]
    slots = [None] * 13
    for turn in range(13):
        shard = turn % 3
        slots[next(s for s in wish[shard] if slots[s] is None)] = shard
    assert owner.tolist() == slots
    with pytest.raises(ValueError):
        placement.lookup_table(names, 12)


def test_taking_a_shard_away_moves_little():
    names = [f"s{i}" for i in range(20)]
    before, after = placement.lookup_table(names, 5003), placement.lookup_table(names[:-1], 5003)
    moved = np.mean((before != after)[before != 19])
    assert moved < 0.1 and np.bincount(after).max() - np.bincount(after).min() <= 1


def test_placement_rows(llm, odd_frame, odd_docs, no_docs, sf_dir):
    owner = placement.lookup_table([f"shard-{i:05d}" for i in range(placement.SHARDS)])
    slot = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16) % placement.SLOTS
    for frame, ids in ((odd_frame, [d[0] for d in odd_docs]), (no_docs, [])):
        assert plain(placement.placement_report(frame), "doc_id", "slot", "shard") == sorted(((d, slot(d), int(owner[slot(d)])) for d in ids), key=repr)
    ids = [d for d, in table_rows(llm, sf_dir, "documents", "doc_id")]
    assert plain(QUERIES["op6_shard_placement"](llm, sf_dir), "doc_id", "slot", "shard") == sorted(((d, slot(d), int(owner[slot(d)])) for d in ids), key=repr)


# 7


URLS = ["http://a.example.com/en/7/x?q#f", "HTTP://A.Example.COM/en/8", "https://x.de.net/de/1", "https://www.example.net/de/80", "https://org/es/", "https://norg/es/", None, "no scheme/en/",
        "ftp://h.net?x://y", "http://h.com/en", "http://e.com#/en/", "://x.org/es/a\nb", "http://com/en/é"]


def rule_rows(urls_):
    out = []
    for i, u in enumerate(urls_):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, tail = rest[:cut].translate(brute.LOWER), rest[cut:]
            path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        out.append((i, host, path, best[0] + best[1] if best else None, best[2] if best else "allow"))
    return sorted(out, key=repr)


URL_COLUMNS = ("page_id", "host", "path", "rule", "verdict")


def test_url_rules_odd(llm):
    pages = llm.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    labels = llm.createDataFrame([(0, 1, 0), (None, None, 0)], "doc_id bigint, quality int, toxic int")
    assert plain(urls.judge(pages, labels), *URL_COLUMNS) == rule_rows(URLS)
    assert urls.judge(pages.limit(0), labels.limit(0)).count() == 0
    assert urls.judge(pages.union(pages), labels).count() == 2 * len(URLS)


def test_url_templates_learn(llm):
    """A branch of bad pages is rejected, a branch like its sibling is judged with it, a node of many children is one template."""
    pages, labels = [], []
    for i in range(300):
        branch = ("spam", "news", "blog")[i % 3]
        pages.append((i, f"http://site.xyz/{branch}/{i}.html"))
        labels.append((i, int(branch != "spam"), 0))
    pages += [(1000 + i, f"http://many.xyz/w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}") for i in range(200)]
    labels += [(1000 + i, 0, 0) for i in range(0, 200, 2)]
    got = {r.page_id: r.verdict for r in urls.judge(llm.createDataFrame(pages, "page_id bigint, url string"), llm.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert all((got[i] == "block") == (i % 3 == 0) for i in range(300))
    assert all(got[1000 + i] == "block" for i in range(200))


def judged_by_tree(pages, labels):
    """Verdicts of all pages by a tree of dictionaries, node by node from the host down."""
    quality = {}
    for d, q in labels:
        if d is not None and q is not None:
            quality[d] = max(q, quality.get(d, q))
    rows = []
    for page, (_, host, path, rule, verdict) in zip([p for p, _ in pages], sorted(rule_rows([u for _, u in pages]))):
        parts = path.removeprefix("/").split("/")
        wild = lambda s: "*" + (re.search("[.][A-Za-z]+$", s) or [""])[0] if re.search("[0-9]", s) or re.fullmatch("[0-9a-fA-F]{16,}", s) else s
        rows.append([page, host, tuple(map(wild, parts)), rule, verdict, quality.get(page)])
    for level in range(max(len(r[2]) for r in rows)):
        children = defaultdict(Counter)
        for r in rows:
            if len(r[2]) > level:
                children[r[1], r[2][:level]][r[2][level]] += 1
        for r in rows:
            if len(r[2]) > level:
                node = children[r[1], r[2][:level]]
                if len(node) > urls.FANOUT and node[r[2][level]] < node.total() * urls.SMALL_SHARE:
                    r[2] = (*r[2][:level], "*", *r[2][level + 1:])
    good, bad = Counter(), Counter()
    for r in rows:
        for depth in range(len(r[2]) + 1):
            good[r[1], r[2][:depth]] += r[5] == 1
            bad[r[1], r[2][:depth]] += r[5] == 0
    n_good, n = sum(r[5] == 1 for r in rows), sum(r[5] is not None for r in rows)
    out = []
    for page, host, template, rule, verdict, _ in rows:
        p = n_good / n if n else 1.0
        share = 1 - p
        for depth in range(len(template) + 1):
            g, b = good[host, template[:depth]], bad[host, template[:depth]]
            if g + b and abs(b / (g + b) - share) > urls.Z * math.sqrt(share * (1 - share) / (g + b)):
                p = (g + urls.SMOOTHING * p) / (g + b + urls.SMOOTHING)
            share = b / (g + b) if g + b else share
        out.append((page, rule, verdict if rule else "block" if p < urls.PURITY else "allow"))
    return sorted(out, key=repr)


def test_url_tree_on_random_paths(llm):
    draw = random.Random(4)
    names = ["news", "spam", "shop", "blog", "x", "archive"]
    pages, labels = [], []
    for i in range(1500):
        host = draw.choice(["a.xyz", "b.xyz", "c.example.com", "d.info"])
        parts = [draw.choice(names) for _ in range(draw.choice([0, 1, 2, 3, 10]))] + [draw.choice([f"p{i}.html", f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", ""])]
        pages.append((i, f"http://{host}/" + "/".join(parts)))
        if draw.random() < 0.6:
            labels.append((i, int(draw.random() < (0.1 if "spam" in parts[1:] or parts[:1] == ["shop"] and host == "b.xyz" else 0.9))))
    labels += [(None, 0), (3, None), (5, 1), (5, 0)]
    got = urls.judge(llm.createDataFrame(pages, "page_id bigint, url string"), llm.createDataFrame([(d, q, 0) for d, q in labels], "doc_id bigint, quality int, toxic int"))
    expected = judged_by_tree(pages, labels)
    assert plain(got, "page_id", "rule", "verdict") == expected
    assert 100 < sum(v == "block" and r is None for _, r, v in expected) < 1200


def test_url_paths_deeper_than_any_limit(llm):
    """Branches that part at the twentieth segment are told apart."""
    pages = [(i, "http://deep.xyz/" + "/".join("abcdefghijklmnopqrst"[j] for j in range(20)) + f"/{'bad' if i % 2 else 'fine'}/x{i}") for i in range(200)]
    labels = [(i, 1 - i % 2, 0) for i in range(0, 200)]
    got = {r.page_id: r.verdict for r in urls.judge(llm.createDataFrame(pages, "page_id bigint, url string"), llm.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert all((got[i] == "block") == (i % 2 == 1) for i in range(200))
    # Labels without pages change nothing.
    more = llm.createDataFrame(labels + [(1000 + i, 0, 0) for i in range(500)], "doc_id bigint, quality int, toxic int")
    assert {r.page_id: r.verdict for r in urls.judge(llm.createDataFrame(pages, "page_id bigint, url string"), more).collect()} == got


def test_url_table(llm, sf_dir):
    rows = table_rows(llm, sf_dir, "pages", "page_id", "url")
    expected = {r[0]: r for r in rule_rows([u for _, u in rows])}
    got = {r.page_id: r for r in QUERIES["op7_url_templates"](llm, sf_dir).collect()}
    for i, (page, _) in enumerate(rows):
        _, host, path, rule, verdict = expected[i]
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule)
        assert got[page].verdict in ("allow", "block") and (rule is None or got[page].verdict == verdict)


# 8


def test_vectors_odd(llm):
    draw = np.random.default_rng(5)
    centre = draw.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + 0.1 * draw.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(70, rows[0][1]), (71, rows[0][1]), (71, rows[0][1]), (72, [x * 3 for x in rows[1][1]]), (73, None), (74, []), (75, [0.0] * 16), (76, [None] + [1.0] * 15), (77, [math.nan] + [1.0] * 15),
             (78, [math.inf] + [1.0] * 15), (78, [0.0] * 16), (79, [1.0, 2.0]), (None, rows[2][1])]
    expected = [r if r[0] != 79 else (79, 0, 79, True) for r in brute.vector_rows(rows)]
    frame = llm.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, node string").repartition(3)
    assert plain(collisions.near_duplicates(frame), "vec_id", "n_links", "component_id", "kept") == sorted(expected, key=repr)
    assert collisions.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_hot_cell_in_blocks(llm, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 16)
    monkeypatch.setattr(collisions, "GROUP_ROWS", 64)
    draw = np.random.default_rng(6)
    centre = draw.standard_normal(16)
    rows = [(i, (centre + 0.22 * draw.standard_normal(16)).tolist()) for i in range(150)] + [(200 + i, draw.standard_normal(16).tolist()) for i in range(50)]
    expected = {r[0]: r for r in brute.vector_rows(rows)}
    got = collisions.near_duplicates(llm.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r.n_links <= expected[r.vec_id][1] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(r[1] for r in expected.values())
    assert sum(r.component_id == expected[r.vec_id][2] for r in got) >= 198


def test_vectors_of_two_lengths(llm):
    draw = np.random.default_rng(8)
    rows = []
    for size, many in ((16, 60), (24, 40), (5, 2)):
        centre = draw.standard_normal((5, size))
        rows += [(100 * size + i, (centre[i % 5] + 0.1 * draw.standard_normal(size)).tolist()) for i in range(many)]
    rows += [(1, rows[60][1]), (2, rows[100][1]), (3, rows[0][1][:5])]
    expected = brute.vector_rows(rows)
    assert sum(r[1] for r in expected if 2400 <= r[0] < 2500) >= 100 and expected[-2][1] >= 1
    frame = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert plain(collisions.near_duplicates(frame), "vec_id", "n_links", "component_id", "kept") == sorted(expected, key=repr)


def test_vectors_table(llm, sf_dir):
    rows = table_rows(llm, sf_dir, "embeddings", "vec_id", "embedding")
    assert plain(QUERIES["op8_collision_counting"](llm, sf_dir), "vec_id", "n_links", "component_id", "kept") == sorted(brute.vector_rows(rows), key=repr)


# 9


def test_mix_sql(llm, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        assert compare(llm, "op9", QUERIES["op9_mix_sources"], ORACLES["op9_mix_sources"], folder, connect(folder))[0].startswith("ok")


def filled_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Reshare the excess until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] > limit * sizes[n]}
        if not over:
            target |= {n: level * weight[n] for n in free}
            break
        target |= {n: float(limit * sizes[n]) for n in over}
        rest -= sum(limit * sizes[n] for n in over)
        free -= over
    return target


def test_mix_odd(llm, odd_frame, odd_docs, no_docs):
    size = Counter()
    for d in odd_docs:
        size[d[3]] += len(brute.words(d[1]))
    expected = filled_targets(size)
    for r in mixing.rates(odd_frame).select("size", "source_size", "target", "copies", "row.source", "row.text").collect():
        assert r.size == len(brute.words(r.text)) and r.source_size == size[r.source] and r.target == pytest.approx(expected[r.source])
        assert math.floor(r.target / r.source_size) <= r.copies <= 2
    mixed = mixing.mix(odd_frame)
    assert mixed.columns == odd_frame.columns
    assert mixed.count() == mixing.rates(odd_frame).agg(F.sum("copies")).first()[0]
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mix_is_native_and_near_its_targets(llm):
    frame = mixing.mix_report(llm.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()
    for r in frame.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.12 * r.target + 1


# 10


LM_COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def check_scores(frame, docs):
    got = sorted(frame.collect(), key=lambda r: (repr(r.doc_id), r.n_tokens, r.score))
    expected = sorted(brute.language_rows(docs), key=lambda r: (repr(r[0]), r[2], r[6]))
    assert len(got) == len(expected)
    for r, e in zip(got, expected):
        assert tuple(r[c] for c in LM_COLUMNS) == e[:5]
        assert r.base_score == pytest.approx(e[5], rel=1e-9)
        assert abs(r.score - e[6]) <= 0.03 * e[2]


def test_language_model_odd(odd_frame, odd_docs, no_docs):
    check_scores(lm.score(odd_frame), pairs(odd_docs))
    assert lm.score(no_docs).count() == 0


def test_language_model_shards_and_hot_contexts(llm, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(lm, "SLICE_BYTES", 3_000)
    draw = np.random.default_rng(8)
    docs = [(i, " ".join("the" if x < 0.35 else f"w{int(x * 300)}" for x in draw.random(60))) for i in range(150)]
    frame = llm.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    source = frame.withColumn("train", F.lit(True))
    assert lm.frequent(source, 12)
    check_scores(lm.score(frame), docs)


def test_language_model_table(llm, sf_dir):
    docs = table_rows(llm, sf_dir, "documents", "doc_id", "text")
    frame = QUERIES["op10_trie_language_model"](llm, sf_dir)
    check_scores(frame, docs)
    held = frame.where("held_out").agg(F.sum("score") - F.sum("base_score")).first()[0]
    assert held > 0


def test_elias_fano_round_trip():
    draw = np.random.default_rng(1)
    for size, universe in ((0, 10), (1, 1), (1000, 1 << 50), (5000, 6000), (300, 1 << 57)):
        values = np.sort(draw.integers(0, universe, size, dtype=np.uint64))
        packed = EliasFano.of(values, universe)
        assert (packed.at(np.arange(size)) == values).all()
        wanted = draw.integers(0, universe, 500, dtype=np.uint64)
        assert (packed.successor(wanted) == np.searchsorted(values, wanted, side="left")).all()


def test_trie_levels_from_disk(tmp_path):
    contexts = np.array([3, 9, 1 << 63], dtype=np.uint64)
    words = np.array([5, 7, 1, 2, 1 << 39], dtype=np.uint64)
    Trie.of(contexts, np.ones((2, 3), np.int64), np.array([2, 0, 3]), words, np.arange(5, dtype=np.uint8)).save(tmp_path)
    trie = Trie.open(tmp_path)
    asked = np.array([3, 3, 3, 9, 1 << 63, 1 << 63, 4, 3], dtype=np.uint64)
    found = trie.find(asked, np.array([5, 7, 6, 1, 1 << 39, 2, 5, 1 << 39], dtype=np.uint64))
    assert found.tolist() == [0, 1, UNSEEN, UNSEEN, 4, 3, UNSEEN, UNSEEN]
    json.dumps(found.tolist())


# The pipeline


def test_pipeline_stages_on_odd_rows(llm, odd_frame, odd_docs, no_docs, sf_dir):
    for docs in (odd_frame, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(llm, docs, sf_dir)
            assert set(docs.columns) <= set(out.columns), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            docs = out
        docs.collect()


def test_pipeline_table(llm, sf_dir):
    """Each stage against its own brute force, on what the stage before kept."""
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](llm, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in QUERIES["op5_weak_toxicity"](llm, sf_dir).collect()}
    rows = plain(kept, "doc_id", "text")
    assert [d for d, _ in rows] == sorted((d for d, p in scores.items() if not p), key=lambda d: repr((d,))) or {d for d, _ in rows} == {d for d, p in scores.items() if not p}
    once = corpus_pipeline.STAGES[1][1](llm, kept, sf_dir)
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(brute.near_copy_groups(rows)))
    clean = corpus_pipeline.STAGES[2][1](llm, once, sf_dir)
    hits = brute.contamination_rows(plain(once, "doc_id", "text"), table_rows(llm, sf_dir, "benchmark", "item_id", "text"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(h[0] for h in hits if not h[-1])
    copies = Counter(r.doc_id for r in corpus_pipeline.STAGES[3][1](llm, clean, sf_dir).collect())
    assert set(copies) <= {r.doc_id for r in clean.collect()} and max(copies.values()) <= 2
    final = corpus_pipeline.run(llm, sf_dir)
    assert Counter(r.doc_id for r in final.collect()) == copies
