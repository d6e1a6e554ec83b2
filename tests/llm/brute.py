"""Brute-force versions of the operators, row by row in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BLANK = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return BLANK.findall(text or "")


def substring_rows(docs, length=50):
    """Rows (doc_id, n_words, n_removed, sha256); a null id is larger than any other."""
    order = lambda d: math.inf if d is None else d
    first = {}
    for d, text in docs:
        w = words(text)
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            first[key] = min(first.get(key, math.inf), order(d))
    out = []
    for d, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < order(d):
                gone[p:p + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def contamination_rows(docs, items, window=10):
    """Rows (doc_id, n_words, n_hit, n_items, sha256, contaminated)."""
    found = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        size = min(window, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            found[tuple(w[p:p + size])].add("" if i is None else str(i))
    out = []
    for d, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, names = [False] * len(w), set()
        for size in {len(k) for k in found}:
            for p in range(len(w) - size + 1):
                if tuple(w[p:p + size]) in found:
                    names |= found[tuple(w[p:p + size])]
                    hit[p:p + size] = [True] * size
        out.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    return out


def simhash(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, linked):
    """Smallest reachable number of each of n nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_rows(docs):
    fps = [simhash(t) for _, t in docs]
    roots = reach(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for (d, _), r in zip(docs, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(docs, fps, roots)]


def vector_rows(rows, cosine=0.95):
    """Rows (vec_id, n_links, component_id, kept)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    close = lambda i, j: ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine
    links = [sum(close(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    roots = reach(len(rows), close)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, n, least.get(r) if ok[i] else d, d is not None and (d == least.get(r) if ok[i] else True)) for i, ((d, _), n, r) in enumerate(zip(rows, links, roots))]


def language_rows(docs, discount=0.75):
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of the exact model."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    unigrams, bigrams, contexts, types = Counter(), Counter(), Counter(), Counter()
    tokens = [words((t or "").translate(LOWER)) + [None] for _, t in docs]
    for (d, _), w in zip(docs, tokens):
        if not held(d):
            unigrams.update(w)
            for pair in zip([""] + w, w):
                types[pair[0]] += pair not in bigrams
                bigrams[pair] += 1
                contexts[pair[0]] += 1
    n, v = sum(unigrams.values()), len(unigrams)
    one = lambda w: (unigrams[w] + 1) / (n + v + 1)
    out = []
    for (d, _), w in zip(docs, tokens):
        score = sum(math.log10(max(bigrams[u, x] - discount, 0) / contexts[u] + discount * types[u] / contexts[u] * one(x) if contexts[u] else one(x)) for u, x in zip([""] + w, w))
        out.append((d, held(d), len(w), sum(unigrams[x] > 0 for x in w), n, sum(math.log10(one(x)) for x in w), score))
    return out


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_copy_groups(docs, at_least=0.8):
    """The smallest doc_id of every row's group of near copies."""
    sets = [shingles(t) for _, t in docs]
    # Similar sets are of similar size, so only those are compared.
    roots = reach(len(docs), lambda i, j: at_least * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j])) and similarity(sets[i], sets[j]) >= at_least)
    least = {}
    for (d, _), r in zip(docs, roots):
        least[r] = min(least.get(r, d), d)
    return [least[r] for r in roots]
