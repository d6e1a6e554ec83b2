"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is an interpolated bigram model with absolute discounting over add-one unigrams:

    P(w | u) = max(c(u, w) - D, 0) / c(u) + D * T(u) / c(u) * P1(w),    P1(w) = (c(w) + 1) / (N + V + 1)

with c counts in the training texts, T(u) the number of different successors of u; an unknown context leaves P1(w).
A text's first word follows a begin mark, an end token closes every text.

The corpus is cut into slices of bounded size.  A slice sends each shard one packed message: its different contexts and
bigrams of that shard with their training counts.  Each shard sums the messages, builds its trie, writes the levels to a
scratch folder of the task, opens them memory-mapped and answers every slice, bigram by bigram in the order asked: one
byte each, and the exact c(u) and T(u) of each context.  Since every word of a text is a context too, an answered slice
knows all it needs to score its documents; nothing is returned per document and shard.

Shards are split by context hash.  Contexts with a large share of all tokens are split further by successor; a first
pass finds them (fewer than twice the number of shards can pass the share), and their sums over the pieces are one row
each.  The number of shards follows the size of the corpus, so a task's memory doesn't.

A slice is found again by what it holds and by its place in the scan, whose splits do not depend on the number of
executors; a slice without its answers is an error.  Word hashes have 64 bits, successors 40 bits inside their context,
probabilities of seen bigrams are quantised to one of 255 levels 0.05 apart in log10.

Defined cases: a null text is empty and has the end token only; rows are scored one by one, repeated or not; a null
doc_id counts as the empty text for the folds; without training texts every token is unknown and has P1 = 1; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import remainder
from ledgerlight.llm.eliasfano import FINGERPRINT_BITS, STEP, UNSEEN, Trie
from ledgerlight.llm.textual import BLANKS, buffers, mix, slices, words_of
from ledgerlight.session import written

DISCOUNT = 0.75
# The code of a discounted count of one; smaller codes are below one.
OFFSET = 20
SLICE_BYTES = 4 << 20
SHARD_BYTES = 12 << 20
FOLDS, HELD_OUT = 7, 2
BEGIN, END = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


class Sequence:
    """The bigrams of the texts of a slice, one for each token, with begin mark and end token."""

    def __init__(self, texts: pa.Array):
        words = words_of(texts, BLANKS, lower=True)
        hashes, texts_ = words.hashes(), len(words.counts)
        self.bounds = words.first + np.arange(texts_ + 1)
        place = np.arange(len(hashes)) + words.rows()
        self.word = np.full(len(hashes) + texts_, END, dtype=np.uint64)
        self.word[place] = hashes
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.bounds[:-1]] = BEGIN

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


class Router:
    """The shard of a bigram; hot contexts are spread over several shards by successor."""

    def __init__(self, shards: int, hot: list[tuple[int, int]]):
        self.shards = shards
        ordered = sorted((np.uint64(u & (2**64 - 1)), n) for u, n in hot)
        self.hot = np.array([u for u, _ in ordered], dtype=np.uint64)
        self.pieces = np.array([n for _, n in ordered], dtype=np.uint64)

    def is_hot(self, contexts: np.ndarray) -> np.ndarray:
        return np.isin(contexts, self.hot)

    def shard(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        base = mix(contexts ^ np.uint64(0x5851F42D4C957F2D))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
            rows = np.flatnonzero(self.hot[at] == contexts)
            base[rows] += mix(words[rows]) % self.pieces[at[rows]]
        return (base % np.uint64(self.shards)).astype(np.int64)


class Questions:
    """The different bigrams of a slice in the order (shard, context, word)."""

    def __init__(self, sequence: Sequence, router: Router):
        shard = router.shard(sequence.context, sequence.word)
        order = np.lexsort((sequence.word, sequence.context, shard))
        context, word, self.shards = sequence.context[order], sequence.word[order], shard[order]
        opens = np.ones(len(order), dtype=bool)
        opens[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1]) | (self.shards[1:] != self.shards[:-1])
        self.first = np.flatnonzero(opens)
        self.context, self.word, self.shard = context[self.first], word[self.first], self.shards[self.first]
        self.order = order
        starts = np.ones(len(self.first), dtype=bool)
        starts[1:] = (self.context[1:] != self.context[:-1]) | (self.shard[1:] != self.shard[:-1])
        # Where the contexts of each shard begin, and the pairs of each context.
        self.heads = np.flatnonzero(starts)

    def pair_of_token(self) -> np.ndarray:
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.order))))
        return out


def fingerprint(words: np.ndarray) -> np.ndarray:
    return mix(words) >> np.uint64(64 - FINGERPRINT_BITS)


def five_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a task's rows with an id: a hash of place and content."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        _, offsets = buffers(batch["text"])
        for low, high in slices(offsets, SLICE_BYTES):
            part = batch.slice(low, high - low)
            data, _ = buffers(part["text"])
            digest = xxhash.xxh64(data.tobytes(), seed=number)
            digest.update(repr((task, part["doc_id"].to_pylist())).encode())
            number += 1
            yield digest.intdigest() - (1 << 63), part


def frequent(docs: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Contexts with more than half a shard's share of all tokens, and the pieces each is cut into."""
    share = 1 / (2 * shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch["text"])
            for low, high in slices(offsets, SLICE_BYTES):
                context = np.sort(Sequence(batch["text"].slice(low, high - low)).context)
                opens = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                many = np.diff(np.append(opens, len(context)))
                keep = many >= max(2.0, share / 2 * len(context))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(context[opens[keep]].view(np.int64), 0)), pa.array(np.append(many[keep], len(context)))], ["u", "n"])

    # Word zero carries the number of tokens.
    counted = docs.select("text").mapInArrow(run, "u bigint, n bigint").groupBy("u").agg(F.sum("n").alias("n"))
    total = counted.where("u = 0").first()
    if total is None:
        return []
    return [(r.u, int(-(-r.n * 2 * shards // total.n))) for r in counted.where((F.col("u") != 0) & (F.col("n") > total.n * share)).collect()]


def questions(docs: DataFrame, router: Router) -> DataFrame:
    """(shard, slice, contexts, pairs, words, counts): the packed messages of all slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in cut(batches):
            sequence = Sequence(part["text"])
            asked = Questions(sequence, router)
            train = np.asarray(part["train"].cast(pa.int64()))[sequence.rows()]
            if not len(asked.first):
                continue
            counts = np.add.reduceat(train[asked.order], asked.first).astype("<u4")
            heads, ends = asked.heads, np.append(asked.heads[1:], len(asked.first))
            head_shard = asked.shard[heads]
            low = np.flatnonzero(np.concatenate([[True], np.diff(head_shard) != 0]))
            out: list[list] = [[] for _ in range(6)]
            for a, b in zip(low, np.append(low[1:], len(heads))):
                p, q = heads[a], ends[b - 1]
                for column, value in zip(out, (int(head_shard[a]), name, asked.context[heads[a:b]].astype("<u8").tobytes(), (ends[a:b] - heads[a:b]).astype("<u4").tobytes(),
                                               five_bytes(fingerprint(asked.word[p:q])), counts[p:q].tobytes())):
                    column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["shard", "slice", "contexts", "pairs", "words", "counts"])

    return docs.mapInArrow(run, "shard int, slice bigint, contexts binary, pairs binary, words binary, counts binary")


def build(context: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> Trie:
    """The trie of a shard from bigram counts; contexts carry (c, T) of this shard."""
    order = np.lexsort((word, context))
    context, word, count = context[order], word[order], count[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(opens)
    count = np.add.reduceat(count, first) if len(first) else count
    context, word = context[first], word[first]
    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    types = np.diff(np.append(heads, len(context)))
    totals = np.add.reduceat(count, heads) if len(heads) else np.zeros(0, np.int64)
    # A code is a discounted count: the home slice divides by the context's total, which it gets exactly.
    codes = np.clip(np.rint(np.log10(count - discount) / STEP) + OFFSET, 0, UNSEEN - 1).astype(np.uint8)
    return Trie.of(context[heads], np.stack([totals, types]), types, word, codes)




def answers(asked: DataFrame, router: Router, discount: float) -> DataFrame:
    """Per message (shard, slice, codes, totals); per shard one row of sums with the hot contexts' shares."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        context = [np.frombuffer(r["contexts"], "<u8") for r in rows]
        pairs = [np.frombuffer(r["pairs"], "<u4").astype(np.int64) for r in rows]
        count = [np.frombuffer(r["counts"], "<u4").astype(np.int64) for r in rows]
        word = [from_five_bytes(r["words"]) for r in rows]
        every = np.concatenate([np.repeat(c, p) for c, p in zip(context, pairs)])
        counts, words = np.concatenate(count), np.concatenate(word)
        known = np.flatnonzero(counts)
        out: list[list] = [[] for _ in range(8)]

        def add(*values) -> None:
            for column, value in zip(out, values):
                column.append(value)

        with tempfile.TemporaryDirectory() as folder:
            build(every[known], words[known], counts[known], discount).save(Path(folder))
            trie = Trie.open(Path(folder))
            codes, at = trie.find(every, words), 0
            totals = np.asarray(trie.totals)
            for r, c, p in zip(rows, context, pairs):
                size = int(p.sum())
                owner = np.minimum(np.searchsorted(trie.contexts, c), max(0, len(trie.contexts) - 1))
                numbers = np.zeros((2, len(c)), dtype="<i8")
                if len(trie.contexts):
                    numbers[:, trie.contexts[owner] == c] = totals[:, owner[trie.contexts[owner] == c]]
                add(r["shard"], r["slice"], zlib.compress(codes[at:at + size].tobytes(), 1), zlib.compress(numbers.tobytes(), 1), None, None, None, None)
                at += size
            hot = router.is_hot(np.asarray(trie.contexts))
            words_only = np.asarray(trie.contexts) != BEGIN
            add(rows[0]["shard"], None, None, None, int(totals[0][words_only].sum()), int((words_only & ~hot).sum()),
                np.asarray(trie.contexts)[hot].view(np.int64).tolist(), totals[:, hot].T.ravel().tolist())
            del trie
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], ["shard", "slice", "codes", "totals", "tokens", "types", "hot", "hot_totals"])

    return asked.groupBy("shard").applyInArrow(run, "shard int, slice bigint, codes binary, totals binary, tokens bigint, types bigint, hot array<bigint>, hot_totals array<bigint>")


def score(docs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (remainder(F.col("doc_id"), FOLDS) != HELD_OUT).alias("train"))
    sizes = source.agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)).alias("train")).first()
    shards, train_docs = int(max(1, -(-(sizes.bytes or 0) // SHARD_BYTES))), int(sizes.train)
    router = Router(shards, frequent(source, shards))
    answered = written(answers(questions(source, router), router, discount), "lm-answers")
    sums = answered.where("slice is null").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    # At most twice the number of shards.
    hot: dict[int, np.ndarray] = {}
    for r in answered.where("slice is null and size(hot) > 0").select("hot", "hot_totals").collect():
        for u, pair in zip(r.hot, np.array(r.hot_totals, dtype=np.int64).reshape(-1, 2)):
            hot[u] = hot.get(u, 0) + pair
    hot_words = np.array(sorted(hot, key=lambda u: u & (2**64 - 1)), dtype=np.int64)
    hot_totals = np.array([hot[u] for u in hot_words.tolist()], dtype=np.int64).reshape(-1, 2).T
    hot_words = hot_words.view(np.uint64)
    tokens = int(sums.tokens or 0) + train_docs
    types = int(sums.types or 0) + int((hot_words != BEGIN).sum()) + (train_docs > 0)

    def home(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = texts.sort_by("row")
        column = texts["text"].combine_chunks()
        sequence = Sequence(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        asked = Questions(sequence, router)
        by_shard = {r["shard"]: r for r in replies.select(["shard", "codes", "totals"]).to_pylist()}
        needed = asked.shard[np.flatnonzero(np.concatenate([[True], np.diff(asked.shard) != 0]))].tolist()
        if sorted(by_shard) != needed:
            raise ValueError("a slice of the second scan has no answers: the two scans were split differently")
        codes = np.concatenate([np.frombuffer(zlib.decompress(by_shard[s]["codes"]), np.uint8) for s in needed])
        totals = np.concatenate([np.frombuffer(zlib.decompress(by_shard[s]["totals"]), "<i8").reshape(2, -1) for s in needed], axis=1)
        heads = asked.context[asked.heads]
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, heads), len(hot_words) - 1)
            same = hot_words[at] == heads
            totals[:, same] = hot_totals[:, at[same]]
        # Counts of words: every word but the end token is a context of this slice.
        known, where = np.unique(np.append(heads, END), return_index=True)
        count_of = np.append(totals[0], train_docs)[where]
        per_pair = np.diff(np.append(asked.heads, len(asked.first)))
        c_u, t_u = np.repeat(totals[0], per_pair).astype(np.float64), np.repeat(totals[1], per_pair).astype(np.float64)
        c_w = count_of[np.searchsorted(known, asked.word)].astype(np.float64)
        base = np.log10((c_w + 1) / (tokens + types + 1))
        seen = np.where(codes == UNSEEN, 0.0, 10.0 ** ((codes.astype(np.float64) - OFFSET) * STEP))
        divisor = np.maximum(c_u, 1)
        mixed = np.where(c_u > 0, np.minimum(seen / divisor, 1.0) + discount * t_u / divisor * 10.0 ** base, 10.0 ** base)
        token = asked.pair_of_token()
        first = sequence.bounds[:-1]
        add = lambda x: np.add.reduceat(x[token], first) if len(first) else np.zeros(0)
        return pa.table([texts["doc_id"].combine_chunks(), texts["train"].combine_chunks(), pa.array(np.diff(sequence.bounds)), pa.array(add((c_w > 0).astype(np.int64))),
                         pa.array(add(base)), pa.array(add(np.log10(np.minimum(mixed, 1.0))))], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(np.arange(len(part))), *(part[c] for c in ("doc_id", "text", "train"))],
                                             ["slice", "row", "doc_id", "text", "train"])

    slices_ = source.mapInArrow(numbered, "slice bigint, row bigint, doc_id bigint, text string, train boolean")
    replies = answered.where("slice is not null").select("shard", "slice", "codes", "totals")
    scored = slices_.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(home, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
