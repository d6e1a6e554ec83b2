"""Toxicity by weak supervision.

Terms (whole words and word beginnings of four to six bytes) that labelled toxic documents have more often than chance
allows make the lexicons; the forms of one stem go to one lexicon.  Every lexicon is a voter, and so are a few writing
patterns.  A generative label model over the votes of all documents of the learning folds estimates, by expectation
maximisation, how often each voter fires on toxic and on clean documents, and how strongly voters are correlated inside
a class; correlated voters share their weight.  Its posterior (with the label as one more voter of fixed accuracy) is
the target of a linear classifier over the terms, whose score is the result.

Lexicons and classifier learn from a bounded sample of labelled rows: the SAMPLE rows of either class with the smallest
id hash, out of the learning folds.  The sample is small enough to be broadcast, so texts are never shuffled.  The label
model's statistics cover all documents of the learning folds.  Terms are at most TERMS, voters fewer than 64.

Defined cases: null and empty texts have no terms and get the lowest score; repeated rows are scored alike; several
labels of one document count as the highest; a null toxic is no label; without labelled rows of both classes all scores
are zero; empty tables give an empty result; other columns are not inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlight.llm.common import remainder
from ledgerlight.llm.textual import NON_ALNUM, Words, buffers, slices, words_of
from ledgerlight.session import written

SAMPLE = 20_000
TERMS = 2048
LEXICONS = 24
EVIDENCE = 20.0
# Share of toxic documents among the sampled documents with a term.
PRECISION = 0.7
BEGINNINGS = (4, 5, 6)
ROUNDS = 8
LABEL_ACCURACY = 0.999
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
SLICE_BYTES = 1 << 20
# Writing patterns that vote beside the lexicons.
PATTERNS = (rb"[A-Z]{5,}", rb"[!?]{2,}", rb"\b(?i:you are|you're|du bist|tu es|eres)\b", rb"[A-Za-z]\*+[A-Za-z]")
# The last voter speaks for clean: no lexicon has a term in the text.
SILENCE = LEXICONS + len(PATTERNS)
VOTERS = SILENCE + 1


def parts(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """Words of bounded slices of a batch, with the row each slice begins at."""
    _, offsets = buffers(texts)
    for low, high in slices(offsets, SLICE_BYTES):
        yield low, words_of(texts.slice(low, high - low), NON_ALNUM, lower=True)


def spans(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, start, end and hash of all words, then of all word beginnings."""
    rows = words.rows()
    yield rows, words.start, words.end, words.hashes(0)
    for size in BEGINNINGS:
        at = np.flatnonzero(words.end - words.start >= size)
        start = words.start[at]
        yield rows[at], start, start + size, Words(words.data, start, start + size, words.first).hashes(1)


@dataclass
class Lexicon:
    """Term hashes in order, each term's voter, and a quick test on the low bits."""

    hashes: np.ndarray
    voter: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, term number) of a batch."""
        pairs = [np.zeros(0, np.int64)]
        for low, words in parts(texts):
            for rows, _, _, hashes in spans(words):
                at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
                term = np.minimum(np.searchsorted(self.hashes, hashes[at]), max(0, len(self.hashes) - 1))
                same = self.hashes[term] == hashes[at] if len(self.hashes) else np.zeros(0, bool)
                pairs.append((rows[at[same]] + low) * (TERMS + 1) + term[same])
        both = np.unique(np.concatenate(pairs))
        return both // (TERMS + 1), both % (TERMS + 1)

    def votes(self, texts: pa.Array, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """A bit for each voter that fires, row by row."""
        mask = np.zeros(len(texts), dtype=np.int64)
        np.bitwise_or.at(mask, row, np.int64(1) << self.voter[term].astype(np.int64))
        mask[mask == 0] = 1 << SILENCE
        for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            for k, pattern in enumerate(PATTERNS):
                if text and re.search(pattern, text):
                    mask[i] |= 1 << (LEXICONS + k)
        return mask


def sample_of(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The bounded sample (sample_id, toxic) and the number of labelled rows of each class in the learning folds."""
    known = (labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
             .groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("toxic").alias("toxic")))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    each = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("sample_id"), "sample_id").limit(SAMPLE) for c in (0, 1)]
    return each[0].union(each[1]), counts


def mine(sample_docs: DataFrame, sizes: dict[int, int]) -> Lexicon:
    """The terms with the strongest evidence, their stems dealt to the lexicons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch["toxic"]).astype(np.int64)
            for low, words in parts(batch["text"]):
                for rows, start, end, hashes in spans(words):
                    if not len(rows):
                        continue
                    order = np.lexsort((rows, hashes))
                    rows, start, end, hashes = rows[order], start[order], end[order], hashes[order]
                    once = np.ones(len(rows), dtype=bool)
                    once[1:] = (np.diff(hashes) != 0) | (np.diff(rows) != 0)
                    rows, start, end, hashes = rows[once], start[once], end[once], hashes[once]
                    opens = np.flatnonzero(np.concatenate([[True], np.diff(hashes) != 0]))
                    bad = np.add.reduceat(toxic[rows + low], opens)
                    many = np.diff(np.append(opens, len(rows)))
                    terms = [words.data[a:b].tobytes() for a, b in zip(start[opens], end[opens])]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[opens].view(np.int64)), pa.array(terms, pa.binary()), pa.array(bad), pa.array(many - bad)],
                                                     ["hash", "term", "bad", "good"])

    counted = sample_docs.mapInArrow(run, "hash bigint, term binary, bad bigint, good bigint").groupBy("hash").agg(
        F.min("term").alias("term"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = sizes[1] / (sizes[0] + sizes[1])
    n = F.col("bad") + F.col("good")
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (n * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0))
    best = (counted.where((F.col("bad") > 2) & (F.col("bad") > PRECISION * n)).withColumn("gain", gain).where(F.col("gain") >= EVIDENCE)
            .orderBy(F.desc("gain"), "hash").limit(TERMS).collect())
    stems: dict[bytes, int] = {}
    voter = [stems.setdefault(bytes(r.term)[:BEGINNINGS[0]], len(stems)) % LEXICONS for r in best]
    hashes = np.array([r.hash for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], np.array(voter, dtype=np.int64)[order])


def bits(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)


@dataclass
class LabelModel:
    """Prior, firing rates on toxic and clean documents, and the share of its weight that each voter keeps."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    keeps: np.ndarray

    def log_odds(self, mask: np.ndarray) -> np.ndarray:
        """A voter that doesn't fire abstains: it says nothing about the class."""
        return np.log(self.prior / (1 - self.prior)) + bits(mask) @ (np.log(self.toxic / self.clean) * self.keeps)

    @classmethod
    def of(cls, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> LabelModel:
        """From each class's weight, firing sums and joint firing sums."""
        rates = {c: (s + 0.1) / (n + 1.0) for c, (n, s, _) in sums.items()}
        total = sum(n for n, _, _ in sums.values())
        correlation = np.zeros((VOTERS, VOTERS))
        for c, (n, s, joint) in sums.items():
            mean = s / max(n, 1e-9)
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            correlation += np.clip((joint / max(n, 1e-9) - np.outer(mean, mean)) / np.outer(spread, spread), 0, 1) * (n / max(total, 1e-9))
        np.fill_diagonal(correlation, 0.0)
        correlation[correlation < 0.05] = 0.0
        prior = min(max(sums[1][0] / max(total, 1e-9), 1e-4), 0.5)
        return cls(prior, np.clip(rates[1], 1e-4, 1 - 1e-4), np.clip(rates[0], 1e-4, 1 - 1e-4), 1 / (1 + correlation.sum(axis=1)))


def fit_label_model(patterns: DataFrame, start: LabelModel) -> LabelModel:
    """Expectation maximisation over rows (mask, n); a round moves one small vector of sums per task."""
    model = start
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(2 * (1 + VOTERS + VOTERS * VOTERS))
            for batch in batches:
                mask, n = np.asarray(batch["mask"]), np.asarray(batch["n"]).astype(np.float64)
                fired, toxic = bits(mask), 1 / (1 + np.exp(-np.clip(model.log_odds(mask), -40, 40)))
                sums += np.concatenate([np.concatenate([[w.sum()], fired.T @ w, ((fired * w[:, None]).T @ fired).ravel()]) for w in (n * (1 - toxic), n * toxic)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["i", "x"])

        sums = np.zeros(2 * (1 + VOTERS + VOTERS * VOTERS))
        for r in patterns.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            sums[r.i] = r.x
        model = LabelModel.of({c: _unpacked(s) for c, s in enumerate(sums.reshape(2, -1))})
    return model


def _unpacked(s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    return s[0], s[1:1 + VOTERS], s[1 + VOTERS:].reshape(VOTERS, VOTERS)


def logistic(rows: np.ndarray, terms: np.ndarray, target: np.ndarray, weight: np.ndarray, n_terms: int, rounds: int = 12) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on present terms: Newton steps solved by conjugate gradients."""
    ridge = np.append(np.full(n_terms, 0.1), 0.0)

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[terms], len(target)) + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(terms, r[rows], n_terms), r.sum())

    def loss(theta: np.ndarray) -> float:
        z = forward(theta)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (ridge * theta * theta).sum())

    theta = np.zeros(n_terms + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(theta), -40, 40)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        rest = -(back(weight * (p - target)) + ridge * theta)
        scale = 1 / (back(curve) + ridge + 1e-9)
        step, rest_scaled = np.zeros_like(theta), rest * scale
        way, now = rest_scaled.copy(), rest @ rest_scaled
        for _ in range(60):
            bent = back(curve * forward(way)) + ridge * way
            length = now / max(way @ bent, 1e-12)
            step += length * way
            rest = rest - length * bent
            rest_scaled = rest * scale
            after = rest @ rest_scaled
            if after < 1e-10:
                break
            way, now = rest_scaled + after / now * way, after
        size, before = 1.0, loss(theta)
        while size > 1e-3 and loss(theta + size * step) > before:
            size /= 2
        theta = theta + size * step
        if np.abs(step).max() < 1e-4:
            break
    return theta[:-1], float(theta[-1])


@dataclass
class Scorer:
    """The trained classifier; small enough to travel with the tasks."""

    lexicon: Lexicon | None
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.lexicon is None:
            return np.zeros(len(texts))
        row, term = self.lexicon.found(texts)
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[term], len(texts)) + self.bias, -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    sample, counts = sample_of(labels)
    if not counts.get(0) or not counts.get(1):
        return Scorer(None, np.zeros(0), 0.0)
    sample = written(sample, "toxicity-sample")
    # At most two times SAMPLE rows of an id and a label: a proven bound.
    sample_docs = docs.join(F.broadcast(sample), docs["doc_id"] == sample["sample_id"]).select("text", "toxic")
    # Copies of one text are one witness.
    sample_docs = written(sample_docs.dropDuplicates(["text", "toxic"]), "toxicity-sample-texts")
    sizes = {c: 0 for c in counts} | {r.toxic: r["count"] for r in sample_docs.groupBy("toxic").count().collect()}
    if not all(sizes.values()):
        return Scorer(None, np.zeros(0), 0.0)
    lexicon = mine(sample_docs, sizes)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term = lexicon.found(batch["text"])
            bounds = np.searchsorted(row, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(term, pa.int32())), pa.array(lexicon.votes(batch["text"], row, term)), batch["toxic"].cast(pa.int32())],
                ["terms", "mask", "toxic"])

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term = lexicon.found(batch["text"])
            mask, n = np.unique(lexicon.votes(batch["text"], row, term), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(n)], ["mask", "n"])

    # A few small numbers for each sampled document.
    seen = sample_docs.mapInArrow(sampled, "terms array<int>, mask bigint, toxic int").toArrow()
    toxic, mask = np.asarray(seen["toxic"]).astype(np.float64), np.asarray(seen["mask"])
    lists = seen["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    rows, terms = np.repeat(np.arange(len(toxic)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten()).astype(np.int64)
    weight = np.where(toxic == 1, counts[1] / sizes[1], counts[0] / sizes[0])
    fired = bits(mask)
    start = LabelModel.of({c: (w.sum(), fired.T @ w, (fired * w[:, None]).T @ fired) for c, w in ((0, weight * (toxic == 0)), (1, weight * (toxic == 1)))})
    patterns = (docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).select("text").mapInArrow(voted, "mask bigint, n bigint")
                .groupBy("mask").agg(F.sum("n").alias("n")))
    model = fit_label_model(written(patterns, "toxicity-votes"), start)
    label = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * np.where(toxic == 1, 1, -1)
    target = 1 / (1 + np.exp(-np.clip(model.log_odds(mask) + label, -40, 40)))
    return Scorer(lexicon, *logistic(rows, terms, target, weight, len(lexicon.hashes)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(score, row): the last holds the columns of the input row."""
    scorer = train(docs.select("doc_id", "text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer.scores(batch["text"])), batch["row"]], ["score", "row"])

    whole = docs.select("text", F.struct("*").alias("row"))
    return whole.mapInArrow(run, StructType.fromDDL("score double").add(whole.schema["row"]))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold."""
    return scored(docs, labels).where(F.col("score") < threshold).select("row.*")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels).select(
        "row.doc_id", (remainder(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
