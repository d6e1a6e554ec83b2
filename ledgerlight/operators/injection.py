"""Prompt injection: rule scans over several views of a text, and fuzzy phrases."""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import textnorm as N
from ledgerlight.functions.patterns import ascii_words, folded, found
from ledgerlight.functions.rule_catalog import INJECTION_RULES, InjectionRule

# Scan chunks, bands, phrase parts.
CHUNK, OVERLAP = 16_384, 512
SCAN_BANDS = (70, 40)
HOOK_BANDS = (70, 35)
VERBS = ("Ignore", "Disregard", "Skip", "Forget", "Neglect", "Overlook", "Omit", "Bypass", "Pay no attention to",
         "Do not follow", "Do not obey")
ADJECTIVES = ("", "prior", "previous", "preceding", "above", "foregoing", "earlier", "initial")
PREPOSITIONS = ("", "and start over", "and start anew", "and begin afresh", "and start from scratch")
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3}


def chunks_of(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Overlapping chunks of the whole text."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))


def matched_rules(docs: DataFrame, doc_id: str, views: Column, rules: Sequence[InjectionRule]) -> DataFrame:
    """One row per matching rule, chunk and view (a rule may repeat).

    Views and chunks are exploded, so a very long text is scanned piece by piece;
    the rule tests are literal expressions in one projection.
    """
    def hit(rule: InjectionRule) -> Column:
        return F.when(found(F.col("_chunk"), F.col("_low"), ascii_words(rule.pattern)), F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"),
            F.lit(rule.severity).alias("severity"), F.lit(rule.weight).alias("weight")))

    pieces = docs.select(doc_id, F.explode(F.array_distinct(views)).alias("_view")).select(
        doc_id, F.explode(chunks_of(F.col("_view"))).alias("_chunk")).withColumn("_low", folded(F.col("_chunk")))
    hits = F.array_compact(F.array(*[hit(r) for r in rules]))
    return pieces.select(doc_id, F.explode(hits).alias("r")).select(doc_id, "r.*")


def four_views(text: Column) -> Column:
    """Raw text, gateway normal form, canonical form, decoded form."""
    return F.array(text, N.normalize_gateway(text), N.collapse_spaces(N.nfkc(text)), N.normalize_decoded(text))


def raw_view(text: Column) -> Column:
    return F.array(text)


def hook_views(text: Column) -> Column:
    """Raw text and the hook's normal form, in which split words are joined and encoded runs decoded."""
    return F.array(text, N.normalize_hook(text))


def _rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def score_rules(matches: DataFrame, doc_id: str, bands: tuple[int, int]) -> DataFrame:
    """Highest weight plus ten per further category, at most 100."""
    # The sets hold at most one entry per catalog rule, so one shuffle with partial aggregation is enough.
    totals = matches.groupBy(doc_id).agg(
        F.max("weight").alias("_weight"), F.size(F.collect_set("category")).cast("bigint").alias("categories"),
        F.size(F.collect_set("rule_id")).cast("bigint").alias("rules"), F.max(_rank(F.col("severity"))).alias("_rank"))
    score = F.least(F.lit(100), F.col("_weight") + (F.col("categories") - 1) * 10).cast("int")
    high, medium = bands
    risk = F.when(F.col("score") >= high, "high").when(F.col("score") >= medium, "medium").otherwise("low")
    return totals.withColumn("score", score).withColumn("risk", risk).drop("_weight")


def injection_rules(docs: DataFrame, doc_id: str, views: Column,
                    rules: Sequence[InjectionRule] = INJECTION_RULES) -> DataFrame:
    return score_rules(matched_rules(docs, doc_id, views, rules), doc_id, SCAN_BANDS).drop("_rank")


def injection_hook(docs: DataFrame, doc_id: str, views: Column,
                   rules: Sequence[InjectionRule] = INJECTION_RULES) -> DataFrame:
    """Hook variant: the highest severity of a rule also decides, and a confidence is given."""
    scored = score_rules(matched_rules(docs, doc_id, views, rules), doc_id, HOOK_BANDS)
    risk = (F.when((F.col("score") >= HOOK_BANDS[0]) | (F.col("_rank") == 3), "high")
            .when((F.col("score") >= HOOK_BANDS[1]) | (F.col("_rank") == 2), "medium").otherwise("low"))
    confidence = F.bround(F.least(F.lit(0.99), F.lit(0.55) + F.col("score") / 200.0), 2)
    return scored.withColumn("risk", risk).withColumn("confidence", confidence).withColumn(
        "action", F.when(F.col("risk") == "low", "allow").otherwise("sanitize")).drop("_rank")


# ---- fuzzy phrases ---------------------------------------------------------
def phrases() -> list[str]:
    """Every verb, adjective and ending with more than two words."""
    combined = (" ".join(filter(None, parts)).lower() for parts in product(VERBS, ADJECTIVES, PREPOSITIONS))
    return [p for p in combined if len(p.split()) > 2]


# Characters laid end to end at a time, and by how many places the windows of a block are shifted at most.
BATCH_CHARS, SHIFT = 1 << 18, 8


class _Texts:
    """A batch of texts laid end to end, so that all their windows are tested by vector operations.

    Letters are numbered; number 0 are the characters that no phrase has, the breaks behind the texts among them.
    """

    def __init__(self, texts: Sequence[str]):
        self.text = "\0".join(texts) + "\0"
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        breaks = codes == 0
        self.breaks = np.concatenate(([0], np.cumsum(breaks, dtype=np.int32)))
        self.owner = self.breaks[:-1]
        self.number = {c: i for i, c in enumerate(sorted({x for p in phrases() for x in p}), 1)}
        lookup = np.zeros(max(map(ord, self.number)) + 1, dtype=np.uint8)
        for c, i in self.number.items():
            lookup[ord(c)] = i
        padding = np.zeros(max(map(len, phrases())) + 2 * SHIFT, dtype=np.uint8)
        self.size = len(codes)
        self.letters = np.concatenate((np.where(codes < len(lookup), lookup[np.minimum(codes, len(lookup) - 1)], 0).astype(np.uint8), padding))
        self.seen = {i: np.concatenate(([0], np.cumsum(self.letters == i, dtype=np.int32))) for i in self.number.values()}
        self.counted: tuple[int, dict[int, np.ndarray]] = (0, {})

    def _block_counts(self, length: int) -> dict[int, np.ndarray]:
        """How often every letter occurs in each block of *length* (all phrases of one length ask for the same)."""
        if self.counted[0] != length:
            ends = slice(length, self.size + length, SHIFT + 1)
            self.counted = (length, {i: (seen[ends] - seen[:self.size:SHIFT + 1]).astype(np.uint8) for i, seen in self.seen.items()})
        return self.counted[1]

    def _common(self, starts: np.ndarray, length: int, phrase: str) -> np.ndarray:
        """Longest common subsequence of the phrase and each stretch of *length*: all together, one bit vector each."""
        table = np.zeros(len(self.number) + 1, dtype=np.uint64)
        for c in set(phrase):
            table[self.number[c]] = sum(1 << i for i, x in enumerate(phrase) if x == c)
        state = np.full(len(starts), np.uint64(2**64 - 1))
        for offset in range(length):
            used = state & table[self.letters[starts + offset]]
            state = (state + used) | (state - used)
        return np.bitwise_count(~state & np.uint64((1 << len(phrase)) - 1))

    def windows_within_reach(self, phrase: str, threshold: float) -> np.ndarray:
        """Starts of the windows that two upper bounds of the ratio do not rule out.

        The ratio counts letters matched in order.  It cannot exceed the overlap
        of the letter multisets, nor the longest common subsequence.  Both are
        first taken for blocks, each of which holds some consecutive windows
        whole: what a block does not reach, none of its windows does.
        """
        size, need = len(phrase), threshold * len(phrase)
        counts = self._block_counts(size + SHIFT)
        overlap = np.zeros(-(-self.size // (SHIFT + 1)), dtype=np.uint8)
        for c in set(phrase):
            overlap += np.minimum(counts[self.number[c]], np.uint8(phrase.count(c)))
        blocks = np.flatnonzero(overlap > need) * (SHIFT + 1)
        blocks = blocks[self._common(blocks, size + SHIFT, phrase) > need]
        starts = (blocks[:, None] + np.arange(SHIFT + 1)).ravel()
        starts = starts[starts + size <= self.size]
        starts = starts[self.breaks[starts + size] == self.breaks[starts]]
        return starts[self._common(starts, size, phrase) > need]


def _similar(texts: Sequence[str], threshold: float) -> np.ndarray:
    similar = np.zeros(len(texts), dtype=bool)
    lower = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lower])
    known, low = sorted(phrases(), key=len), 0
    while low < len(lower):
        # A text longer than a batch is one of its own.
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BATCH_CHARS, "right")))
        batch = _Texts(lower[low:high])
        for phrase in known:
            matcher = difflib.SequenceMatcher(None, b=phrase)
            for start in batch.windows_within_reach(phrase, threshold):
                owner = low + batch.owner[start]
                if not similar[owner]:
                    matcher.set_seq1(batch.text[start:start + len(phrase)])
                    similar[owner] = matcher.ratio() > threshold
        low = high
    return similar


def fuzzy_injection(docs: DataFrame, doc_id: str, text: str, threshold: float = 0.7) -> DataFrame:
    """Flag of every text: some stretch of it is similar to an attack phrase."""
    @F.pandas_udf(T.BooleanType())
    def similar(texts: pd.Series) -> pd.Series:
        # A NUL would be taken for the end of a text; no phrase contains one.
        cleaned = [(t or "").replace("\0", " ") for t in texts]
        return pd.Series(_similar(cleaned, threshold))

    return docs.select(doc_id, similar(text).alias("similar"))


def nearest_phrase(text: Column) -> Column:
    """JVM-side companion: smallest edit distance of the whole text to a phrase."""
    return F.array_min(F.transform(F.array(*[F.lit(p) for p in phrases()]), lambda p: F.levenshtein(F.lower(text), p)))
