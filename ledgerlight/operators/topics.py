"""Topic categories, competitor intent, code blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import textnorm as N
from ledgerlight.functions.patterns import any_of, count_hits, folded, found, unicode_words
from ledgerlight.functions.topic_catalog import TOPICS, Topic
from ledgerlight.operators.lexicon import SEVERITY_ORDER, category_hits, lexicon_table, topic_rows

def lexicon(spark: SparkSession, topics: Sequence[Topic] = TOPICS) -> DataFrame:
    """The catalog as a table (category, source, kind, term, severity)."""
    return lexicon_table(spark, topics)


def topic_category(docs: DataFrame, doc_id: str, text: str, topics: Sequence[Topic] = TOPICS) -> DataFrame:
    """One row per text and topic it hits, by one pass over the text."""
    return category_hits(docs, doc_id, text, topic_rows(topics))


def at_least(hits: DataFrame, severity: str, action: str = "BLOCK") -> DataFrame:
    """Hits at or above a severity, with the action to take."""
    kept = SEVERITY_ORDER[SEVERITY_ORDER.index(severity):]
    return hits.where(F.col("severity").isin(*kept)).withColumn("action", F.lit(action))


# ---- competitors -----------------------------------------------------------
# Thresholds, comparison words and the signals that tell a carrier from a place.
HIGH, MEDIUM, LOW = 0.70, 0.45, 0.30
DEFAULT_THRESHOLD = 0.65
COMPARISON_WORDS = ("better", "worse", "best", "vs", "versus", "compare", "alternative", "recommend", "ranked")
DOMAIN_WORDS = ("airline", "airlines", "carrier")
PLACE_SIGNALS = (
    r"\b(fly|flying|travel|traveling|going|visit|visiting|transit|layover|stopover)\b.{0,12}\b(to|from|via|in|at|through|into)\b",
    r"\bflight(s)?\b.{0,10}\b(to|from|via)\b", r"\bticket(s)?\b.{0,8}\b(to|for)\b", r"\bfare(s)?\b.{0,8}\b(to)\b",
    r"\bvisa\b", r"\bimmigration\b", r"\bcustoms\b", r"\bentry\b", r"\bairport\b", r"\bterminal\b", r"\bgate\b",
    r"\bdeparture\b", r"\barrival\b", r"\bitinerary\b", r"\bweather\b", r"\bhotel\b", r"\bcity\b",
    r"\bto\s+", r"\bfrom\s+", r"\bin\s+", r"\bat\s+", r"\bvia\s+")
CARRIER_SIGNALS = (
    r"\bairways?\b", r"\bairline\b", r"\bcarrier\b", r"\bcabin\s+crew\b", r"\bflight\s+attendant\b", r"\bbusiness\s+class\b",
    r"\bfirst\s+class\b", r"\beconomy\b", r"\blounge\b", r"\bbaggage\s+allowance\b", r"\bcheck[- ]?in\b", r"\bmiles\b",
    r"\bloyalty\b", r"\bstatus\b", r"\bfrequent\s+flyer\b", r"\bfleet\b", r"\baircraft\b", r"\bbetter\b", r"\bbest\b", r"\bgood\b",
    r"\bas\s+good\s+as\b", r"\bvs\.?\b", r"\bversus\b", r"\bcompare\b", r"\balternative\b", r"\bcompetitor\b", r"\bqmiles\b",
    r"\bprivilege\s+club\b")
OPERATIONAL_SIGNALS = (r"\bbaggage\s+allowance\b", r"\blounge\b", r"\bcheck[- ]?in\b", r"\brefund\b", r"\bpremium\s+lounge\b")
COMPARISON_SIGNALS = (r"\bbetter\b", r"\bbest\b", r"\bvs\.?\b", r"\bversus\b", r"\bcompare\b")
CARRIER_MARKER = r"\b(airways?|airline|carrier)\b"
PLACE_MARKER = r"\b(fly|travel|going|visit|layover|stopover|transit)\b.{0,12}\b(to|in|via|from)\b.{0,8}\b"


@dataclass(frozen=True)
class Signals:
    """Words and patterns that tell the meanings apart."""

    place: Sequence[str] = PLACE_SIGNALS
    carrier: Sequence[str] = CARRIER_SIGNALS
    operational: Sequence[str] = OPERATIONAL_SIGNALS
    comparison: Sequence[str] = COMPARISON_SIGNALS
    carrier_marker: str = CARRIER_MARKER
    place_marker: str = PLACE_MARKER


@dataclass(frozen=True)
class Competitors:
    names: dict[str, Sequence[str]] = field(default_factory=dict)
    comparison_words: Sequence[str] = COMPARISON_WORDS
    domain_words: Sequence[str] = DOMAIN_WORDS
    signals: Signals = field(default_factory=Signals)


def with_meaning(rows: DataFrame, text: str, signals: Signals = Signals()) -> DataFrame:
    """Add meaning (COMPETITOR or OTHER_MEANING) and its confidence for a mention in *text*."""
    t, low = F.col("_lower"), F.col("_low")
    rows = rows.withColumn("_lower", F.lower(F.col(text))).withColumn("_low", folded(F.col("_lower")))

    def uni(patterns: Sequence[str]) -> list[str]:
        return [unicode_words(p) for p in patterns]
    rows = (rows.withColumn("_place", count_hits(t, uni(signals.place), low)).withColumn("_carrier", count_hits(t, uni(signals.carrier), low))
            .withColumn("_operational", count_hits(t, uni(signals.operational), low))
            .withColumn("_compared", count_hits(t, uni(signals.comparison), low)))
    total = F.col("_place") + F.col("_carrier")
    place_share, carrier_share = F.col("_place") / total, F.col("_carrier") / total

    def scaled(share: Column) -> Column:
        return F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.4) * share)

    def verdict(meaning: str, confidence) -> Column:
        value = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(meaning).alias("m"), value.alias("c"))

    choice = (F.when(found(t, low, unicode_words(signals.carrier_marker)), verdict("COMPETITOR", 0.85))
              .when(found(t, low, unicode_words(signals.place_marker)), verdict("OTHER_MEANING", 0.85))
              .when((F.col("_compared") == 0) & (F.col("_operational") > 0), verdict("OTHER_MEANING", 0.85))
              .when(total == 0, verdict("OTHER_MEANING", 0.5))
              .when(place_share >= 0.6, verdict("OTHER_MEANING", scaled(place_share)))
              .when(carrier_share >= 0.6, verdict("COMPETITOR", scaled(carrier_share)))
              .otherwise(verdict("OTHER_MEANING", 0.5)))
    return (rows.withColumn("_v", choice).withColumn("meaning", F.col("_v.m")).withColumn("meaning_confidence", F.col("_v.c"))
            .drop("_v", "_place", "_carrier", "_operational", "_compared", "_lower", "_low"))


def competitor_intent(rows: DataFrame, text: str, config: Competitors, compatibility: bool = True) -> DataFrame:
    """Intent and confidence of a text with respect to competitors; unclear mentions do not count."""
    rows = rows.withColumn("_norm", N.normalize_leet(F.col(text), compatibility))
    norm = F.col("_norm")

    def word(token: str) -> Column:
        return norm.rlike(unicode_words(r"\b" + any_of([token]) + r"\b"))

    def some(words: Sequence[str]) -> Column:
        return norm.rlike(unicode_words(r"\b" + any_of(words) + r"\b")) if words else F.lit(False)

    found = F.array_distinct(F.array_compact(F.array(*[
        F.when(word(token), F.lit(name)) for name, aliases in config.names.items() for token in (name, *aliases)])))
    rows = with_meaning(rows.withColumn("_found", found).withColumn("_compares", some(config.comparison_words)), "_norm",
                        config.signals)
    mentioned = F.size("_found") > 0
    resolved = mentioned & (F.col("meaning") == "COMPETITOR") & (F.col("meaning_confidence") >= DEFAULT_THRESHOLD)
    ranking = ~mentioned & F.col("_compares") & some(config.domain_words)
    confidence = F.when(ranking, 0.65).when(resolved & F.col("_compares"), 0.75).when(resolved, 0.55).otherwise(0.0)
    intent = (F.when(ranking, "category_ranking").when(confidence >= HIGH, "competitor_comparison")
              .when(confidence >= MEDIUM, "possible_competitor_comparison").when(confidence >= LOW, "log_only").otherwise("other"))
    return (rows.withColumn("intent", intent).withColumn("confidence", confidence)
            .withColumn("competitors", F.when(resolved, F.array_join("_found", ",")).otherwise(F.lit("")))
            .drop("_norm", "_found", "_compares", "meaning", "meaning_confidence"))


# ---- code blocks -----------------------------------------------------------
def code_block_mask(text: Column, languages: Sequence[str], mask: str = "[CODE BLOCK REMOVED]") -> Column:
    """Mask the fenced code blocks of the given languages."""
    return F.regexp_replace(text, rf"(?i)```[ \t]*{any_of(languages)}[ \t]*\n[\s\S]*?```", mask)
