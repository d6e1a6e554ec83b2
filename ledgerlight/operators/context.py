"""Conversation guards: probing, split payloads, personas, velocity and their joint risk.

The input is a message table (conversation, turn, role, text, ts).  All windows
run on ordinals in bounded blocks, so one very long conversation is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.patterns import ascii_words, matches
from ledgerlight.operators.ordered import epoch_micros, ordinals, trailing_count, trailing_rows

# Windows, weights, bands and patterns.
PROBE_WINDOW, PAYLOAD_WINDOW, EARLY_MESSAGES = 10, 5, 5
VELOCITY_SECONDS, VELOCITY_LIMIT = 60, 10
PROBE_SILENCE_SECONDS = 30 * 60
WEIGHTS = {"high": 40, "medium": 20, "low": 5}
HIGH_PATTERNS = (
    r"\b(?:ignore|disregard)\b[\s\S]{0,40}\b(?:previous|prior|earlier|all)\b[\s\S]{0,30}\b(?:instructions?|directives?|prompts?)\b",
    r"\b(?:reveal|show|print|display|dump|expose)\b[\s\S]{0,30}\b(?:the\s+)?system\s+prompt\b",
    r"\b(?:jailbreak|do\s+anything\s+now|dan\s+(?:mode|prompt|jailbreak)|developer\s+mode)\b",
    r"(?:<!--|<script\b|<\?php\b)",
    r"\bprocess\.env\b|/etc/passwd|\.\./",
)
WARNING_PATTERNS = HIGH_PATTERNS + (
    r"\bact\s+as\b[\s\S]{0,40}\b(?:admin|developer|dan|unrestricted|root|superuser)\b",
    r"\byou\s+are\s+now\b[\s\S]{0,50}\b(?:admin|developer|dan|unrestricted|system|root|assistant)\b",
    r"(?:\n\s*\n|\\n\\n)\s*(?:Human|Assistant)\s*:",
    r"(?:>{5,}|-{10,})",
    r"\b(?:forget\s+everything|new\s+session|reset\s+context)\b",
)
PERSONA_PATTERN = r"\b(?:you\s+are|your\s+name\s+is|act\s+as|from\s+now\s+on)\b"
ACTIVATION_PATTERN = r"\b(?:now|remember|as\s+i\s+said|like\s+i\s+told\s+you)\b"


def _compiled(patterns: Sequence[str]) -> list[str]:
    return [ascii_words(p) for p in patterns]


def flagged(messages: DataFrame, warnings: Sequence[str] = WARNING_PATTERNS, persona: str = PERSONA_PATTERN,
            activation: str = ACTIVATION_PATTERN) -> DataFrame:
    """Everything the windows need from the text, as flags; the texts themselves are not shuffled."""
    return messages.select(
        "conv_id", "turn", "role", "ts", matches(F.col("text"), _compiled(warnings)).alias("warned"),
        F.col("text").rlike(ascii_words(persona)).alias("sets_persona"),
        F.col("text").rlike(ascii_words(activation)).alias("activates"))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with their ordinal inside the conversation."""
    return ordinals(messages, ["conv_id"], ["ts", "turn"], F.to_date("ts"))


def repeated_probing(flags: DataFrame) -> DataFrame:
    """Warnings among the last ten messages: two are medium, three or more high (needs numbered flags).

    More than 30 minutes of silence forget all earlier warnings, so only messages since the last such pause count.
    """
    before = trailing_rows(flags, ["conv_id"], "ordinal", 1, {"_before": F.max("ts")}, include_current=False)
    opens = epoch_micros("ts") - epoch_micros("_before") > PROBE_SILENCE_SECONDS * 1_000_000
    recent = trailing_rows(before.withColumn("_opens", opens), ["conv_id"], "ordinal", PROBE_WINDOW, {
        "_start": F.max(F.when(F.col("_opens"), F.col("ordinal"))),
        "_recent": F.collect_list(F.when(F.col("warned").isNotNull(), F.struct("ordinal", F.col("warned").cast("int").alias("warned"))))})
    counted = F.filter("_recent", lambda m: m["ordinal"] >= F.coalesce(F.col("_start"), F.lit(0)))
    probes = F.when(F.size(counted) > 0, F.aggregate(counted, F.lit(0).cast("bigint"), lambda n, m: n + m["warned"]))
    return recent.withColumn("probes", probes).drop("_before", "_opens", "_start", "_recent").withColumn(
        "probing", F.when(F.col("probes") >= 3, "high").when(F.col("probes") == 2, "medium"))


def payload_splitting(messages: DataFrame, high: Sequence[str] = HIGH_PATTERNS) -> DataFrame:
    """For user messages: some joined run of the last two to five user texts matches a high pattern."""
    users = ordinals(messages.where(F.col("role") == "user").select("conv_id", "turn", "ts", "text"), ["conv_id"], ["ts", "turn"], F.to_date("ts"))
    recent = trailing_rows(users, ["conv_id"], "ordinal", PAYLOAD_WINDOW, {"_recent": F.collect_list("text")})
    size = F.size("_recent")
    hit = F.lit(False)
    for n in range(2, PAYLOAD_WINDOW + 1):
        joined = F.array_join(F.slice("_recent", size - n + 1, F.lit(n)), " ")
        hit = hit | F.coalesce(F.when(size >= n, matches(joined, _compiled(high))), F.lit(False))
    return recent.withColumn("split_payload", hit).drop("_recent", "ordinal")


def persona_trigger(flags: DataFrame) -> DataFrame:
    """A persona among the first five earlier messages: high with an activation phrase now, else medium.

    Only the first ordinal at which a persona appears matters; it is one aggregate
    per conversation.
    """
    early = flags.where((F.col("ordinal") <= EARLY_MESSAGES) & F.col("sets_persona"))
    first = early.groupBy("conv_id").agg(F.min("ordinal").alias("_first"))
    established = F.coalesce(F.col("_first") < F.col("ordinal"), F.lit(False))
    return flags.join(first, "conv_id", "left").withColumn(
        "persona", F.when(established & F.col("activates"), "high").when(established, "medium")).drop("_first")


def velocity(messages: DataFrame, seconds: int = VELOCITY_SECONDS, limit: int = VELOCITY_LIMIT) -> DataFrame:
    counted = trailing_count(messages.select("conv_id", "turn", "ts"), ["conv_id"], "ts", "turn", seconds)
    return counted.select("conv_id", "turn", (F.col("recent") > limit).alias("velocity_spike"))


def context_risk(messages: DataFrame, warnings: Sequence[str] = WARNING_PATTERNS, high: Sequence[str] = HIGH_PATTERNS,
                 persona: str = PERSONA_PATTERN, activation: str = ACTIVATION_PATTERN,
                 seconds: int = VELOCITY_SECONDS, limit: int = VELOCITY_LIMIT) -> DataFrame:
    """Joint risk of every user message: the weights of its detections, at most 100."""
    flags = numbered(flagged(messages, warnings, persona, activation))
    rows = persona_trigger(repeated_probing(flags)).where(F.col("role") == "user")
    split = payload_splitting(messages, high).select("conv_id", "turn", "split_payload")
    joined = rows.join(split, ["conv_id", "turn"]).join(velocity(messages, seconds, limit), ["conv_id", "turn"])

    def weight(level: Column) -> Column:
        return F.when(level == "high", WEIGHTS["high"]).when(level == "medium", WEIGHTS["medium"]).otherwise(0)

    flag_high = F.when(F.col("split_payload"), 40).otherwise(0) + F.when(F.col("velocity_spike"), 40).otherwise(0)
    score = F.least(F.lit(100), flag_high + weight(F.col("probing")) + weight(F.col("persona")))
    any_high = (F.col("split_payload") | F.col("velocity_spike") | F.coalesce(F.col("probing") == "high", F.lit(False))
                | F.coalesce(F.col("persona") == "high", F.lit(False)))
    detections = F.array_join(F.array_compact(F.array(
        F.when(F.col("split_payload"), "payload_splitting"), F.when(F.col("probing").isNotNull(), "repeated_probing"),
        F.when(F.col("persona") == "high", "delayed_trigger").when(F.col("persona") == "medium", "persona_establishment"),
        F.when(F.col("velocity_spike"), "velocity_spike"))), ",")
    return joined.select(
        "conv_id", "turn", detections.alias("detections"), score.alias("risk_score"),
        F.when(score >= 70, "high").when((score >= 40) & any_high, "high").when(score >= 40, "medium")
        .otherwise("low").alias("risk"), F.when(score >= 40, "sanitize").otherwise("allow").alias("action"))


def dedupe_history(messages: DataFrame, arrival: str, keep: int) -> DataFrame:
    """First arrival of every (role, time, text); the last *keep* per conversation.

    Ranks above *keep* are cut before the shuffle, so a long conversation sends
    at most *keep* rows per task.
    """
    unique = messages.groupBy("conv_id", "role", "ts", "text").agg(F.min(arrival).alias(arrival))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("ts"), F.desc(arrival))
    return unique.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep).drop("_rank")


def last_query(messages: DataFrame) -> DataFrame:
    """Text of the last message of every conversation, as one partial aggregation."""
    return messages.groupBy("conv_id").agg(F.max_by("text", F.struct("ts", "turn")).alias("query"))
