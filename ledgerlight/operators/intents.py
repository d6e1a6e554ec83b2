"""Intent, threat and complexity classes of a text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.checks import softmax3
from ledgerlight.functions.patterns import any_of, ascii_words
from ledgerlight.operators.ordered import ordinals, trailing_rows

# Intent words, base risks, modifiers.
INTENT_WORDS = {
    "read": ("show", "list", "get", "fetch", "display", "tell me", "what is", "how does", "how", "why", "describe", "find",
             "search", "read"),
    "write": ("create", "write", "update", "modify", "change", "set", "add", "insert", "save", "store", "post"),
    "delete": ("delete", "remove", "drop", "destroy", "wipe", "clear", "erase", "purge", "truncate"),
    "execute": ("run", "execute", "eval", "call", "invoke", "trigger", "launch", "start", "deploy", "install", "bash", "shell",
                "script", "cmd", "command"),
}
BASE_RISK = {"read": 10, "write": 30, "delete": 60, "execute": 80, "unknown": 20}
MODIFIERS = ((20, r"\b(?:system|config|env|database|admin)\b"), (15, r"\b(?:all|every|bulk)\b|\*"),
             (25, r"\b(?:production|prod|live)\b"))
ESCALATION = 20
PROBING = r"\b(?:show|reveal|print|dump|what\s+is)\b[\s\S]{0,35}\b(?:system\s+prompt|hidden\s+instructions?)\b"
JAILBREAK = r"\b(?:jailbreak|dan|unfiltered\s+mode|developer\s+mode)\b"


class Signal(NamedTuple):
    name: str
    pattern: str
    safe: float = 0.0
    suspicious: float = 0.0
    malicious: float = 0.0


# Weighted signals of the two threat models, and their word counts.
INJECTION_SIGNALS = (
    Signal("prompt_hierarchy_override",
           r"\b(?:ignore|disregard)\b[\s\S]{0,40}\b(?:previous|prior|all)\b[\s\S]{0,30}\b(?:instructions?|directives?|prompts?)\b",
           suspicious=0.9, malicious=1.4),
    Signal("system_prompt_exfiltration", r"\b(?:reveal|show|dump|print|expose)\b[\s\S]{0,30}\b(?:system\s+prompt|hidden\s+prompt)\b",
           suspicious=0.8, malicious=1.3),
    Signal("persona_override", r"\b(?:act\s+as|you\s+are\s+now)\b[\s\S]{0,40}\b(?:admin|developer|root|unrestricted|system)\b",
           suspicious=0.9, malicious=1.1),
    Signal("jailbreak_phrase", r"\b(?:jailbreak|do\s+anything\s+now|developer\s+mode|dan)\b", suspicious=0.7, malicious=1.2),
    Signal("benign_question", r"\b(?:what|how|why|when|where)\b[\s\S]{0,80}\?", safe=0.7),
    Signal("security_research_context", r"\b(?:security\s+testing|prompt\s+injection\s+detection|mitigation|threat\s+model)\b",
           safe=0.5),
)
INTENT_SIGNALS = (
    Signal("system_prompt_probing", PROBING, suspicious=1.2, malicious=1.1),
    Signal("policy_bypass", r"\b(?:bypass|disable|ignore)\b[\s\S]{0,25}\b(?:policy|rules?|guardrails?|filters?)\b",
           suspicious=0.8, malicious=1.2),
    Signal("explicit_jailbreak", JAILBREAK, suspicious=0.9, malicious=1.3),
    Signal("safety_audit_intent", r"\b(?:audit|secure|harden|mitigation|defense|threat)\b", safe=0.7),
)
IMPERATIVES = r"\b(?:ignore|reveal|bypass|override|forget|dump|print|execute|disable)\b"
QUESTIONS = r"\b(?:what|how|why|when|where|who)\b"
SAFETY_WORDS = r"\b(?:policy|compliance|secure|security|mitigation|audit|defense)\b"
TEMPERATURE = 1.6


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_words(pattern, "")))


def intent_scores(text: Column, words: dict[str, Sequence[str]] = INTENT_WORDS) -> dict[str, Column]:
    """Score per intent: every hit counts once, a hit among the first ten words twice."""
    lower = F.lower(text)
    tokens = F.regexp_extract_all(lower, F.lit("[a-z0-9*]+"), F.lit(0))
    first = F.slice(tokens, 1, 10)
    opening = F.array_join(first, " ")
    scores = {}
    for intent, terms in words.items():
        single = [t for t in terms if " " not in t]
        score = (F.size(F.filter(tokens, _one_of(single))) + F.size(F.filter(first, _one_of(single))))
        for phrase in (t for t in terms if " " in t):
            pattern = F.lit(f"(?<![a-z0-9]){phrase}(?![a-z0-9])")
            whole, start = F.regexp_count(lower, pattern), F.regexp_count(opening, pattern)
            score = score + start * 2 + F.greatest(F.lit(0), whole - start)
        scores[intent] = score
    return scores


def _one_of(words: Sequence[str]):
    return lambda token: token.isin(*words)


def winner(scores: dict[str, Column]) -> Column:
    """Intent with the single highest score; a tie or no hit is unknown."""
    names = list(scores)
    top = F.greatest(*scores.values())
    winners = sum(((scores[n] == top).cast("int") for n in names[1:]), (scores[names[0]] == top).cast("int"))
    choice = F.lit("unknown")
    for n in reversed(names):
        choice = F.when(scores[n] == top, F.lit(n)).otherwise(choice)
    return F.when((top > 0) & (winners == 1), choice).otherwise("unknown")


def _mapped(key: Column, table: dict[str, int]) -> Column:
    value = F.lit(None).cast("int")
    for name, number in table.items():
        value = F.when(key == name, F.lit(number)).otherwise(value)
    return value


def text_features(rows: DataFrame, text: str = "text", words: dict[str, Sequence[str]] = INTENT_WORDS) -> DataFrame:
    """Everything a class needs from the text, in place of the text.

    Adds the keyword intent with its confidence and base risk, the threat category with
    its confidence and the modifier points, and drops the text, so that later shuffles stay narrow.
    """
    lower = F.lower(F.col(text))
    for name, column in intent_scores(F.col(text), words).items():
        rows = rows.withColumn(f"score_{name}", column)
    known = {name: F.col(f"score_{name}") for name in words}
    total = sum((known[n] for n in list(known)[1:]), known[next(iter(known))])
    points = F.lit(0)
    for value, pattern in MODIFIERS:
        points = points + F.when(lower.rlike(ascii_words(pattern)), value).otherwise(0)
    threat = (F.when(lower.rlike(ascii_words(JAILBREAK)), "jailbreak_attempt")
              .when(lower.rlike(ascii_words(PROBING)), "system_prompt_probing").otherwise("none"))
    rows = threat_class(rows, text, INTENT_SIGNALS).withColumnRenamed("confidence", "threat_confidence").drop("label", "matched_signals")
    rows = rows.withColumn("keyword_intent", winner(known)).withColumn("threat", threat).withColumn("modifier_points", points)
    confidence = F.when(F.col("keyword_intent") == "unknown", 0.45).otherwise(
        F.least(F.lit(0.99), F.greatest(*known.values()) / F.greatest(F.lit(1), total)))
    return (rows.withColumn("confidence", F.round(confidence, 2)).withColumn("base_risk", _mapped(F.col("keyword_intent"), BASE_RISK))
            .drop(text, *[f"score_{n}" for n in words]))


def escalation(features: DataFrame) -> DataFrame:
    """User messages whose last three intents (itself included) rise strictly in base risk."""
    users = ordinals(features.where(F.col("role") == "user"), ["conv_id"], ["ts", "turn"], F.to_date("ts"))
    recent = trailing_rows(users, ["conv_id"], "ordinal", 3, {"_r": F.collect_list("base_risk")})
    a, b, c = (F.get("_r", F.lit(i)) for i in range(3))
    rising = (F.size("_r") == 3) & (a < b) & (b < c)
    return recent.withColumn("escalating", F.coalesce(rising, F.lit(False))).drop("_r", "ordinal")


def intent_class(features: DataFrame, escalating: str | None = None) -> DataFrame:
    """Final intent, risk and action from the text features and, where known, an escalation flag."""
    overruled = (F.col("threat") != "none") & ~F.col("keyword_intent").isin("write", "delete", "execute")
    intent = F.when(overruled, "unknown").otherwise(F.col("keyword_intent"))
    risk = F.when(overruled, BASE_RISK["unknown"]).otherwise(F.col("base_risk")) + F.col("modifier_points")
    if escalating:
        risk = risk + F.when(F.col(escalating), ESCALATION).otherwise(0)
    floor = F.when(F.col("threat") == "system_prompt_probing", 85).when(F.col("threat") == "jailbreak_attempt", 95).otherwise(0)
    score = F.least(F.lit(100), F.greatest(risk, floor))
    action = (F.when(F.col("threat") != "none", "sanitize").when(score >= 90, "block").when(score >= 60, "sanitize")
              .otherwise("allow"))
    confidence = F.when(overruled, F.greatest("confidence", "threat_confidence")).otherwise(F.col("confidence"))
    return (features.withColumn("intent", intent).withColumn("risk_score", score).withColumn("action", action)
            .withColumn("confidence", confidence).drop("threat_confidence"))


def threat_class(rows: DataFrame, text: str, signals: Sequence[Signal] = INJECTION_SIGNALS) -> DataFrame:
    """safe, suspicious or malicious by softmax over weighted signals, with evidence rules."""
    rows = rows.withColumn("_t", F.lower(F.trim(F.col(text))))
    t = F.col("_t")
    for s in signals:
        rows = rows.withColumn(f"_s_{s.name}", t.rlike(ascii_words(s.pattern)))
    imperatives, questions, safety = _count(t, IMPERATIVES), _count(t, QUESTIONS), _count(t, SAFETY_WORDS)

    def weighted(start: float, kind: str) -> Column:
        total = F.lit(start)
        for s in signals:
            if getattr(s, kind):
                total = total + F.when(F.col(f"_s_{s.name}"), F.lit(getattr(s, kind))).otherwise(0.0)
        return total

    rows = (rows.withColumn("_safe", weighted(0.65, "safe") + F.least(F.lit(1.5), questions * 0.3 + safety * 0.2))
            .withColumn("_susp", weighted(0.2, "suspicious") + F.least(F.lit(0.6), imperatives * 0.15)
                        + F.when(F.length(t) > 500, 0.2).otherwise(0.0))
            .withColumn("_mal", weighted(0.15, "malicious") + F.least(F.lit(0.4), imperatives * 0.1)))
    p_safe, p_susp, p_mal = softmax3(F.col("_safe"), F.col("_susp"), F.col("_mal"), TEMPERATURE)
    rows = rows.withColumn("_ps", p_safe).withColumn("_pu", p_susp).withColumn("_pm", p_mal)
    any_signal, jailbreak = F.lit(False), F.lit(False)
    for s in signals:
        any_signal = any_signal | F.col(f"_s_{s.name}")
        if "jailbreak" in s.name:
            jailbreak = jailbreak | F.col(f"_s_{s.name}")
    malicious = ((F.col("_pm") >= F.col("_pu")) & (F.col("_pm") >= F.col("_ps")) & (F.col("_pm") >= 0.62)
                 & ((F.col("_mal") >= F.col("_safe") + 0.8) | jailbreak))
    suspicious = ((F.col("_pu") >= F.col("_ps")) & (F.col("_pu") >= 0.6)
                  & ((F.col("_susp") >= F.col("_safe") + 0.7) | any_signal))
    label = F.when(malicious, "malicious").when(suspicious, "suspicious").otherwise("safe")
    confidence = (F.when(malicious, F.greatest(F.col("_pm"), F.lit(0.65)))
                  .when(suspicious, F.greatest(F.col("_pu"), F.lit(0.6))).otherwise(F.greatest(F.col("_ps"), F.lit(0.75))))
    bounded = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.51), confidence)), 2)
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_s_{s.name}"), F.lit(s.name)) for s in signals])), ",")
    out = rows.withColumn("label", label).withColumn("confidence", bounded).withColumn("matched_signals", names)
    return out.drop("_t", "_safe", "_susp", "_mal", "_ps", "_pu", "_pm", *[f"_s_{s.name}" for s in signals])


# ---- complexity ------------------------------------------------------------
# Weights, bounds and words of the seven dimensions.
COMPLEXITY_WEIGHTS = {"token_count": 0.10, "code": 0.30, "reasoning": 0.25, "technical": 0.25, "simple": 0.05,
                      "multi_step": 0.03, "questions": 0.02}
COMPLEXITY_BOUNDS = (0.15, 0.35, 0.60)
SHORT_TOKENS, LONG_TOKENS = 15, 400
CODE_WORDS = (
    "function", "class", "def", "const", "let", "var", "import", "export", "return", "async", "await", "try", "catch",
    "exception", "error", "debug", "api", "endpoint", "request", "response", "database", "sql", "query", "schema", "algorithm",
    "implement", "refactor", "optimize", "python", "javascript", "typescript", "java", "rust", "golang", "react", "vue",
    "angular", "node", "docker", "kubernetes", "git", "commit", "merge", "branch", "pull request")
REASONING_WORDS = (
    "step by step", "think through", "let's think", "reason through", "analyze this", "break down", "explain your reasoning",
    "show your work", "chain of thought", "think carefully", "consider all", "evaluate", "pros and cons",
    "compare and contrast", "weigh the options", "logical", "deduce", "infer", "conclude")
TECHNICAL_WORDS = (
    "architecture", "distributed", "scalable", "microservice", "machine learning", "neural network", "deep learning",
    "encryption", "authentication", "authorization", "performance", "latency", "throughput", "benchmark", "concurrency",
    "parallel", "threading", "memory", "cpu", "gpu", "optimization", "protocol", "tcp", "http", "grpc", "websocket",
    "container", "orchestration")
SIMPLE_WORDS = (
    "what is", "what's", "define", "definition of", "who is", "who was", "when did", "when was", "where is", "where was",
    "how many", "how much", "yes or no", "true or false", "simple", "brief", "short", "quick", "hello", "hi", "hey", "thanks",
    "thank you", "goodbye", "bye", "okay")
MULTI_STEP = r"\bfirst\b[\s\S]{0,200}\bthen\b|\bstep\s+[0-9]|(?:^|\n)\s*[0-9]+[.)]\s"


def complexity_tier(rows: DataFrame, text: str, reasoning_words: Sequence[str] = REASONING_WORDS,
                    simple_words: Sequence[str] = SIMPLE_WORDS) -> DataFrame:
    """Tier of a prompt from seven weighted dimensions between -1 and 1.

    A word group scores half for one hit and full for more; short prompts and
    simple words count negative.  Two reasoning markers force the top tier.
    """
    lower = F.lower(F.col(text))
    tokens = F.ceil(F.length(F.col(text)) / 4)

    def hits(words: Sequence[str]) -> Column:
        return F.regexp_count(lower, F.lit(ascii_words(rf"\b{any_of(words)}\b", "")))

    def graded(number: Column) -> Column:
        return F.when(number >= 2, 1.0).when(number == 1, 0.5).otherwise(0.0)

    rows = rows.withColumn("reasoning_markers", hits(reasoning_words))
    parts = {
        "token_count": F.when(tokens < SHORT_TOKENS, -1.0).when(tokens > LONG_TOKENS, 1.0).otherwise(0.0),
        "code": graded(hits(CODE_WORDS)), "reasoning": graded(F.col("reasoning_markers")),
        "technical": graded(hits(TECHNICAL_WORDS)), "simple": F.when(hits(simple_words) > 0, -1.0).otherwise(0.0),
        "multi_step": F.when(lower.rlike(ascii_words(MULTI_STEP)), 1.0).otherwise(0.0),
        "questions": F.when(F.regexp_count(lower, F.lit(r"\?")) > 1, 1.0).otherwise(0.0)}
    score = F.lit(0.0)
    for name, value in parts.items():
        score = score + value * F.lit(COMPLEXITY_WEIGHTS[name])
    rows = rows.withColumn("complexity", F.round(score, 6))
    low, middle, high = COMPLEXITY_BOUNDS
    return rows.withColumn("tier", F.when(F.col("reasoning_markers") >= 2, "REASONING").when(F.col("complexity") < low, "SIMPLE")
                           .when(F.col("complexity") < middle, "MEDIUM").when(F.col("complexity") < high, "COMPLEX")
                           .otherwise("REASONING"))
