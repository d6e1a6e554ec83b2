"""Sensitive data: spans, redaction, credential formats, high-entropy tokens.

Findings never carry the matched text.  Offsets count code points.
"""

from __future__ import annotations

import base64
import datetime as dt
import ipaddress
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import checks as K
from ledgerlight.functions.patterns import ascii_words, fold, needles
from ledgerlight.functions.rule_catalog import ASSIGNED_SECRETS, DLP_RULES, TOKEN_NEEDLES, TOKEN_SECRETS

# Scores of a finding, entropy threshold and shape of its candidates.
CREDENTIAL_SCORE, OTHER_SCORE = 90, 60
ENTROPY_BITS = 3.8
ENTROPY_TOKEN = r"[A-Za-z0-9+/_=-]{24,}"

SPAN = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("checked", T.BooleanType())])

_RULES = [(name, kind, category, re.compile(pattern), check, needles(pattern)) for name, kind, category, pattern, check in DLP_RULES]
_ENTROPY = re.compile(rf"\b{ENTROPY_TOKEN}\b")
_CREDENTIALS = [r for r in _RULES if r[2] == "credential" and r[4] is None]


# ---- validators of candidate matches (small per-candidate helpers) ----------
def _luhn(raw: str) -> bool:
    digits = [int(c) for c in raw if c.isdigit()]
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def _verhoeff(raw: str) -> bool:
    digits = [int(c) for c in raw if c.isdigit()]
    state = 0
    for i, d in enumerate(reversed(digits)):
        state = K.VERHOEFF_MULTIPLY[state][K.VERHOEFF_PERMUTE[i % 8][d]]
    return len(digits) == 12 and digits[0] >= 2 and state == 0


def _iban(raw: str) -> bool:
    code = re.sub(r"\s", "", raw).upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ip(raw: str) -> bool:
    try:
        return bool(ipaddress.ip_address(raw))
    except ValueError:
        return False


def _past(raw: str, today: dt.date) -> bool:
    for pattern in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%Y/%m/%d"):
        try:
            return dt.datetime.strptime(raw.split()[-1].lstrip(":="), pattern).date() <= today
        except ValueError:
            continue
    return False


def _holds_credential(raw: str) -> bool:
    try:
        data = bytes.fromhex(raw) if re.fullmatch("(?:[0-9a-fA-F]{2})+", raw) else base64.b64decode(raw + "=" * (-len(raw) % 4))
        decoded = data.decode("utf-8")
    except ValueError:
        return False
    low = fold(decoded)
    return any(regex.search(decoded) for _, _, _, regex, _, named in _CREDENTIALS if _present(named, low))


def _present(named: tuple[str, ...], low: str) -> bool:
    """Whether a folded text holds one of the needles of a rule, without which it has no match."""
    return not named or any(needle in low for needle in named)


def _bits(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _random_looking(token: str) -> bool:
    return (any(c.isalpha() for c in token) and any(c.isdigit() for c in token)
            and not re.fullmatch("[0-9a-fA-F]+", token) and _bits(token) >= ENTROPY_BITS)


def _candidates(text: str, today: dt.date) -> list[tuple]:
    valid = {"luhn": _luhn, "verhoeff": _verhoeff, "iban": _iban, "ip": _ip, "encoded": _holds_credential,
             "date": lambda raw: _past(raw, today), None: lambda raw: True}
    low = fold(text)
    found = [(name, kind, category, m.start(), m.end(), check is not None)
             for name, kind, category, regex, check, named in _RULES if _present(named, low)
             for m in regex.finditer(text) if valid[check](m[0])]
    found += [("high_entropy_secret", "HIGH_ENTROPY_SECRET", "credential", m.start(), m.end(), False)
              for m in _ENTROPY.finditer(text) if _random_looking(m[0])]
    return found


def _resolve(found: list[tuple]) -> list[tuple]:
    """Longest first, checked before unchecked, then leftmost; no overlaps.

    Kept spans mark their places, so a candidate looks at its own stretch only, however many are kept.  Spans are not empty.
    """
    if len(found) < 2:
        return list(found)
    kept, taken = [], bytearray(max(s[4] for s in found))
    for span in sorted(found, key=lambda s: (s[3] - s[4], not s[5], s[3])):
        start, end = span[3], span[4]
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            kept.append(span)
    return sorted(kept, key=lambda s: s[3])


def redact_text(text: str, today: dt.date) -> str:
    """Replace every resolved span of one text."""
    out, cursor = [], 0
    for _, kind, _, start, end, _ in _resolve(_candidates(text, today)):
        out += [text[cursor:start], f"[REDACTED:{kind}]"]
        cursor = end
    return "".join(out) + text[cursor:]


def span_finder(today: dt.date):
    """Arrow-batched function: text to its resolved spans."""
    @F.pandas_udf(T.ArrayType(SPAN))
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _resolve(_candidates(t, today)) if t else [])

    return spans


def dlp_findings(docs: DataFrame, doc_id: str, text: str, today: dt.date, stage: str = "input") -> DataFrame:
    """One finding row per resolved span."""
    spans = docs.select(doc_id, F.explode(span_finder(today)(text)).alias("s"))
    credential = F.col("s.category") == "credential"
    return spans.select(
        doc_id, F.col("s.rule_id").alias("rule_id"), F.col("s.category").alias("category"), F.lit(stage).alias("stage"),
        F.when(credential, "high").otherwise("medium").alias("risk"),
        F.when(credential, CREDENTIAL_SCORE).otherwise(OTHER_SCORE).alias("score"), F.lit("redact").alias("action"),
        F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.type").alias("type"))


def dlp_redact(docs: DataFrame, text: str, today: dt.date) -> DataFrame:
    """Add the redacted text and its detected types."""
    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, today) if t else t)

    found = F.array_distinct(F.regexp_extract_all("redacted", F.lit(r"\[REDACTED:([A-Z_]+)\]"), F.lit(1)))
    return docs.withColumn("redacted", redact(text)).withColumn("detected_types", found)


# ---- counts and tokens that need no span -----------------------------------
SIMPLE_TYPES = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
                ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
                ("card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}"))


def dlp_type_counts(docs: DataFrame, group: list[str], text: str) -> DataFrame:
    counted = docs.groupBy(*group).agg(*[
        F.sum(F.regexp_count(text, F.lit(pattern))).cast("bigint").alias(name) for name, pattern in SIMPLE_TYPES])
    return counted


def high_entropy_tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Tokens of at least 24 characters that look random; the token itself is not returned."""
    tokens = docs.select(doc_id, F.explode(F.regexp_extract_all(text, F.lit(ENTROPY_TOKEN), F.lit(0))).alias("_token"))
    shaped = tokens.where(F.col("_token").rlike("[A-Za-z]") & F.col("_token").rlike("[0-9]")
                          & ~F.col("_token").rlike("^[A-Fa-f0-9]+$"))
    scored = shaped.select(doc_id, F.length("_token").alias("token_length"), K.entropy(F.col("_token")).alias("bits"))
    return scored.where(F.col("bits") >= ENTROPY_BITS)


# ---- credential formats ----------------------------------------------------
_ASSIGN = (r"(?:{names})(?:[0-9a-z\-_\t .]{{0,20}})(?:[\s|']|[\s|\"]){{0,3}}(?:=|>|:{{1,3}}=|\|\||<=|=>|:|\?=)"
           r"(?:'|\"|\s|=|\x60){{0,5}}(?:{token})(?:['\"\n\r\s\x60;]|$)")


def secret_rules() -> list[tuple[str, str]]:
    """(detector, pattern) for all credential formats, in an engine-neutral dialect."""
    assigned = [(name, "(?i)" + _ASSIGN.format(names=names, token=token)) for name, names, token in ASSIGNED_SECRETS]
    tokens = [(name, ("(?i)" if fold else "") + pattern) for name, fold, pattern in TOKEN_SECRETS]
    return assigned + tokens


def secret_catalog(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Detectors that match a text, one row per text and detector.

    A pattern is only tried where the name of its service, or the opening of its token, occurs.
    """
    candidates = docs.select(doc_id, F.col(text).alias("_text"), F.lower(F.col(text)).alias("_lower"))
    body = F.col("_text")
    hits = []
    for service, names, token in ASSIGNED_SECRETS:
        named = F.lit(False)
        for name in names.split("|"):
            named = named | F.contains("_lower", F.lit(name))
        pattern = ascii_words(_ASSIGN.format(names=names, token=token), "i")
        hits.append(F.when(named & body.rlike(pattern), F.lit(service)))
    for service, fold, token in TOKEN_SECRETS:
        present = F.lit(False)
        for needle in TOKEN_NEEDLES[service]:
            present = present | F.contains("_lower", F.lit(needle))
        hits.append(F.when(present & body.rlike(ascii_words(token, "i" if fold else "")), F.lit(service)))
    return candidates.select(doc_id, F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("detector"))
