"""Text normalisation before scanning.

Compatibility normalisation (NFKC), entities and embedded encodings have no
Spark expression, so each profile is one Arrow-batched function; everything
else stays a column expression.
"""

from __future__ import annotations

import base64
import html
import re
import unicodedata
from urllib.parse import unquote, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.patterns import occurrences

# Fixed values.
SCAN_SPLIT_WORDS = ("ignore", "system", "developer")
GATEWAY_SPLIT_WORDS = ("system", "ignore", "prompt", "instructions", "execute", "admin", "password", "token")
HOOK_SPLIT_WORDS = ("ignore", "previous", "instructions", "system", "prompt", "developer", "admin", "reveal", "bypass")
DENSITY_TERMS = ("ignore", "system", "developer", "assistant", "must", "never", "execute", "call tool", "password",
                 "secret", "exfiltrate", "override")
NAMED_ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
LEET_FROM, LEET_TO = "@403157", "aaoeist"
ZERO_WIDTH = "[\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]"
EXCERPT = 180

_ZERO_WIDTH = re.compile(ZERO_WIDTH)
_SPACES = re.compile(r"\s+")
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);")
_BASE64_WORD = re.compile(r"\b[A-Za-z0-9+/]{20,}={0,2}\b")
_HEX_WORD = re.compile(r"\b(?:0x)?[0-9a-fA-F]{24,}\b")
_GATEWAY_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{9,}(?![A-Za-z0-9+/=])")
_GATEWAY_HEX = re.compile(r"\b(?:0x[a-fA-F0-9]{7,}|[a-fA-F0-9]{7,})\b")
_HOOK_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{12,}(?![A-Za-z0-9+/=])")
_HOOK_HEX = re.compile(r"\b(?:0x)?[a-fA-F0-9]{16,}\b")
_URL_WORD = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~-]){6,}")


def _spaced(words, between: str) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(r"(?<!\w)" + between.join(w) + r"(?!\w)", re.I), w) for w in words]


_SCAN_SPLIT = _spaced(SCAN_SPLIT_WORDS, r"\s*")
_GATEWAY_SPLIT = _spaced(GATEWAY_SPLIT_WORDS, r"[\W_]*")
_HOOK_SPLIT = _spaced(HOOK_SPLIT_WORDS, r"[\W_]*")


def _unpack_base64(token: str) -> bytes | None:
    try:
        return base64.b64decode(token + "=" * (-len(token) % 4))
    except ValueError:
        return None


def _unpack_hex(token: str) -> bytes | None:
    body = token[2:] if token[:2].lower() == "0x" else token
    return bytes.fromhex(body) if len(body) % 2 == 0 else None


def _scan_base64(match: re.Match) -> str:
    token, raw = match[0], _unpack_base64(match[0])
    decoded = raw.decode("utf-8", "ignore") if raw else ""
    if not decoded or sum(map(str.isprintable, decoded)) < max(5, len(decoded) // 2):
        return token
    return f"{token} decoded_payload:{decoded}"


def _scan_hex(match: re.Match) -> str:
    raw = _unpack_hex(match[0])
    decoded = raw.decode("utf-8", "ignore") if raw else ""
    return f"{match[0]} decoded_payload:{decoded}" if decoded else match[0]


def scan_profile(text: str | None) -> str:
    out = unquote_plus(html.unescape(unicodedata.normalize("NFKC", text or "")))
    out = _ZERO_WIDTH.sub("", out)
    for pattern, _ in _SCAN_SPLIT:
        out = pattern.sub(lambda m: m[0].replace(" ", ""), out)
    out = _HEX_WORD.sub(_scan_hex, _BASE64_WORD.sub(_scan_base64, out))
    return _SPACES.sub(" ", out).strip()


def _entity(match: re.Match) -> str:
    body = match[1]
    if not body.startswith("#"):
        return NAMED_ENTITIES.get(body.lower(), match[0])
    try:
        return chr(int(body[2:], 16) if body[1] in "xX" else int(body[1:]))
    except (ValueError, OverflowError):
        return match[0]


def _printable(text: str) -> bool:
    return all(c in "\t\n\r" or (ord(c) >= 32 and ord(c) != 127) for c in text)


def _gateway_base64(match: re.Match) -> str:
    token = match[0]
    plain_word = token.isalpha() or re.fullmatch("[a-fA-F0-9]+", token)
    if len(token) % 4 or plain_word or (len(token) < 16 and not re.search("[+/=0-9]", token)):
        return token
    raw = _unpack_base64(token)
    if not raw or base64.b64encode(raw).decode().rstrip("=") != token.rstrip("="):
        return "[BASE64: ENCODED_BLOB]"
    try:
        decoded = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "[BASE64: ENCODED_BLOB]"
    return f"[BASE64: {_SPACES.sub(' ', decoded).strip()}]" if _printable(decoded) else "[BASE64: ENCODED_BLOB]"


def gateway_profile(text: str | None) -> str:
    out = unicodedata.normalize("NFKC", _ENTITY.sub(_entity, text or ""))
    out = re.sub("[\\s\u180e\u200b-\u200d\ufeff]+", " ", out).strip()
    for pattern, word in _GATEWAY_SPLIT:
        out = pattern.sub(word, out)
    return _GATEWAY_HEX.sub(lambda m: f"[HEX: {m[0]}]", _GATEWAY_BASE64.sub(_gateway_base64, out))


def _hook_base64(match: re.Match) -> str:
    token = match[0]
    raw = None if len(token) % 4 or token.isalpha() else _unpack_base64(token)
    try:
        decoded = raw.decode("utf-8") if raw else ""
    except UnicodeDecodeError:
        decoded = ""
    shown = sum(c.isprintable() or c.isspace() for c in decoded)
    return f"{token} [decoded:{decoded}]" if decoded and shown / len(decoded) >= 0.9 else token


def _hook_hex(match: re.Match) -> str:
    raw = _unpack_hex(match[0])
    try:
        decoded = raw.decode("utf-8") if raw else ""
    except UnicodeDecodeError:
        decoded = ""
    readable = decoded and all(ord(c) >= 32 or c.isspace() for c in decoded)
    return f"{match[0]} [HEX:{decoded}]" if readable else match[0]


def hook_profile(text: str | None) -> str:
    out = _ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", html.unescape(text or "")))
    out = _SPACES.sub(" ", out).strip()
    for pattern, word in _HOOK_SPLIT:
        out = pattern.sub(word, out)
    out = _URL_WORD.sub(lambda m: f"{m[0]} [URL:{unquote(m[0])}]" if "%" in m[0] else m[0], out)
    return _HOOK_HEX.sub(_hook_hex, _HOOK_BASE64.sub(_hook_base64, out))


def decoded_view(text: str | None) -> str:
    """NFKC text without control characters, with encoded runs replaced by what they contain."""
    out = unicodedata.normalize("NFKC", text or "")
    out = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", _ZERO_WIDTH.sub("", out))
    out = _SPACES.sub(" ", out).strip()
    out = _URL_WORD.sub(lambda m: f"[URL: {unquote(m[0])}]" if "%" in m[0] else m[0], out)
    return _HOOK_HEX.sub(_hook_hex, _GATEWAY_BASE64.sub(_gateway_base64, out))


def _profile(function):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return run


# Characters that compatibility normalisation and the profiles leave alone: visible ASCII, plain breaks, Latin letters
# with accents but those that are composed of others.
UNTOUCHED = "^[\\t\\n\\r -~\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e]*$"


def _guarded(profile, *signs: str):
    """A profile that only sees texts which show one of the signs; for all others it comes down to single spaces.

    Signs are what a profile may act on, so the guard changes no result, only the number of texts that leave the JVM.
    """
    @F.pandas_udf(T.StringType())
    def slow(texts: pd.Series) -> pd.Series:
        acting = texts.notna()
        return texts.where(~acting, texts[acting].map(profile)) if acting.any() else texts

    def normalised(text: Column | str) -> Column:
        column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        acts = ~column.rlike(UNTOUCHED)
        for sign in signs:
            acts = acts | column.rlike(sign)
        return F.coalesce(slow(F.when(acts, column)), collapse_spaces(column))

    return normalised


def _spelt(words, between: str) -> str:
    return "(?i)(?:" + "|".join(between.join(w) for w in words) + ")"


# The profiles join a word only where none ends before it, so most places inside words are passed at once.  Not for the few
# words of the scan profile, where looking back costs more than it saves.
_START = "(?<![A-Za-z0-9_])"

normalize_scan = _guarded(scan_profile, "[&%+]", "[A-Za-z0-9+/]{20}", _spelt(SCAN_SPLIT_WORDS, r"\s*"))
normalize_gateway = _guarded(gateway_profile, "&", "(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/=]{9})[A-Za-z]*[0-9+/=]", "[a-fA-F0-9]{7}",
                             _START + _spelt(GATEWAY_SPLIT_WORDS, r"[\W_]*"))
normalize_hook = _guarded(hook_profile, "[&%]", "(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/=]{12})[A-Za-z]*[0-9+/=]", "[a-fA-F0-9]{16}", _START + _spelt(HOOK_SPLIT_WORDS, r"[\W_]*"))
normalize_decoded = _profile(decoded_view)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_leet(text: Column, compatibility: bool = True) -> Column:
    """Lower case, leet digits to letters, single spaces."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), ZERO_WIDTH, "")
    base = nfkc(stripped) if compatibility else stripped
    return F.regexp_replace(F.translate(F.trim(F.lower(base)), LEET_FROM, LEET_TO), r"\s+", " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def instruction_density(text: Column) -> Column:
    """Term hits relative to the length of the (already normalised) text, at most 1."""
    lower = F.lower(text)
    hits = F.lit(0)
    for term in DENSITY_TERMS:
        # Counting measures the whole text twice, which only a text with the term needs.
        hits = hits + F.when(~F.contains(lower, F.lit(term)), 0).otherwise(occurrences(lower, term))
    words = F.when(F.trim(lower) == "", 0).otherwise(F.size(F.split(F.trim(lower), r"\s+")))
    return F.least(F.lit(1.0), hits / F.greatest(F.lit(8.0), words / F.lit(18.0)))


def excerpt(text: Column, limit: int = EXCERPT) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))
