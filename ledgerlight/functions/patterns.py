"""Regular expressions that mean the same on every Java version.

The meaning of \\b for non-ASCII letters changed between Java releases, and the
catalogs come from two dialects: one whose words are ASCII, one whose words
are Unicode.  The two helpers below fix the meaning explicitly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASCII_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


_OPENING, _CLOSING = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _alternatives(group: str) -> list[str]:
    """Top-level alternatives of the inside of a group; one empty one where brackets or escapes make them unclear."""
    if re.search(r"\\[|()\[\]]|\[[^\]]*[|()][^\]]*\]", group):
        return [""]
    parts, depth = [""], 0
    for c in group:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _group_at(pattern: str, start: int) -> int:
    """Where the plain group that opens at *start* ends; -1 if it isn't one."""
    if not pattern.startswith("(?:", start) or re.search(r"\\[()]|\[[^\]]*[()][^\]]*\]", pattern):
        return -1
    depth = 0
    for i in range(start, len(pattern)):
        depth += (pattern[i] == "(") - (pattern[i] == ")")
        if not depth:
            return i + 1
    return -1


def _edge(before: str, after: str) -> str:
    """A word edge between two parts of a pattern: one-sided where the part beside it surely is a word character."""
    if re.match(r"[A-Za-z0-9_](?![?*{])", after):
        return _OPENING
    if re.search(r"(?<!\\)[A-Za-z0-9_]$", before) and not re.search(r"\(\?[a-z]*$", before):
        return _CLOSING
    end = _group_at(after, 0)
    if end > 0 and after[end:end + 1] not in ("?", "*", "{") and all(re.match(r"[A-Za-z0-9_](?![?*{])", p) for p in _alternatives(after[3:end - 1])):
        return _OPENING
    starts = [i for i in range(len(before)) if _group_at(before, i) == len(before)]
    if starts and all(re.search(r"(?<!\\)[A-Za-z0-9_]$|(?<!\\)[A-Za-z0-9_][A-Za-z0-9_]\?$", p) for p in _alternatives(before[starts[0] + 3:-1])):
        return _CLOSING
    return _ASCII_EDGE


def ascii_words(pattern: str, flags: str = "im") -> str:
    """Pattern whose word edges are ASCII."""
    pieces = pattern.split(r"\b")
    out = pieces[0]
    for i, piece in enumerate(pieces[1:]):
        out += _edge(pieces[i], piece) + piece
    return f"(?{flags}d)" + out


def unicode_words(pattern: str, flags: str = "i") -> str:
    """Pattern whose word edges, word characters and spaces are Unicode."""
    return f"(?{flags}dU)" + pattern


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words, longest first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


# More alternatives than these are no cheaper to look for than the pattern.
MOST_NEEDLES = 12


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match holds at least one, whatever its case; none where the pattern names none."""
    def of(items) -> set[str]:
        best: set[str] = set()
        run = ""
        for op, value in [*items, (None, None)]:
            found: set[str] = set()
            name = str(op)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            if name == "SUBPATTERN":
                found = of(value[3])
            elif name == "BRANCH":
                parts = [of(part) for part in value[1]]
                found = set().union(*parts) if all(parts) else set()
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                found = of(value[2])
            for some in ({run} if run else set(), found):
                if some and len(some) <= MOST_NEEDLES and (not best or (min(map(len, some)), -len(some)) > (min(map(len, best)), -len(best))):
                    best = some
            run = ""
        return best

    try:
        return tuple(sorted(of(_parser.parse(re.sub(r"^\(\?[A-Za-z]+\)", "", pattern)))))
    except re.error:
        return ()


# The few other characters that patterns without case take for ASCII letters.
TAKEN_FOR_ASCII = (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k"))


def folded(text: Column) -> Column:
    """The text as needles are written."""
    for c, letter in TAKEN_FOR_ASCII:
        text = F.replace(text, F.lit(c), F.lit(letter))
    return F.lower(text)


def fold(text: str) -> str:
    """folded of one text, for functions that look into single texts."""
    if not text.isascii():
        for c, letter in TAKEN_FOR_ASCII:
            text = text.replace(c, letter)
    return text.lower()


def found(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern matches; *low* is the folded text, in which its needles are looked for first."""
    hit = text.rlike(pattern)
    named = needles(pattern)
    if named:
        present = F.contains(low, F.lit(named[0]))
        for needle in named[1:]:
            present = present | F.contains(low, F.lit(needle))
        hit = present & hit
    return hit


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns.

    A filter would be moved below the projections that compute them and scan the texts there once more for every column named.
    """
    return rows.select(F.explode(F.when(condition, F.array(F.struct("*")))).alias("_row")).select("_row.*")


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """True when at least one pattern matches (evaluation stops at the first)."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def names_of_hits(text: Column, rules: Sequence[tuple[str, str]], low: Column | None = None) -> Column:
    """Names of the (name, pattern) rules that match, as an array; *low* is the folded text."""
    low = folded(text) if low is None else low
    return F.array_compact(F.array(*[F.when(found(text, low, p), F.lit(name)) for name, p in rules]))


def count_hits(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """How many of the patterns match; *low* is the folded text."""
    low, total = folded(text) if low is None else low, F.lit(0)
    for p in patterns:
        total = total + found(text, low, p).cast("int")
    return total


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")
