"""Topic lexicons as tables, matched by one multi-pattern automaton.

A lexicon is a table (category, source, kind, term, severity); a new category or template is new rows and no code.  Its
plain terms, of all categories together, become one Aho-Corasick automaton, so a text is read once however many terms there
are.  Workers build it once for each lexicon they meet.  A match counts at ASCII word edges, where the term itself begins or
ends with a word character.  Patterns (kinds phrase and pattern) are regular expressions over the whole text.

A text hits a category by, in this order: an always term (always), an identifier and an action in one sentence without any
exception in it (conditional), a pattern (phrase).  The severity of an always hit is the highest of its terms, that of other
hits the highest of the category.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.topic_catalog import Topic

SENTENCE_END = r"[.!?\n]+"
SEVERITY_ORDER = ("low", "medium", "high")
LEXICON = "category string, source string, kind string, term string, severity string"
# Rows of a lexicon: it is configuration that every worker holds.
MAX_ROWS = 1_000_000
KINDS = ("identifier", "action", "always", "phrase", "exception")
WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
IDENTIFIER, ACTION, EXCEPTION = range(3)

Row = tuple[str, str, str, str, str]


def topic_rows(topics: Sequence[Topic]) -> tuple[Row, ...]:
    """The rows (category, source, kind, term, severity) of topics stated in code."""
    return tuple((t.name, t.source, kind, term, t.severity) for t in topics
                 for kind, terms in zip(KINDS, (t.identifiers, t.actions, t.always, t.phrases, t.exceptions)) for term in terms)


def lexicon_table(spark: SparkSession, topics: Sequence[Topic]) -> DataFrame:
    return spark.createDataFrame(topic_rows(topics), LEXICON)


def read_category_files(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon from a folder of category files (YAML): category_name, default severity, identifier_words,
    additional_block_words, always_block_keywords and keywords with severities, phrase_patterns, exceptions, inherit_from.

    One small file is one category; a file that inherits takes over the identifiers and actions of the other.  Needs a YAML
    library on the workers.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.yaml").select("value", F.col("_metadata.file_name").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for text, file in zip(batch["value"].to_pylist(), batch["file"].to_pylist()):
                found = yaml.safe_load(text)
                found = found if isinstance(found, dict) else {}
                name = str(found.get("category_name") or file.rsplit(".", 1)[0])
                usual = str(found.get("severity") or "high").lower()
                plain = lambda key: [(str(x), usual) for x in found.get(key) or []]  # noqa: E731, B023
                rated = lambda key: [(str(x["keyword"]), str(x.get("severity") or usual).lower()) for x in found.get(key) or []]  # noqa: E731, B023
                parts = {"identifier": plain("identifier_words"), "action": plain("additional_block_words"), "always": rated("always_block_keywords") + rated("keywords"),
                         "phrase": plain("phrase_patterns"), "exception": plain("exceptions"), "inherits": [(str(found["inherit_from"]).removesuffix(".yaml"), usual)] if found.get("inherit_from") else []}
                rows += [(name, file, kind, term if kind == "phrase" else term.lower(), severity) for kind, terms in parts.items() for term, severity in terms]
            columns = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["category", "source", "kind", "term", "severity"])

    read = files.mapInArrow(run, LEXICON)
    heirs = read.where("kind = 'inherits'").select("category", "source", F.col("term").alias("parent"))
    lent = read.where("kind IN ('identifier', 'action')").select(F.col("category").alias("parent"), "kind", "term", "severity")
    return read.where("kind != 'inherits'").unionByName(heirs.join(lent, "parent").select("category", "source", "kind", "term", "severity")).distinct()


class Matcher:
    """The automaton of a lexicon and the state of one text."""

    def __init__(self, rows: Sequence[Row]):
        import ahocorasick

        self.severity: dict[str, str] = {}
        self.terms: list[tuple[int, bool, bool, str, str, str]] = []
        self.phrases: dict[str, list[re.Pattern]] = {}
        by_text: dict[str, list[int]] = {}
        for category, _, kind, term, severity in rows:
            self.severity[category] = max(self.severity.get(category, severity), severity, key=SEVERITY_ORDER.index)
            if kind in ("phrase", "pattern"):
                self.phrases.setdefault(category, []).append(re.compile(term, re.ASCII))
            elif term:
                by_text.setdefault(term, []).append(len(self.terms))
                self.terms.append((len(term), term[0] in WORD, term[-1] in WORD, category, kind, severity))
        self.automaton = ahocorasick.Automaton()
        for text, numbers in by_text.items():
            self.automaton.add_word(text, tuple(numbers))
        self.automaton.make_automaton()
        self.order = {category: i for i, category in enumerate(self.severity)}

    def hits(self, text: str) -> list[tuple[str, str, str]]:
        """(category, kind, severity) of every category that a lower-case text hits, in lexicon order."""
        always: dict[str, str] = {}
        places: dict[str, tuple[list, list, list]] = {}
        terms, last = self.terms, len(text) - 1
        for end, numbers in self.automaton.iter(text) if self.terms else ():
            for number in numbers:
                size, opens, closes, category, kind, severity = terms[number]
                start = end - size + 1
                if (opens and start and text[start - 1] in WORD) or (closes and end < last and text[end + 1] in WORD):
                    continue
                if kind == "always":
                    always[category] = max(always.get(category, severity), severity, key=SEVERITY_ORDER.index)
                else:
                    spots = places.get(category)
                    if spots is None:
                        spots = places[category] = ([], [], [])
                    spots[IDENTIFIER if kind == "identifier" else ACTION if kind == "action" else EXCEPTION].append(start)
        found = {category: ("always", severity) for category, severity in always.items()}
        ends: list[int] | None = None
        for category, spots in places.items():
            if category in found or not spots[IDENTIFIER] or not spots[ACTION]:
                continue
            if ends is None:
                ends = [m.start() for m in re.finditer(SENTENCE_END, text)]
            named, acted, excused = ({bisect_right(ends, x) for x in s} for s in spots)
            if (named & acted) - excused:
                found[category] = ("conditional", self.severity[category])
        for category, patterns in self.phrases.items():
            if category not in found and any(p.search(text) for p in patterns):
                found[category] = ("phrase", self.severity[category])
        return [(category, *found[category]) for category in sorted(found, key=self.order.get)]


@lru_cache(maxsize=4)
def matcher(rows: tuple[Row, ...]) -> Matcher:
    return Matcher(rows)


def category_hits(docs: DataFrame, doc_id: str, text: str, rows: Sequence[Row]) -> DataFrame:
    """(doc_id, category, kind, severity): one row per text and category it hits."""
    rows = tuple(tuple(r) for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(rows)
        for batch in batches:
            at, found = [], []
            for i, lower in enumerate(batch["text"].to_pylist()):
                hits = match.hits(lower) if lower else ()
                at += [i] * len(hits)
                found += hits
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), *(pa.array(list(c), pa.string()) for c in columns)], [doc_id, "category", "kind", "severity"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.lower(F.col(text)).alias("text")).mapInArrow(run, f"`{doc_id}` {kind}, category string, kind string, severity string")


def table_hits(docs: DataFrame, doc_id: str, text: str, lexicon: DataFrame) -> DataFrame:
    """category_hits by the rows of a lexicon table; the table is configuration, and its size is checked."""
    rows = lexicon.select("category", "source", "kind", "term", "severity").orderBy("category", "kind", "term", "severity").limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a lexicon has at most {MAX_ROWS} rows")
    return category_hits(docs, doc_id, text, [tuple(r) for r in rows])
