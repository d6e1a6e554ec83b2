"""Lexicon tables and their automaton, span edits of JSON, resolved spans."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import jsonspans, masking
from ledgerlight.functions.topic_catalog import NAMED_PATTERNS, POLICIES, TOPICS, Topic
from ledgerlight.operators import dlp
from ledgerlight.operators import lexicon as LX
from ledgerlight.sources import readers


def hits(spark, rows, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return sorted(tuple(r) for r in LX.table_hits(docs, "doc_id", "text", spark.createDataFrame(rows, LX.LEXICON)).collect())


def test_every_file_of_the_catalog_is_there():
    assert len(TOPICS) == 27 and len(POLICIES) == 28 and len({t.name for t in TOPICS + POLICIES + NAMED_PATTERNS}) == 55 + len(NAMED_PATTERNS)
    assert all(t.identifiers and t.actions and t.always for t in POLICIES)


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: p.name)
def test_policy_templates(policy):
    match = LX.Matcher(LX.topic_rows([policy]))
    found = lambda text: [h[1] for h in match.hits(text.lower())]
    assert found(f"Please, {policy.always[0].upper()} now") == ["always"]
    assert found(f"They {policy.actions[0]} the {policy.identifiers[0]} here") == ["conditional"]
    assert found(f"About {policy.identifiers[0]}. They {policy.actions[0]}") == []
    assert found("The weather is fine today.") == []
    if policy.exceptions:
        assert found(f"{policy.exceptions[0]}: {policy.actions[0]} the {policy.identifiers[0]}") == []


@pytest.mark.parametrize("name,hit,miss", [
    ("email", "write to A.b@example.com!", "a@b"), ("ipv4", "at 10.0.0.255.", "999.1.1.1000"), ("us_ssn", "id 123-45-6789", "1234-45-6789"),
    ("payment_card", "4111 1111 1111 1111", "4111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00", "D889"), ("web_address", "see https://example.org", "https:/x"),
    ("mac_address", "00:1A:2b:3c:4d:5e", "00:1A:2b"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b"), ("international_phone", "+65 6123 4567", "65 6123 4567"),
    ("singapore_nric", "S1234567D", "S123456D"), ("emirates_id", "784-1990-1234567-1", "785-1990-1234567-1")])
def test_named_patterns(name, hit, miss):
    match = LX.Matcher(LX.topic_rows([t for t in NAMED_PATTERNS if t.name == name]))
    assert [h[0] for h in match.hits(hit.lower())] == [name] and match.hits(miss.lower()) == []


def test_a_template_is_rows_and_severities_are_the_highest(spark):
    rows = [("new", "t", "always", "blue moon", "low"), ("new", "t", "always", "red moon", "high"), ("new", "t", "identifier", "cat", "medium"), ("new", "t", "action", "sing", "low"),
            ("other", "t", "phrase", r"\bx\d+\b", "medium"), ("quiet", "t", "identifier", "cat", "low"), ("quiet", "t", "exception", "cat", "low"), ("quiet", "t", "action", "sing", "low")]
    got = hits(spark, rows, "A Blue Moon", "blue moon, RED MOON", "The cat can sing", "concatenate sing", "cat! sing", "x12 y", "blue mooncake", None, "")
    assert got == [(0, "new", "always", "low"), (1, "new", "always", "high"), (2, "new", "conditional", "high"), (5, "other", "phrase", "medium")]


def test_edges_are_those_of_ascii_words():
    match = LX.Matcher([("c", "t", "always", "été", "low"), ("d", "t", "always", "(x)", "low"), ("e", "t", "always", "am", "low")])
    assert [h[0] for h in match.hits("un été")] == ["c"] and [h[0] for h in match.hits("f(x)g")] == ["d"]
    assert [h[0] for h in match.hits("éam am_ am")] == ["e"] and match.hits("am_ xam") == []


def test_category_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text('category_name: "base"\nidentifier_words:\n  - "Robot"\nadditional_block_words:\n  - "explode"\nexceptions:\n  - "toy"\n')
    (tmp_path / "heir.yaml").write_text('category_name: "heir"\ninherit_from: "base.yaml"\nalways_block_keywords:\n  - keyword: "Boom now"\n    severity: "medium"\nphrase_patterns:\n  - \'\\bpow\\b\'\nkeywords: []\n')
    table = LX.read_category_files(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "The robot may explode"), (2, "toy robot may explode"), (3, "BOOM NOW"), (4, "pow")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in LX.table_hits(docs, "doc_id", "text", table).collect())
    # Exceptions are not inherited.
    assert got == [(1, "base", "conditional", "high"), (1, "heir", "conditional", "high"), (2, "heir", "conditional", "high"), (3, "heir", "always", "medium"), (4, "heir", "phrase", "high")]


def test_a_large_lexicon_reads_a_text_once():
    draw = random.Random(1)
    topics = [Topic(f"c{i}", "low", always=tuple("".join(draw.choice("abcdefgh") for _ in range(9)) for _ in range(200))) for i in range(100)]
    match, text = LX.Matcher(LX.topic_rows(topics)), " ".join("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(100_000))
    started = time.perf_counter()
    match.hits(text + " " + topics[5].always[3])
    assert time.perf_counter() - started < 2


# ---- JSON ------------------------------------------------------------------
ODD = '{"a":1.10,"b":1e400,"c":{"x":1,"x":2},"big":12345678901234567890.123456789}'


def test_pruning_alters_nothing_else(spark):
    frame = spark.createDataFrame([(ODD,), (' {"a" : 1 , "b":[1,2] } ',), ("no json",), (None,), ("",)], "p string")
    pruned = lambda *paths: [r.p for r in frame.select(masking.payload_prune("p", paths).alias("p")).collect()]
    assert pruned("zz") == [ODD, ' {"a" : 1 , "b":[1,2] } ', "no json", None, ""]
    assert pruned("a", "c.x")[0] == '{"b":1e400,"c":{},"big":12345678901234567890.123456789}'
    assert pruned("b[0]", "a")[1] == ' {"b":[2] } '


def test_rewriting_a_model(spark):
    lines = ['{"body":{"model":"a","n":1.10},"id":1e400}', '{"id":1}', '{"body":{}}', '{"body":[1]}', '{"body":{"x":{"model":1}}}', "{", None]
    got = [r.line for r in readers.rewrite_model(spark.createDataFrame([(x,) for x in lines], "line string"), "line", 'n"').collect()]
    assert got == ['{"body":{"model":"n\\"","n":1.10},"id":1e400}', '{"id":1}', '{"body":{"model":"n\\""}}', '{"body":[1]}', '{"body":{"x":{"model":1},"model":"n\\""}}', "{", None]


def pruned_tree(node, routes):
    if isinstance(node, dict):
        return {k: pruned_tree(v, [r[1:] for r in routes if r and r[0] == k]) for k, v in node.items() if [k] not in routes}
    if isinstance(node, list):
        fits = lambda r, i: bool(r) and (r[0] is None or (r[0] == i and not isinstance(r[0], str)))
        return [pruned_tree(v, [r[1:] for r in routes if fits(r, i)]) for i, v in enumerate(node) if not any(len(r) == 1 and fits(r, i) for r in routes)]
    return node


def test_span_edits_equal_tree_edits():
    draw = random.Random(3)

    def tree(depth=0):
        kind = draw.random()
        if depth > 4 or kind < 0.35:
            return draw.choice([1, 2.5, "s", "a,b}", None, True, 'é"\\', -3])
        if kind < 0.7:
            return {draw.choice("abc"): tree(depth + 1) for _ in range(draw.randint(0, 4))}
        return [tree(depth + 1) for _ in range(draw.randint(0, 4))]

    for _ in range(5000):
        value, routes = tree(), [[draw.choice(["a", "b", "c", 0, 1, None]) for _ in range(draw.randint(1, 3))] for _ in range(draw.randint(1, 3))]
        text = json.dumps(value, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
        assert json.loads(jsonspans.without(text, routes)) == pruned_tree(value, routes), (text, routes)


@pytest.mark.parametrize("text", ['{"a":}', '{"a" 1}', "{,}", "[1,]", '{"a":1,}', "[1 2]", "01", '"a', '{"a":1}}', "", "tru", "[1,,2]", '{"a":"\n"}', "nul", "1.", "{1:2}", "]", "[}"])
def test_what_is_no_json_is_left_alone(text):
    assert jsonspans.edits(text, [["a"]], None) is None and jsonspans.without(text, [["a"]]) == text


def test_deeply_nested_and_long_payloads():
    deep = "[" * 50_000 + "]" * 50_000
    assert jsonspans.without(deep, [["a"]]) == deep
    wide = "{" + ",".join(f'"k{i}":{i}' for i in range(50_000)) + "}"
    assert jsonspans.without(wide, [["k7"]]) == wide.replace('"k7":7,', "", 1)


# ---- spans -----------------------------------------------------------------
def test_resolved_spans_equal_comparing_all():
    draw = random.Random(2)
    for _ in range(300):
        found = [("r", "T", "c", a, a + draw.randint(1, 30), draw.random() < 0.5) for a in (draw.randint(0, 200) for _ in range(draw.randint(0, 40)))]
        kept = []
        for span in sorted(found, key=lambda s: (s[3] - s[4], not s[5], s[3])):
            if all(span[4] <= other[3] or span[3] >= other[4] for other in kept):
                kept.append(span)
        assert dlp._resolve(found) == sorted(kept, key=lambda s: s[3])


def test_many_candidates_are_resolved_quickly():
    draw = random.Random(4)
    found = [("r", "T", "c", a, a + draw.randint(5, 40), False) for a in (draw.randrange(3_000_000) for _ in range(100_000))]
    started = time.perf_counter()
    assert len(dlp._resolve(found)) > 20_000
    assert time.perf_counter() - started < 1


def test_user_aggregate_with_partial_states(spark):
    from ledgerlight.functions.aggregates import Aggregate

    spread = Aggregate(("v",), "low bigint, high bigint", "width bigint", lambda s, rows: (min(int(rows.v.min()), s[0] if s else 1 << 60), max(int(rows.v.max()), s[1] if s else -1)),
                       lambda states: (min(s[0] for s in states), max(s[1] for s in states)), lambda s: (s[1] - s[0],))
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 7))).alias("key"), (F.col("id") * 37 % 5003).alias("v"))
    got = {r.key: r.width for r in spread.by(rows.repartition(7), "key").collect()}
    assert got == {r.key: r.w for r in rows.groupBy("key").agg((F.max("v") - F.min("v")).alias("w")).collect()} and None in got
    assert spread.by(rows.limit(0), "key").count() == 0
    assert dt.date.today()
