"""Rows that caps, prefilters and joins once dropped."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import masking as M
from ledgerlight.operators import dlp, guardrails, ordered, policies, quantiles
from ledgerlight.session import shared_dir


def test_chains_and_cycles_of_any_length(spark):
    chain = [(f"p{i:03d}", f"p{i - 1:03d}" if i else None) for i in range(100)]
    cycle = [(f"c{i:03d}", f"c{(i + 1) % 100:03d}") for i in range(100)]
    rows = spark.createDataFrame(chain + cycle + [("tail", "c000"), ("orphan", "nobody")], "policy string, parent string")
    found = {r.policy: r for r in policies.inheritance_chains(rows).collect()}
    assert found["p099"].chain == [f"p{i:03d}" for i in range(100)] and not found["p099"].cyclic
    assert len(found["c007"].chain) == 100 and all(found[f"c{i:03d}"].cyclic for i in range(100))
    assert len(found["tail"].chain) == 101 and found["orphan"].chain == ["orphan"]


def test_every_text_is_searched_for_sensitive_data(spark):
    docs = spark.createDataFrame([(1, "AKIA" + "Q" * 16), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    today = dt.date(2024, 1, 1)
    assert {r.doc_id for r in dlp.dlp_findings(docs, "doc_id", "text", today).collect()} == {1}
    assert {r.doc_id for r in dlp.dlp_redact(docs, "text", today).where(F.size("detected_types") > 0).collect()} == {1}


def test_pruned_payload_keeps_the_rest(spark):
    payload = {"body": {"a": 1, "b": [{"x": 1, "y": 2}, {"x": 3}], "c.d": 5}, "keep": {"deep": [1, None, "é"]}, "n": 10**20}
    frame = spark.createDataFrame([(json.dumps(payload),), ("no json",), (None,)], "p string")

    def pruned(*paths):
        return [r.p if r.p is None or r.p == "no json" else json.loads(r.p) for r in frame.select(M.payload_prune("p", paths).alias("p")).collect()]

    assert pruned("body.a") == [{**payload, "body": {k: v for k, v in payload["body"].items() if k != "a"}}, "no json", None]
    assert pruned("body.b[*].x")[0]["body"]["b"] == [{"y": 2}, {}]
    assert pruned("body.b[0]", r"body.c\.d", "missing.path")[0] == {**payload, "body": {"a": 1, "b": [{"x": 3}]}}
    fields = M.payload_fields("p", {"one": "body.b[1].x", "all": "body.b[*].x", "dotted": r"body.c\.d"})
    assert tuple(frame.select(*fields).first()) == ("3", "[1,3]", "5")


def test_all_guardrails_in_either_direction(spark):
    rows = spark.createDataFrame([(f"g{i:03d}", i % 7) for i in range(250)], "guardrail_id string, n int")
    for descending in (True, False):
        got = [r.guardrail_id for r in guardrails.ranked(rows, "n", "guardrail_id", descending).orderBy("position").collect()]
        assert got == [f"g{i:03d}" for i in sorted(range(250), key=lambda i: (-(i % 7) if descending else i % 7, i))]


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), (None, 9.0)], "k string, v double")
    assert {tuple(r) for r in quantiles.nearest_rank(rows, ["k"], "v", {"p50": 0.5}).collect()} == {("a", 1.0), (None, 7.0)}
    totals = ordered.running_totals(rows, ["k"], ["v"], {"t": F.col("v")}, F.floor("v"), inclusive=True)
    assert sorted((r.v, r.t) for r in totals.collect()) == [(1.0, 1.0), (3.0, 4.0), (5.0, 5.0), (7.0, 12.0), (9.0, 21.0)]


def test_equal_rows_stay(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("k", "r1", at), ("k", "r1", at), (None, "r2", at), ("k", "r3", at + dt.timedelta(seconds=5))], "k string, id string, ts timestamp_ntz")
    got = sorted((r.k or "", r.id, r.recent) for r in ordered.trailing_count(rows, ["k"], "ts", "id", 10).collect())
    assert got == [("", "r2", 1), ("k", "r1", 2), ("k", "r1", 2), ("k", "r3", 3)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    with pytest.raises(ValueError):
        shared_dir(Session())
