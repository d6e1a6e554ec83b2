"""Queries that exercise the extension points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerlight.functions import extensions as X
from ledgerlight.functions.aggregates import Aggregate
from ledgerlight.operators import dlp as L
from ledgerlight.plans.registry import STATEMENTS, query
from ledgerlight.plans import safety as S
from ledgerlight.plans.safety import TODAY
from ledgerlight.sources.adapters import Tables
from ledgerlight.streaming import runner as RN


def shouting(texts: pd.Series) -> pd.DataFrame:
    """Example of a user guardrail: blocks texts with many line breaks."""
    lines = texts.str.count("\n").astype("float64")
    return pd.DataFrame({"action": lines.gt(10).map({True: "block", False: "allow"}), "score": lines})


@query("custom_guardrail", """
SELECT doc_id, CASE WHEN n > 10 THEN 'block' ELSE 'allow' END AS action, n::DOUBLE AS score
FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n FROM documents)""")
def custom_guardrail(t: Tables):
    guard = X.register_guardrail(t.spark, "line_guard", shouting)
    return t.documents().select("doc_id", guard("text").alias("v")).select("doc_id", "v.action", "v.score")


@query("custom_event_callback", "SELECT event_type, count(*)::BIGINT AS seen FROM events GROUP BY 1")
def custom_event_callback(t: Tables):
    """A user callback that keeps a count per event type and micro-batch."""
    def callback(batch, number: int, folder: str) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    folder = X.each_batch(RN.table_stream(t.spark, t.sf_dir, "events"), "callback", callback)
    return t.spark.read.parquet(folder).groupBy("event_type").agg(F.sum("n").alias("seen"))


@query("custom_price", """
SELECT part_id, coalesce(override_rate, input_rate, 5.0::DOUBLE) AS rate FROM price_list""")
def custom_price(t: Tables):
    from ledgerlight.functions.cost import DEFAULT_UNPRICED_RATE
    return t.prices().select("part_id", F.coalesce("override_rate", "input_rate", F.lit(DEFAULT_UNPRICED_RATE)).alias("rate"))


@query("udtf_chunks")
def udtf_chunks(t: Tables):
    X.register_table_functions(t.spark, TODAY)
    t.raw("conversations").createOrReplaceTempView("chunk_source")
    return t.spark.sql("SELECT conv_id, turn, c.chunk_no, length(c.chunk) AS size FROM chunk_source, LATERAL text_chunks(text) AS c")


@query("udtf_findings")
def udtf_findings(t: Tables):
    X.register_table_functions(t.spark, TODAY)
    t.documents().createOrReplaceTempView("finding_source")
    return t.spark.sql("SELECT doc_id, f.rule_id, f.type, f.start, f.end FROM finding_source, LATERAL text_findings(text) AS f")


@query("dlp_resolve")
def dlp_resolve(t: Tables):
    """Resolved spans per text: how many, how many characters they cover, and that none overlap."""
    spans = L.dlp_findings(t.documents(), "doc_id", "text", TODAY)
    return spans.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("covered"),
        (F.max("end") - F.min("start") >= F.sum(F.col("end") - F.col("start"))).alias("disjoint"))


LEVELS = ("low", "medium", "high")


def fold_risk(state: tuple | None, rows: pd.DataFrame) -> tuple:
    """Example of a user aggregate: highest level and score of a session, and its messages above low risk."""
    level, score, risky = state or (-1, 0, 0)
    ranks = rows["risk"].map(LEVELS.index)
    return max(level, int(ranks.max())), max(score, int(rows["risk_score"].max())), risky + int((ranks > 0).sum())


SESSION_RISK = Aggregate(
    ("risk", "risk_score"), "level int, score int, risky bigint", "session_risk string, session_score int, risky_messages bigint", fold_risk,
    lambda states: (max(s[0] for s in states), max(s[1] for s in states), sum(s[2] for s in states)), lambda s: (LEVELS[s[0]], s[1], s[2]))


@query("custom_aggregate", f"""
SELECT conv_id, arg_max(risk, CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS session_risk, max(risk_score)::INT AS session_score,
       count(*) FILTER (WHERE risk <> 'low')::BIGINT AS risky_messages FROM ({STATEMENTS['context_risk']}) GROUP BY 1""")
def custom_aggregate(t: Tables):
    """Risk of every conversation from the risks of its messages, by a user aggregate with partial states."""
    return SESSION_RISK.by(S.context_risk(t), "conv_id")
