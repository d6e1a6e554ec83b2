"""Where users add their own guardrails, table functions and event callbacks."""

from __future__ import annotations

from collections.abc import Callable

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.dlp import _candidates, _resolve
from ledgerlight.operators.retrieval import split_text
from ledgerlight.streaming.runner import run_batches

VERDICT = "action string, score double"


def register_guardrail(spark: SparkSession, name: str, judge: Callable[[pd.Series], pd.DataFrame]) -> Callable[[Column], Column]:
    """Register a user function of text batches as a SQL function returning (action, score)."""
    guard = F.pandas_udf(judge, VERDICT)
    return spark.udf.register(name, guard)


def register_table_functions(spark: SparkSession, today: dt.date) -> None:
    """text_chunks(text) and text_findings(text) for LATERAL joins in SQL; dates after *today* are no birth dates."""
    class Chunks:
        def eval(self, text: str):
            yield from enumerate(split_text(text or ""))

    class Findings:
        def eval(self, text: str):
            for rule, kind, category, start, end, _ in _resolve(_candidates(text or "", today)):
                yield rule, kind, category, start, end

    spark.udtf.register("text_chunks", F.udtf(Chunks, returnType="chunk_no int, chunk string"))
    spark.udtf.register("text_findings", F.udtf(
        Findings, returnType="rule_id string, type string, category string, start int, end int"))


def each_batch(stream: DataFrame, label: str, callback: Callable[[DataFrame, int, str], None]) -> str:
    """Call a user function with every micro-batch of logged events."""
    return run_batches(stream, label, callback)
