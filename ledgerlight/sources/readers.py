"""Readers for audit logs, batch files, telemetry envelopes and dimension files."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import jsonspans
from ledgerlight.operators.ordered import running_totals

MESSAGES = "array<struct<role:string,content:string>>"
FINDINGS = "array<struct<ruleId:string,category:string,stage:string,risk:string,score:int,action:string>>"
ENVELOPE = (
    "version int, requestId string, sessionId string, identity struct<userId:string,tenantId:string,orgId:string>, route string, "
    f"model string, modelParameters string, rawMessages {MESSAGES}, sanitizedMessages {MESSAGES}, status string, httpStatus int, "
    "failureCode string, failureMessage string, latencyMs bigint, "
    f"security struct<injectionDetected:boolean,dlpDetected:boolean,risk:string,score:int,matchedRules:array<string>,findings:{FINDINGS}>, "
    "createdAt string, rawExpiresAt string, eventExpiresAt string, _bad string")
ENVELOPE_VERSION = 1
AUDIT = "event_id string, timestamp string, request string, decision string, tags array<string>"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events from JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(AUDIT).json(path)


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records one after the other, in which strings may hold raw line breaks.

    The files stay splittable.  A line belongs to the record before it exactly
    when it begins inside a string, that is, after an odd number of unescaped
    quotes; the running quote count of a file comes from per-block totals, so
    no file is read by a single task.  A record that cannot be parsed fails the
    job.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    bare = F.regexp_replace("value", r"\\.", "")
    quotes = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))).cast("bigint")
    counted = running_totals(lines, ["file"], ["block", "line"], {"before": quotes}, F.col("block"))
    opens = F.when((F.col("before") % 2 == 0) & (F.trim("value") != ""), 1).otherwise(0).cast("bigint")
    numbered = running_totals(counted, ["file"], ["block", "line"], {"record": opens}, F.col("block"), inclusive=True)
    joined = numbered.where("record > 0").groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\\n").alias("json"))
    parsed = joined.select("file", "record", "json", F.from_json("json", f"{schema}, _bad string", {
        "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    failed = F.raise_error(F.concat(F.lit("record cannot be parsed: "), F.left("json", F.lit(80))))
    names = [f.name for f in T.StructType.fromDDL(schema)]
    checked = parsed.withColumn("r", F.when(F.col("r._bad").isNull(), F.col("r")).otherwise(failed))
    return checked.select("file", "record", *[F.col(f"r.{n}").alias(n) for n in names])


def parse_envelopes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Telemetry envelopes with their parsed form; _bad marks what cannot be read.

    Works on batch and streaming input alike.
    """
    parsed = lines.withColumn("e", F.from_json(column, ENVELOPE, {"columnNameOfCorruptRecord": "_bad"}))
    kind = (F.when(F.col("e._bad").isNotNull() | F.col("e").isNull(), "malformed")
            .when(F.coalesce("e.version", F.lit(-1)) != ENVELOPE_VERSION, "unsupported_version")
            .when(F.col("e.requestId").isNull() | F.col("e.createdAt").isNull(), "incomplete"))
    return parsed.withColumn("error_kind", kind)


def telemetry_flatten(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation rows and one event row per finding; absent parts stay null."""
    e = envelopes.where(F.col("error_kind").isNull())
    conversations = e.select(
        F.col("e.requestId").alias("request_id"), F.col("e.sessionId").alias("session_id"),
        F.col("e.identity.userId").alias("user_id"), F.col("e.identity.tenantId").alias("tenant_id"), F.col("e.route").alias("route"),
        F.col("e.model").alias("model"), F.col("e.rawMessages").alias("raw_messages"),
        F.col("e.sanitizedMessages").alias("sanitized_messages"), F.col("e.status").alias("status"),
        F.col("e.latencyMs").alias("latency_ms"), F.try_to_timestamp("e.createdAt").alias("created_at"),
        F.try_to_timestamp("e.rawExpiresAt").alias("expires_at"))
    findings = e.select(
        F.col("e.requestId").alias("request_id"), F.col("e.security.risk").alias("request_risk"),
        F.col("e.security.matchedRules").alias("rule_ids"), F.try_to_timestamp("e.createdAt").alias("created_at"),
        F.posexplode_outer("e.security.findings").alias("finding_no", "f"))
    events = findings.select("request_id", "finding_no", "request_risk", "rule_ids", "created_at", F.col("f.ruleId").alias("rule_id"),
                             F.col("f.category").alias("category"), F.col("f.stage").alias("stage"), F.col("f.risk").alias("risk"),
                             F.col("f.score").alias("score"), F.col("f.action").alias("action"))
    return conversations, events


def dead_letters(envelopes: DataFrame, source_id: str) -> DataFrame:
    """Rejected envelopes: source id and error kind only, never their content."""
    return envelopes.where(F.col("error_kind").isNotNull()).select(source_id, "error_kind")


def read_dimension_csv(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Dimension rows from CSV with a header: NULL and empty text become null, bad numbers and dates too,
    and a type of array<string> reads {a,b}."""
    raw = spark.read.option("header", True).option("nullValue", "NULL").option("emptyValue", "").option("escape", '"').csv(path)

    def typed(name: str, kind: str) -> Column:
        value = F.nullif(F.trim(name), F.lit(""))
        if kind == "array<string>":
            inner = F.regexp_replace(value, r"^\{|\}$", "")
            return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(
                F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")))
        return value.try_cast(kind)

    return raw.select(*[typed(name, kind).alias(name) for name, kind in columns])


def rewrite_model(records: DataFrame, column: str, model: str) -> DataFrame:
    """Name the model in the body of every batch request; every other character stays as it is.

    A body without a model gets one; a record without a body, or that is no JSON, is left alone.
    """
    name = json.dumps(model, ensure_ascii=False)

    @F.pandas_udf(T.StringType())
    def rewritten(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: jsonspans.replaced(line, ["body", "model"], name, insert=True))

    return records.withColumn(column, rewritten(column))
