"""Queries that write to the shared folder and read back: sources, sinks and record shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.operators import billing as B
from ledgerlight.operators import detectors as DT
from ledgerlight.operators import dlp as L
from ledgerlight.plans.exports import frame
from ledgerlight.plans.registry import query
from ledgerlight.plans.safety import TODAY
from ledgerlight.session import fresh_path
from ledgerlight.sources import readers as RD
from ledgerlight.sources import writers as W
from ledgerlight.sources.adapters import Tables, request_start


@query("audit_write", """
SELECT request_id, '["' || event_type || '"]' AS tags_text, risk FROM (SELECT CAST(request_id AS VARCHAR) AS request_id, event_type, risk FROM telemetry)""")
def audit_write(t: Tables):
    """Write every decision as an audit line, read the lines back."""
    path = fresh_path(t.spark, "audit")
    events = t.telemetry().select(
        F.col("request_id").cast("string").alias("event_id"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.to_json(F.struct("session_id")).alias("request"), F.to_json(F.struct("risk", "score")).alias("decision"),
        F.array("event_type").alias("tags"))
    W.append_audit(events, path)
    back = RD.read_audit(t.spark, path)
    return back.select(F.col("event_id").alias("request_id"), F.to_json("tags").alias("tags_text"),
                       F.get_json_object("decision", "$.risk").alias("risk"))


@query("audit_read", "SELECT event_type AS tag, count(*)::BIGINT AS events FROM events GROUP BY 1")
def audit_read(t: Tables):
    """Audit lines with blank lines between them."""
    path = fresh_path(t.spark, "audit-lines")
    lines = t.raw("events").select(F.concat(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.array("event_type").alias("tags"))), F.lit("\n\n")).alias("value"))
    lines.write.text(path)
    return RD.read_audit(t.spark, path).groupBy(F.element_at("tags", 1).alias("tag")).agg(F.count(F.lit(1)).alias("events"))


def batch_lines(t: Tables, path: str) -> None:
    """Conversation turns as batch requests whose strings hold raw line breaks."""
    rows = t.raw("conversations").select("conv_id", "turn", F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("custom_id"),
        F.struct(F.lit("model-a").alias("model"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")
                 ).alias("body")).alias("r"))
    rows.select(F.replace(F.to_json("r"), F.lit("\\n"), F.lit("\n")).alias("value")).write.text(path)


REQUEST = "custom_id string, body struct<model:string,messages:array<struct<role:string,content:string>>>"


@query("jsonl_embedded_newlines", """
SELECT conv_id || '-' || turn AS custom_id, 'model-a' AS model, role, text AS content FROM conversations""")
def jsonl_embedded_newlines(t: Tables):
    path = fresh_path(t.spark, "batch")
    batch_lines(t, path)
    records = RD.read_json_records(t.spark, path, REQUEST)
    return records.select("custom_id", "body.model", F.col("body.messages")[0]["role"].alias("role"),
                          F.col("body.messages")[0]["content"].alias("content"))


@query("model_rewrite", """
SELECT conv_id || '-' || turn AS custom_id, 'provider/model-b' AS model, text AS content FROM conversations""")
def model_rewrite(t: Tables):
    rows = t.raw("conversations").select(F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("custom_id"),
        F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.lit("model-a").alias("model"))
        .alias("body"))).alias("line"))
    changed = RD.rewrite_model(rows, "line", "provider/model-b")
    return changed.select(F.get_json_object("line", "$.custom_id").alias("custom_id"),
                          F.get_json_object("line", "$.body.model").alias("model"),
                          F.get_json_object("line", "$.body.messages[0].content").alias("content"))


SUMMARY_SQL = """
SELECT provider AS "ProviderName", count(*)::BIGINT AS charges,
       CAST(sum(CAST((spend_units + 5) // 10 AS BIGINT)) AS DOUBLE) / 1000000.0 AS billed FROM enriched_daily GROUP BY 1"""


def billed_by_provider(rows):
    micro = F.floor(F.col("BilledCost").cast("double") * 1_000_000.0 + 0.5)
    return rows.groupBy("ProviderName").agg(F.count(F.lit(1)).alias("charges"),
                                            (F.sum(micro).cast("double") / 1_000_000.0).alias("billed"))


@query("focus_parquet", SUMMARY_SQL)
def focus_parquet(t: Tables):
    path = fresh_path(t.spark, "frame-parquet")
    W.write_frame_parquet(B.normalize_frame(frame(t)), path)
    return billed_by_provider(t.spark.read.parquet(path))


@query("focus_csv", SUMMARY_SQL)
def focus_csv(t: Tables):
    path = fresh_path(t.spark, "frame-csv")
    W.write_frame_csv(B.normalize_frame(frame(t)), path, compression="gzip")
    return billed_by_provider(t.spark.read.option("header", True).csv(path))


@query("export_row_batches", "SELECT count(*)::BIGINT AS rows, true AS within_cap FROM enriched_daily")
def export_row_batches(t: Tables):
    """Export split into files of at most 5,000 rows, each with its own header."""
    path = fresh_path(t.spark, "frame-batches")
    W.write_frame_csv(B.normalize_frame(frame(t)), path, rows_per_file=5000, compression="gzip")
    back = t.spark.read.option("header", True).csv(path).select("BilledCost", F.col("_metadata.file_name").alias("file"))
    per_file = back.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("rows"), (F.max("n") <= 5000).alias("within_cap"))


@query("export_layout", """
SELECT CAST(start_time AS DATE) AS date, CAST(extract(hour FROM start_time) AS INT) AS hour, count(*)::BIGINT AS requests
FROM usage_rows GROUP BY 1, 2""")
def export_layout(t: Tables):
    """The whole log into daily folders, its last day again, which replaces its folder, and that day also into hourly ones."""
    daily, hourly = fresh_path(t.spark, "layout-daily"), fresh_path(t.spark, "layout-hourly")
    rows = t.usage().select("request_id", "start_time", "spend").withColumn("slot", F.date_format("start_time", "HH"))
    W.write_partitioned(rows, daily, "start_time", hourly=False)
    last = rows.agg(F.max("start_time")).first()[0]
    window = W.export_window((last or dt.datetime(2000, 1, 1)) + dt.timedelta(days=1), "daily")
    W.write_partitioned(rows, daily, "start_time", hourly=False, window=window)
    W.write_partitioned(rows, hourly, "start_time", hourly=True, window=window)
    names = rows.withColumns({"date": F.lit(""), "hour": F.lit("")}).schema
    before = t.spark.read.schema(names).parquet(daily).drop("hour").where(F.col("date") != f"{window.start:%Y-%m-%d}").withColumnRenamed("slot", "hour")
    both = before.select("date", "hour").union(t.spark.read.schema(names).parquet(hourly).select("date", "hour"))
    return both.groupBy(F.col("date").cast("date").alias("date"), F.col("hour").cast("int").alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"))


@query("export_window", """
SELECT 'usage-20011103T000000Z-20011104T000000Z' AS run, count(*)::BIGINT AS requests FROM usage_rows
WHERE start_time >= TIMESTAMP '2001-11-03' AND start_time < TIMESTAMP '2001-11-04'""")
def export_window(t: Tables):
    window = W.export_window(dt.datetime(2001, 11, 4, 15, 30), "daily")
    rows = t.usage(since=window.start, until=window.end).where(W.in_window("start_time", window))
    return rows.agg(F.lit(window.name).alias("run"), F.count(F.lit(1)).alias("requests"))


@query("log_object_key", """
SELECT CAST(start_time AS DATE) AS date, count(*)::BIGINT AS objects FROM usage_rows GROUP BY 1""")
def log_object_key(t: Tables):
    path = fresh_path(t.spark, "log-objects")
    lines = t.usage_lines().drop("l_tax").withColumn("_start", request_start())
    W.write_partitioned(lines, path, "_start", hourly=False, columns=t.usage_columns())
    return t.spark.read.parquet(path).groupBy(F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("objects"))


@query("log_publish", """
SELECT request_id AS key, model, prompt_tokens FROM usage_rows""")
def log_publish(t: Tables):
    """Message rows as they go to a topic."""
    rows = W.message_rows(t.usage().select("request_id", "model", "prompt_tokens"), "request_id")
    return rows.select("key", F.get_json_object("value", "$.model").alias("model"),
                       F.get_json_object("value", "$.prompt_tokens").cast("bigint").alias("prompt_tokens"))


@query("dimension_csv_import", """
SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_mktsegment AS first_tag FROM customer""")
def dimension_csv_import(t: Tables):
    path = fresh_path(t.spark, "dimension")
    balance = F.when(F.col("c_acctbal") < 0, F.lit("not a number")).otherwise(F.col("c_acctbal").cast("string"))
    t.raw("customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), F.col("c_nationkey").cast("string").alias("c_nationkey"),
        balance.alias("balance"), F.concat(F.lit("{"), F.col("c_mktsegment"), F.lit(',"vip"}')).alias("tags"),
        F.lit("NULL").alias("note")).write.option("header", True).option("escape", '"').csv(path)
    rows = RD.read_dimension_csv(t.spark, path, [("c_custkey", "bigint"), ("c_nationkey", "int"), ("balance", "double"),
                                                 ("tags", "array<string>"), ("note", "string")])
    return rows.select("c_custkey", "c_nationkey", "balance", F.element_at("tags", 1).alias("first_tag"))


# ---- telemetry envelopes ---------------------------------------------------
def envelope_lines(t: Tables):
    """Events as envelopes; the ones of one type are damaged, some carry an unknown version."""
    score = F.col("score")
    finding = F.struct(F.concat(F.lit("r"), (score % 4).cast("string")).alias("ruleId"), F.lit("override").alias("category"),
                       F.col("stage").alias("stage"), F.col("risk").alias("risk"), score.cast("int").alias("score"),
                       F.lit("warn").alias("action"))
    findings = F.when(score >= 80, F.array(finding, finding)).when(score >= 50, F.array(finding))
    security = F.when(score >= 10, F.struct(
        F.col("injection_detected").alias("injectionDetected"), F.col("dlp_detected").alias("dlpDetected"), F.col("risk").alias("risk"),
        findings.alias("findings")))
    payload = F.to_json(F.struct(
        F.when(F.col("event_type") == "signup", 9).otherwise(1).alias("version"), F.col("request_id").cast("string").alias("requestId"),
        F.col("session_id").cast("string").alias("sessionId"), F.col("status").alias("status"),
        F.floor("latency_ms").alias("latencyMs"), security.alias("security"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt")))
    damaged = F.when(F.col("event_type") == "error", F.left(payload, F.lit(40))).otherwise(payload)
    return t.telemetry().select(F.col("request_id").alias("source_id"), damaged.alias("value"))


@query("telemetry_flatten", """
SELECT CAST(request_id AS VARCHAR) AS request_id, CAST(session_id AS VARCHAR) AS session_id, status, floor(latency_ms)::BIGINT AS latency_ms,
 finding_no, CASE WHEN score >= 50 THEN 'r' || (score % 4) END AS rule_id, CASE WHEN score >= 10 THEN risk END AS request_risk
FROM (SELECT *, unnest(CASE WHEN score >= 80 THEN [0, 1] WHEN score >= 50 THEN [0] ELSE [NULL] END)::INT AS finding_no FROM telemetry)
WHERE event_type NOT IN ('error', 'signup')""")
def telemetry_flatten(t: Tables):
    conversations, events = RD.telemetry_flatten(RD.parse_envelopes(envelope_lines(t)))
    return conversations.select("request_id", "session_id", "status", "latency_ms").join(
        events.select("request_id", "finding_no", "rule_id", "request_risk"), "request_id")


@query("telemetry_dead_letter", """
SELECT CASE event_type WHEN 'error' THEN 'malformed' ELSE 'unsupported_version' END AS error_kind, count(*)::BIGINT AS envelopes,
       min(request_id) AS first_source FROM telemetry WHERE event_type IN ('error', 'signup') GROUP BY 1""")
def telemetry_dead_letter(t: Tables):
    letters = RD.dead_letters(RD.parse_envelopes(envelope_lines(t)), "source_id")
    return letters.groupBy("error_kind").agg(F.count(F.lit(1)).alias("envelopes"), F.min("source_id").alias("first_source"))


@query("dataset_export", """
SELECT request_id, 'sanitized' AS messages, 'attack' AS label, risk, created_at FROM telemetry WHERE score >= 50""")
def dataset_export(t: Tables):
    rows = t.telemetry().withColumn("sanitized_text", F.lit("sanitized"))
    labels = t.telemetry().select("request_id", (F.col("score") >= 50).alias("approved"), F.lit("attack").alias("label"),
                                  F.array("stage").alias("rule_ids"))
    return W.dataset_export(rows, labels, "security").drop("rule_ids")


@query("dataset_export_assistant", """
SELECT request_id, 'sanitized' AS messages, created_at FROM telemetry WHERE score >= 50 AND status = 'success'""")
def dataset_export_assistant(t: Tables):
    rows = t.telemetry().withColumn("sanitized_text", F.lit("sanitized"))
    labels = t.telemetry().select("request_id", (F.col("score") >= 50).alias("approved"), F.lit("attack").alias("label"))
    return W.dataset_export(rows, labels, "assistant")


def conversation_export(t: Tables, kind: str):
    """Every turn of the approved conversations as a chat line, redacted and without override phrases.

    A conversation's request is the one with its number.  A turn is a row of its own, so a conversation of any
    length is never gathered.
    """
    turns = t.raw("conversations").select(F.col("conv_id").alias("request_id"), "turn", "role", "text")
    content = DT.sanitize_prompt(F.col("redacted")).alias("content")
    texts = L.dlp_redact(turns, "text", TODAY).select("request_id", F.to_json(F.struct("turn", "role", content)).alias("sanitized_text"))
    labels = t.telemetry().select("request_id", "status", "risk", "created_at", (F.col("score") >= 50).alias("approved"),
                                  F.lit("attack").alias("label"), F.array("stage").alias("rule_ids"))
    return W.dataset_export(texts, labels, kind)


@query("dataset_export_conversations")
def dataset_export_conversations(t: Tables):
    return conversation_export(t, "security").withColumn("rule_ids", F.array_join("rule_ids", ","))


@query("dataset_export_conversations_assistant")
def dataset_export_conversations_assistant(t: Tables):
    return conversation_export(t, "assistant")
