"""Streaming queries: run over the event files to their end, result as a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.functions.money import to_units
from ledgerlight.operators.guardrails import security_daily
from ledgerlight.plans.oracle_views import add_view
from ledgerlight.plans.registry import STATEMENTS, query
from ledgerlight.plans.transfer import envelope_lines
from ledgerlight.session import fresh_path
from ledgerlight.sources import readers as RD
from ledgerlight.sources.adapters import Tables
from ledgerlight.streaming import jobs as J
from ledgerlight.streaming import runner as RN
from ledgerlight.streaming import stateful as ST

DAILY_SQL = """
SELECT CAST(created_at AS DATE) AS day, count(*)::BIGINT AS requests,
 count(*) FILTER (WHERE status = 'success')::BIGINT AS successes, count(*) FILTER (WHERE status <> 'success')::BIGINT AS failures,
 count(*) FILTER (WHERE injection_detected)::BIGINT AS injections, count(*) FILTER (WHERE dlp_detected)::BIGINT AS dlp_hits,
 CAST(sum(CAST(floor(latency_ms * 10000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000000.0 AS latency_sum,
 count(latency_ms)::BIGINT AS latency_samples FROM telemetry GROUP BY 1"""
CLOSED = "(SELECT max(created_at) - INTERVAL 10 MINUTE FROM telemetry)"


def stream(t: Tables):
    return RN.telemetry_stream(t.spark, t.sf_dir)


def replay(t: Tables):
    """The telemetry in four micro-batches or more, for jobs that keep state between them."""
    return RN.replayed(t.telemetry().withColumn("created_at", F.col("created_at").cast("timestamp")), "created_at", "replay")


@query("stream_ingest_idempotent", DAILY_SQL)
def stream_ingest_idempotent(t: Tables):
    """Every event arrives twice; the daily metrics count it once."""
    twice = stream(t).unionByName(stream(t))
    unique = RN.run_append(J.unique_requests(twice), "ingest")
    return security_daily(unique.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))


@query("stream_daily_metrics", DAILY_SQL)
def stream_daily_metrics(t: Tables):
    return RN.run_update(J.daily_metrics(stream(t)), ["day"], "daily")


@query("stream_minute_usage", """
SELECT session_id, date_trunc('minute', created_at) AS slot, count(*)::BIGINT AS requests, sum(score)::BIGINT AS units
FROM telemetry GROUP BY 1, 2""")
def stream_minute_usage(t: Tables):
    return RN.run_update(J.minute_usage(stream(t), "session_id"), ["session_id", "slot"], "minute")


@query("stream_velocity", """
SELECT event_type, window_start, count(*)::BIGINT AS recent FROM (
 SELECT event_type, unnest(range(time_bucket(INTERVAL '10 minutes', created_at) - INTERVAL 50 MINUTE,
   time_bucket(INTERVAL '10 minutes', created_at) + INTERVAL 1 SECOND, INTERVAL 10 MINUTE)) AS window_start FROM telemetry) GROUP BY 1, 2""")
def stream_velocity(t: Tables):
    return RN.run_update(J.velocity(stream(t), "event_type", "1 hour", "10 minutes"), ["event_type", "window_start"], "velocity")



@query("stream_failure_alert", """
SELECT event_type, request_id, failures FROM (
 WITH RECURSIVE failed AS (
   SELECT event_type, request_id, epoch_us(created_at) AS moment, row_number() OVER (PARTITION BY event_type ORDER BY created_at, request_id) AS n
   FROM telemetry WHERE status = 'failure'),
 run AS (
   SELECT event_type, n, request_id, [moment] AS times, 1::BIGINT AS failures FROM failed WHERE n = 1
   UNION ALL
   SELECT event_type, n, request_id, times, len(times)::BIGINT FROM (
     SELECT f.event_type, f.n, f.request_id,
            list_append(list_filter(CASE WHEN r.failures >= 5 THEN []::BIGINT[] ELSE r.times END, lambda x: x > f.moment - 7200000000), f.moment) AS times
     FROM run r JOIN failed f ON f.event_type = r.event_type AND f.n = r.n + 1))
 SELECT * FROM run WHERE failures >= 5)""")
def stream_failure_alert(t: Tables):
    failed = replay(t).where("status = 'failure'").select("event_type", "created_at", "request_id")
    return RN.run_append(ST.failure_alerts(failed, "event_type", 7200, 5), "bursts")


@query("stream_hanging", """
SELECT s.request_id, s.created_at FROM telemetry s LEFT JOIN (
  SELECT request_id, created_at + CAST(floor(latency_ms) AS BIGINT) * INTERVAL 10 SECOND AS finished_at FROM telemetry WHERE score < 70) f
  ON s.request_id = f.request_id AND f.finished_at <= s.created_at + INTERVAL 300 SECOND
WHERE f.request_id IS NULL AND s.created_at + INTERVAL 300 SECOND < least((SELECT max(created_at) FROM telemetry),
  (SELECT max(created_at + CAST(floor(latency_ms) AS BIGINT) * INTERVAL 10 SECOND) FROM telemetry WHERE score < 70)) - INTERVAL 10 MINUTE""")
def stream_hanging(t: Tables):
    ends = stream(t).where("score < 70").select("request_id", (F.col("created_at") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.floor("latency_ms") * 10).cast("decimal(18,6)"))).alias("finished_at"))
    return RN.run_append(J.hanging(stream(t), ends, 300), "hanging")


@query("stream_chunk_redact")
def stream_chunk_redact(t: Tables):
    """Conversation turns as chunks of one text per conversation."""
    rows = RN.replayed(t.raw("conversations").withColumn("at", F.timestamp_seconds("turn")), "at", "chunks")
    last = t.raw("conversations").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    chunks = rows.join(last, "conv_id").select("conv_id", F.col("turn").alias("chunk_no"), F.concat(
        "text", F.lit(" mail user@example.com")).alias("chunk"), (F.col("turn") == F.col("_last")).alias("is_last"))
    return RN.run_append(ST.chunk_redaction(chunks, "conv_id", dt.date(2024, 6, 1)), "redact")


@query("stream_session", f"""
SELECT session_id, min(created_at) AS session_start, max(created_at) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS requests
FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (
        PARTITION BY session_id ORDER BY created_at) AS n
      FROM (SELECT *, created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) AS gap FROM telemetry))
GROUP BY session_id, n HAVING max(created_at) + INTERVAL 30 MINUTE <= {CLOSED}""")
def stream_session(t: Tables):
    return RN.run_append(J.sessions(stream(t), "session_id", "30 minutes"), "sessions")


@query("stream_late_data", """
SELECT CAST(created_at AS DATE) AS day, count(*)::BIGINT AS requests FROM telemetry GROUP BY 1""")
def stream_late_data(t: Tables):
    """The second half of the month arrives first; a watermark of 90 days lets the late half still count."""
    home = fresh_path(t.spark, "late")
    rows = t.telemetry().select("request_id", "created_at")
    late = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    rows.where(~late).write.parquet(f"{home}/in/first")
    rows.where(late).write.parquet(f"{home}/in/second")
    arriving = (t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
                .parquet(f"{home}/in").withColumn("created_at", F.col("created_at").cast("timestamp")))
    counted = arriving.withWatermark("created_at", "90 days").groupBy(F.window("created_at", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("requests")).select(F.to_date("w.start").alias("day"), "requests")
    return RN.run_update(counted, ["day"], "late-days")


ARRIVAL_SQL = """
SELECT *, CASE WHEN created_at < TIMESTAMP '2024-01-16' THEN 3 ELSE request_id % 3 END AS part FROM telemetry"""


@query("stream_late_split", f"""
SELECT * FROM (WITH good AS (SELECT * FROM ({ARRIVAL_SQL}) WHERE event_type <> 'error'),
seen AS (SELECT part, max(max(created_at)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS newest FROM good GROUP BY part),
judged AS (SELECT created_at, COALESCE(created_at <= date_trunc('milliseconds', newest) - INTERVAL 5 DAY, false) AS late FROM good JOIN seen USING (part))
SELECT 'counted' AS kind, CAST(created_at AS DATE) AS day, count(*)::BIGINT AS rows FROM judged WHERE NOT late GROUP BY 2
UNION ALL SELECT 'late', NULL, count(*)::BIGINT FROM judged WHERE late
UNION ALL SELECT 'malformed', NULL, count(*)::BIGINT FROM telemetry WHERE event_type = 'error')""")
def stream_late_split(t: Tables):
    """Envelope lines out of order and with damage: counted days, rows behind a watermark of five days, and dead letters.

    A micro-batch is judged by the watermark that the batch before it ran with, so by the rows up to two batches earlier.
    """
    home = fresh_path(t.spark, "late-split")
    part = F.when(F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz"), 3).otherwise(F.col("request_id") % 3)
    line = F.to_json(F.struct("request_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at")))
    damaged = F.when(F.col("event_type") == "error", F.left(line, F.length(line) - 4)).otherwise(line)
    lines = t.telemetry().select(damaged.alias("value"), part.alias("part"))
    for number in range(4):
        lines.where(F.col("part") == number).select("value").coalesce(1).write.text(f"{home}/in/{number}")
    arriving = t.spark.readStream.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).schema("value string").text(f"{home}/in")
    parsed = arriving.select("value", F.from_json("value", "request_id bigint, created_at string", {"mode": "PERMISSIVE"}).alias("j"))
    whole = F.col("j.request_id").isNotNull() & F.col("j.created_at").isNotNull()
    good = parsed.where(whole).select("j.request_id", F.to_timestamp("j.created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))
    counted, late = RN.run_append_dropping(J.unique_requests(good, delay="5 days"), "on-time")
    letters = RN.run_append(parsed.where(~whole).select("value"), "letters")
    days = counted.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("counted").alias("kind"), "day", "rows")
    day = F.lit(None).cast("date").alias("day")
    return (days.union(letters.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit("malformed"), day, "rows"))
            .union(days.groupBy().agg(F.lit(late).cast("bigint").alias("rows")).select(F.lit("late"), day, "rows")))


@query("stream_cooldown", STATEMENTS["cooldown_twin"])
def stream_cooldown(t: Tables):
    rows = replay(t).select("event_type", "created_at", "request_id", (F.col("score") >= 95).alias("failed"))
    return RN.run_append(ST.cooldown(rows, "event_type", 1800), "cooldown")


@query("stream_alert_digest", f"SELECT * FROM ({STATEMENTS['alert_digest']}) WHERE window_start + INTERVAL 6 HOUR <= "
       "(SELECT max(created_at) - INTERVAL 10 MINUTE FROM telemetry WHERE risk <> 'none')")
def stream_alert_digest(t: Tables):
    return RN.run_append(J.alert_digest(stream(t).where("risk <> 'none'"), ["event_type", "stage"], "6 hours"), "digest")


@query("stream_session_spend", """
SELECT session_id, request_id, units_before, units_before >= 30000000000 AS over_budget FROM (
 SELECT session_id, request_id, coalesce(sum(CAST(floor(latency_ms * 10000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) OVER (
   PARTITION BY session_id ORDER BY created_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS units_before
 FROM telemetry)""")
def stream_session_spend(t: Tables):
    rows = replay(t).select("session_id", "created_at", "request_id", to_units("latency_ms").alias("units"))
    return RN.run_append(ST.session_spend(rows, "session_id", 30_000_000_000, silence_seconds=366 * 86_400), "spend")


@query("bulk_log_writer", "SELECT event_type, count(*)::BIGINT AS written FROM events GROUP BY 1")
def bulk_log_writer(t: Tables):
    """Log rows written batch by batch, each micro-batch to its own place."""
    def write(batch, number: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    folder = RN.run_batches(RN.table_stream(t.spark, t.sf_dir, "events"), "bulk", write)
    return t.spark.read.parquet(folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("written"))


add_view("good_envelopes", "SELECT * FROM telemetry WHERE event_type NOT IN ('error', 'signup')")


@query("telemetry_source", """
SELECT 'conversation' AS kind, count(*)::BIGINT AS rows FROM good_envelopes
UNION ALL SELECT 'dead_letter', count(*)::BIGINT FROM telemetry WHERE event_type IN ('error', 'signup')""")
def telemetry_source(t: Tables):
    """Envelope files as a stream: good ones become conversation rows, the others dead letters."""
    home = fresh_path(t.spark, "envelopes")
    envelope_lines(t).write.json(f"{home}/in")
    lines = t.spark.readStream.schema("source_id bigint, value string").json(f"{home}/in")

    def write(batch, number: int, folder: str) -> None:
        parsed = RD.parse_envelopes(batch)
        conversations, _ = RD.telemetry_flatten(parsed)
        conversations.write.mode("overwrite").parquet(f"{folder}/conversation/batch={number}")
        RD.dead_letters(parsed, "source_id").write.mode("overwrite").parquet(f"{folder}/dead_letter/batch={number}")

    folder = RN.run_batches(lines, "telemetry", write)
    counts = [t.spark.read.parquet(f"{folder}/{kind}").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"))
              for kind in ("conversation", "dead_letter")]
    return counts[0].unionByName(counts[1])
