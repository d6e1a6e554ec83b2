"""Streaming twins of the batch reports, on built-in stateful operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.money import count_if, from_units, to_units
from ledgerlight.streaming.runner import WATERMARK


def _local(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def unique_requests(rows: DataFrame, key: str = "request_id", delay: str = WATERMARK) -> DataFrame:
    """Retry-safe ingest: a request id counts once within the watermark."""
    return rows.withWatermark("created_at", delay).dropDuplicatesWithinWatermark([key])


def daily_metrics(rows: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Running totals per day, for update mode."""
    ok = F.col("status") == "success"
    totals = rows.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), count_if(ok).alias("successes"), count_if(~ok).alias("failures"),
        count_if(F.col("injection_detected")).alias("injections"), count_if(F.col("dlp_detected")).alias("dlp_hits"),
        F.sum(to_units("latency_ms")).alias("_latency"), F.count("latency_ms").alias("latency_samples"))
    return totals.select(F.to_date("w.start").alias("day"), "requests", "successes", "failures", "injections", "dlp_hits",
                         from_units("_latency").alias("latency_sum"), "latency_samples")


def minute_usage(rows: DataFrame, key: str, width: str = "1 minute", delay: str = WATERMARK) -> DataFrame:
    """Requests and score units per key and tumbling window, for update mode."""
    totals = rows.withWatermark("created_at", delay).groupBy(key, F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("score").alias("units"))
    return totals.select(key, _local(F.col("w.start")).alias("slot"), "requests", "units")


def velocity(rows: DataFrame, key: str, width: str, slide: str, delay: str = WATERMARK) -> DataFrame:
    """Sliding count per key, for update mode."""
    totals = rows.withWatermark("created_at", delay).groupBy(key, F.window("created_at", width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("recent"))
    return totals.select(key, _local(F.col("w.start")).alias("window_start"), "recent")


def hanging(started: DataFrame, finished: DataFrame, seconds: int, delay: str = WATERMARK) -> DataFrame:
    """Starts without an end after *seconds*: outer interval join, state is dropped behind the watermark."""
    left = started.select("request_id", "created_at").withWatermark("created_at", delay)
    right = finished.select(F.col("request_id").alias("_id"), "finished_at").withWatermark("finished_at", delay)
    within = ((F.col("request_id") == F.col("_id")) & (F.col("finished_at") >= F.col("created_at"))
              & (F.col("finished_at") <= F.col("created_at") + F.expr(f"INTERVAL {seconds} SECONDS")))
    return left.join(right, within, "leftOuter").where(F.col("_id").isNull()).select(
        "request_id", _local(F.col("created_at")).alias("created_at"))


def sessions(rows: DataFrame, key: str, gap: str, delay: str = WATERMARK) -> DataFrame:
    """Sessions of a key that end after a silence, emitted once closed (append mode)."""
    totals = rows.withWatermark("created_at", delay).groupBy(key, F.session_window("created_at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"))
    return totals.select(key, _local(F.col("w.start")).alias("session_start"), _local(F.col("w.end")).alias("session_end"), "requests")


def alert_digest(rows: DataFrame, keys: list[str], width: str, delay: str = WATERMARK) -> DataFrame:
    """One digest per key and closed window (append mode)."""
    totals = rows.withWatermark("created_at", delay).groupBy(*keys, F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("alerts"), F.min_by("request_id", "created_at").alias("first_item"),
        F.min("created_at").alias("_first"), F.max("created_at").alias("_last"))
    return totals.select(*keys, _local(F.col("w.start")).alias("window_start"), "alerts", "first_item",
                         _local(F.col("_first")).alias("first_at"), _local(F.col("_last")).alias("last_at"))
