"""Alerts, jobs and cool-downs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.ordered import epoch_micros, running_maxima
from ledgerlight.sources.adapters import ntz

# States in which a job can make no more progress.
TERMINAL_STATES = ("completed", "complete", "failed", "expired", "cancelled", "stale_expired")
POLLED_STATES = ("queued", "in_progress")


def squash_alerts(alerts: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """Queued alerts of one receiver and type as one, with their number and the first item."""
    return alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"), F.min_by(item, order).alias("first_item"))


def alert_digest(alerts: DataFrame, keys: list[str], ts: str, width: str, item: str) -> DataFrame:
    """One digest per key and window: number, first message, first and last time."""
    slot = F.window(F.col(ts).cast("timestamp"), width)
    return alerts.groupBy(*keys, slot.alias("w")).agg(
        F.count(F.lit(1)).alias("alerts"), F.min_by(item, ts).alias("first_item"),
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at")).select(
        *keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "alerts", "first_item", "first_at", "last_at")


def tool_registry(calls: DataFrame, tool: str, ts: str, cycle_seconds: int = 30) -> DataFrame:
    """Cycles in which a tool appeared (not its calls), first and last time seen."""
    cycle = F.floor(epoch_micros(ts) / (cycle_seconds * 1_000_000))
    per_cycle = calls.where(F.col(tool).isNotNull()).groupBy(tool, cycle.alias("_cycle")).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return per_cycle.groupBy(tool).agg(F.count(F.lit(1)).alias("cycles"), F.min("first_seen").alias("first_seen"),
                                       F.max("last_seen").alias("last_seen"))


def masked_entity_counts(rows: DataFrame, column: str, row_id: str) -> DataFrame:
    """Masked entities per row: counters of a JSON list of objects, summed per entity."""
    entries = F.from_json(column, "array<map<string,int>>")
    flat = rows.select(row_id, F.explode(entries).alias("_entry")).select(row_id, F.explode("_entry").alias("entity", "n"))
    return flat.groupBy(row_id, "entity").agg(F.sum("n").alias("masked"))


def hanging_requests(started: DataFrame, finished: DataFrame, row_id: str, ts: str, as_of: dt.datetime,
                     seconds: int) -> DataFrame:
    """Started requests without a terminal state after *seconds*."""
    old = started.where(F.col(ts) < ntz(as_of - dt.timedelta(seconds=seconds)))
    return old.join(finished.select(row_id), row_id, "left_anti")


def expire_stale(jobs: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Old jobs that will never finish become stale_expired; every job is kept."""
    stale = ~F.col("status").isin(*TERMINAL_STATES) & (F.col("created_at") < ntz(as_of - dt.timedelta(days=days)))
    return jobs.withColumn("status", F.when(stale, F.lit("stale_expired")).otherwise(F.col("status")))


def jobs_to_poll(jobs: DataFrame, size: int) -> DataFrame:
    """The oldest unfinished jobs, at most *size* of them."""
    return jobs.where(F.col("status").isin(*POLLED_STATES)).orderBy("created_at", "job_id").limit(size)


def cooled_down(failures: DataFrame, requests: DataFrame, key: str, ts: str, row_id: str, seconds: int) -> DataFrame:
    """Requests that arrive while their entity is suspended after a failure.

    Interval overlap without a range join: failures and requests share one time line, and a request looks at the last
    failure before it, a running maximum that is cut into buckets where a key has many rows.
    """
    span = seconds * 1_000_000

    def placed(df: DataFrame, kind: int) -> DataFrame:
        return df.select(key, row_id, epoch_micros(ts).alias("_at"), F.lit(kind).alias("_kind"))

    # At the same moment the request comes first: a failure suspends what follows it.
    line = placed(failures, 1).unionByName(placed(requests, 0))
    last = {"_last": F.when(F.col("_kind") == 1, F.col("_at"))}
    marked = running_maxima(line, [key], ["_at", "_kind"], last).where(F.col("_kind") == 0)
    cooling: Column = F.coalesce(F.col("_at") - F.col("_last") < span, F.lit(False))
    return marked.select(key, row_id, cooling.alias("cooling"))
