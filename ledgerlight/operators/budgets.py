"""Budget, limit and rate audits over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.money import count_if, from_units, to_units
from ledgerlight.operators.ordered import epoch_micros, gap_sessions, ordinals, running_totals, trailing_count
from ledgerlight.operators.usage_reports import day


def session_budget(usage: DataFrame, limit: float) -> DataFrame:
    """Over budget when the spend *before* the request reaches the limit; only positive costs add up."""
    rows = running_totals(
        usage.where(F.col("session_id").isNotNull()), ["session_id"], ["start_time", "request_id"],
        {"_units": F.when(F.col("spend") > 0, to_units("spend")).otherwise(F.lit(0))}, day())
    return rows.withColumn("spend_before", from_units("_units")).withColumn(
        "over_budget", F.col("_units") >= to_units(F.lit(float(limit)))).drop("_units")


def session_iterations(usage: DataFrame, limit: int) -> DataFrame:
    """Flag the calls whose number, *including the call itself*, exceeds the limit."""
    rows = ordinals(usage.where(F.col("session_id").isNotNull()), ["session_id"], ["start_time", "request_id"],
                    day(), name="call_number")
    return rows.withColumn("over_limit", F.col("call_number") > limit)


def minute_limit(usage: DataFrame, entity: str, tpm: int, rpm: int, unit: str = "minute") -> DataFrame:
    """A request exceeds when the tokens before it plus its own pass TPM, or its number passes RPM.

    An entity with very many requests in one *unit* is cut into buckets along the time.
    """
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    rows = usage.withColumn("slot", F.date_trunc(unit, "start_time").cast("timestamp_ntz"))
    running = running_totals(rows, [entity, "slot"], ["start_time", "request_id"], {"tokens_before": tokens, "calls_before": F.lit(1).cast("bigint")})
    return (running
            .withColumn("exceeds", (F.col("tokens_before") + tokens > tpm) | (F.col("calls_before") + 1 > rpm)))


def concurrency(usage: DataFrame, entity: str, cap: int) -> DataFrame:
    """Requests still running when a request starts, and whether the cap was reached.

    Starts count +1 and ends −1 on one time line; ends come first at the same moment.
    """
    line = usage.select(entity, "request_id", F.explode(F.array(
        F.struct(F.col("start_time").alias("moment"), F.lit(1).alias("step")),
        F.struct(F.col("end_time").alias("moment"), F.lit(-1).alias("step")))).alias("e")).select(
        entity, "request_id", "e.moment", "e.step")
    running = running_totals(line, [entity], ["moment", "step", "request_id"],
                             {"running_before": F.col("step").cast("bigint")})
    return running.where(F.col("step") == 1).select(
        entity, "request_id", "moment", "running_before", (F.col("running_before") >= cap).alias("rejected"))


def budget_periods(usage: DataFrame, entity: str, start, days: int, as_of) -> DataFrame:
    """Cost per entity and budget period; a reset is due once a period's length has passed."""
    span = days * 86400 * 1_000_000
    offset = epoch_micros("start_time") - epoch_micros(F.lit(str(start)).cast("timestamp_ntz"))
    age = epoch_micros(F.lit(str(as_of)).cast("timestamp_ntz")) - epoch_micros(F.lit(str(start)).cast("timestamp_ntz"))
    rows = usage.where(offset >= 0)
    return rows.groupBy(entity, F.floor(offset / span).cast("bigint").alias("period")).agg(
        from_units(F.sum(to_units("spend"))).alias("period_cost")).withColumn(
        "reset_due", age - F.col("period") * span >= span)


def velocity_spikes(rows: DataFrame, key: str, ts: str, row_id: str, seconds: int, threshold: int) -> DataFrame:
    """More than *threshold* rows of a key within the trailing span (inclusive).

    The interactive guard looks at its last 100 messages only; the threshold is
    far below that bound, so the flag is the same.
    """
    return trailing_count(rows, [key], ts, row_id, seconds).withColumn("spike", F.col("recent") > threshold)


def failure_bursts(rows: DataFrame, key: str, ts: str, row_id: str, seconds: int, threshold: int) -> DataFrame:
    """Failures that complete a burst of *threshold* within the trailing span (its start excluded)."""
    failed = rows.where(F.col("status") == "failure")
    return trailing_count(failed, [key], ts, row_id, seconds, open_start=True, name="failures").where(
        F.col("failures") >= threshold)


def suspicious_sessions(rows: DataFrame, key: str, ts: str, increment: str, gap_seconds: int, limit: int) -> DataFrame:
    """Suspicious events per session; every positive increment counts between 1 and 100."""
    positive = rows.where(F.col(increment) > 0)
    bounded = F.least(F.lit(100), F.greatest(F.lit(1), F.floor(F.col(increment)))).cast("bigint")
    sessions = gap_sessions(positive, [key], ts, gap_seconds, {"suspicious_events": bounded})
    return sessions.withColumn("exceeded", F.col("suspicious_events") >= limit)


def available_share(usage: DataFrame, project: str, unit: str, total_tokens: int, total_requests: int,
                    weight: float) -> DataFrame:
    """Share of what is left for every active project, per time slot; never negative.

    Projects are folded to one row per slot first, so the distinct count is a plain count.
    """
    slot = F.date_trunc(unit, "start_time").cast("timestamp_ntz").alias("slot")
    per_project = usage.groupBy(slot, project).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("_tokens"), F.count(F.lit(1)).alias("_calls"))
    slots = per_project.groupBy("slot").agg(
        F.sum("_tokens").alias("used_tokens"), F.sum("_calls").alias("used_requests"),
        F.count(project).alias("active_projects"))

    def share(total: int, used: str):
        left = (F.lit(total) - F.col(used)) * F.lit(weight)
        each = F.when(F.col("active_projects") > 0, left / F.col("active_projects")).otherwise(left)
        return F.greatest(F.lit(0), each.cast("bigint"))

    return slots.select("slot", "used_tokens", "used_requests", "active_projects",
                        share(total_tokens, "used_tokens").alias("available_tpm"),
                        share(total_requests, "used_requests").alias("available_rpm"))


def latest_by_key(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Newest state per entity as one partial aggregation (no sort, no window)."""
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(key).agg(newest.alias("_s")).select(key, "_s.*")


def non_stale_unhealthy(latest: DataFrame, healthy: str, ts: str, as_of, seconds: int) -> DataFrame:
    """Entities whose latest state is unhealthy and younger than the threshold."""
    age = epoch_micros(F.lit(str(as_of)).cast("timestamp_ntz")) - epoch_micros(ts)
    return latest.where(~F.col(healthy) & (age < seconds * 1_000_000))


def counter_delta(readings: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Daily increase of a cumulative counter: last reading of a day minus that of the day before."""
    last = readings.groupBy(key, F.to_date(ts).alias("day")).agg(F.max(value).alias("_last"))
    by_day = Window.partitionBy(key).orderBy("day")
    return last.select(key, "day", (F.col("_last") - F.coalesce(F.lag("_last").over(by_day), F.lit(0))).alias("increase"))


def minute_outcomes(usage: DataFrame, entity: str, unit: str = "minute") -> DataFrame:
    slot = F.date_trunc(unit, "start_time").cast("timestamp_ntz").alias("slot")
    ok = F.col("status") == "success"
    return usage.groupBy(entity, slot).agg(count_if(ok).alias("successes"), count_if(~ok).alias("failures"))


def minute_usage(usage: DataFrame, entity: str, unit: str = "minute") -> DataFrame:
    slot = F.date_trunc(unit, "start_time").cast("timestamp_ntz").alias("slot")
    return usage.groupBy(entity, slot).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tpm"), F.count(F.lit(1)).alias("rpm"))


def latency_histogram(rows: DataFrame, service: str, value: str, edges: list[float]) -> DataFrame:
    """Cumulative latency counts per service; one pass, one row per service and edge."""
    sums = rows.groupBy(service).agg(
        *[count_if(F.col(value) <= edge).alias(f"_le_{i}") for i, edge in enumerate(edges)],
        F.count(value).alias("_le_all"))
    entries = F.array(*[F.struct(F.lit(str(edge)).alias("le"), F.col(f"_le_{i}").alias("n"))
                        for i, edge in enumerate(edges)],
                      F.struct(F.lit("+Inf").alias("le"), F.col("_le_all").alias("n")))
    return sums.select(service, F.explode(entries).alias("e")).select(service, "e.le", F.col("e.n").alias("observations"))
