"""Reports over the usage log: spend views, cache activity, joins with keys and teams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.money import count_if, from_units, sum_count, sum_money, to_units
from ledgerlight.sources.adapters import ntz

TAGS_TYPE = T.ArrayType(T.StringType())


# ---- time windows ----------------------------------------------------------
def in_half_open_days(ts: str, start: dt.datetime, end_day: dt.datetime) -> Column:
    """start <= t < end_day + 1 day."""
    return (F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end_day + dt.timedelta(days=1)))


def in_closed_window(ts: str, start: dt.datetime | None, end: dt.datetime | None) -> Column:
    """start <= t <= end; a missing side is open."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (F.col(ts) >= ntz(start))
    if end is not None:
        condition = condition & (F.col(ts) <= ntz(end))
    return condition


def last_days(usage: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Rows from *days* days before the day of *as_of* on."""
    start = dt.datetime(as_of.year, as_of.month, as_of.day) - dt.timedelta(days=days)
    return usage.where(F.col("start_time") >= ntz(start))


def day(ts: str = "start_time") -> Column:
    return F.to_date(F.col(ts))


# ---- spend views -----------------------------------------------------------
def spend_by(usage: DataFrame, *dims: Column | str) -> DataFrame:
    return usage.groupBy(*dims).agg(sum_money("spend").alias("total_spend"))


def last30d_keys(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """Spend per key with alias and name; sums first, so the join sees one row per key."""
    per_key = usage.groupBy("api_key").agg(F.sum(to_units("spend")).alias("_units"))
    named = per_key.join(keys.select("token", "key_alias", "key_name"), F.col("api_key") == F.col("token"), "left")
    return named.groupBy("api_key", "key_alias", "key_name").agg(
        from_units(F.sum("_units")).alias("total_spend"))


def last30d_models(usage: DataFrame) -> DataFrame:
    return spend_by(usage.where((F.col("model") != "") & F.col("model").isNotNull()), "model")


def tag_spend(usage: DataFrame) -> DataFrame:
    """Count and spend per tag and day; a tag repeated in a request counts twice."""
    exploded = usage.select(
        F.explode(F.from_json("request_tags", TAGS_TYPE)).alias("individual_request_tag"),
        day().alias("spend_date"), "spend")
    return exploded.groupBy("individual_request_tag", "spend_date").agg(
        F.count(F.lit(1)).alias("log_count"), sum_money("spend").alias("total_spend"))


def top_end_users(usage: DataFrame, exclude_self: bool = True, n: int = 100) -> DataFrame:
    """Highest-spending end users.  *exclude_self* drops requests whose end user is the key's own user."""
    rows = usage.where(F.col("end_user") != "")
    if exclude_self:
        rows = rows.where(F.col("end_user") != F.col("user_id"))
    totals = rows.groupBy("end_user").agg(
        F.count(F.lit(1)).alias("total_events"), sum_money("spend").alias("total_spend"))
    return totals.orderBy(F.desc("total_spend"), "end_user").limit(n)


def cache_activity(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows, cache hits and cached versus generated tokens per key alias, call type and model.

    The measures are summed per key before the join with the keys, so the join
    handles key × call type × model rows instead of requests and a key with a
    third of all requests does not skew it.
    """
    hit = F.col("cache_hit") == "True"
    per_key = usage.groupBy("api_key", "call_type", "model").agg(
        F.count(F.lit(1)).alias("_rows"),
        count_if(hit).alias("_hits"),
        sum_count(F.when(hit, F.col("completion_tokens")).otherwise(0)).alias("_cached"),
        sum_count(F.when(F.col("cache_hit") != "True", F.col("completion_tokens")).otherwise(0)).alias("_generated"))
    named = per_key.join(keys.select("token", "key_alias"), F.col("api_key") == F.col("token"), "left")
    return named.groupBy(
        F.coalesce("key_alias", F.lit("Unnamed Key")).alias("api_key_alias"), "call_type", "model").agg(
        F.sum("_rows").alias("total_rows"), F.sum("_hits").alias("cache_hit_true_rows"),
        F.sum("_cached").alias("cached_completion_tokens"),
        F.sum("_generated").alias("generated_completion_tokens"))


# ---- joins -----------------------------------------------------------------
def key_view(keys: DataFrame, teams: DataFrame, projects: DataFrame) -> DataFrame:
    """Keys with the limits of their team and the alias of their project."""
    return (keys.join(teams.select("team_id", "team_max_budget", "team_tpm_limit", "team_rpm_limit"), "team_id", "left")
            .join(projects, "project_id", "left"))


def enrich_daily(daily: DataFrame, keys: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    """Daily usage with key alias, team and e-mail; every daily row is kept once."""
    key_team = (keys.select("token", F.col("key_alias").alias("api_key_alias"), "team_id")
                .join(teams.select("team_id", "team_alias"), "team_id", "left"))
    return (daily.join(key_team, F.col("api_key") == F.col("token"), "left").drop("token")
            .join(users.select("user_id", "user_email"), "user_id", "left"))


def session_history(usage: DataFrame, anchors: DataFrame) -> DataFrame:
    """All requests of the sessions that contain one of the *anchors* (column request_id)."""
    sessions = (usage.join(anchors.select("request_id"), "request_id", "left_semi")
                .where(F.col("session_id").isNotNull()).select("session_id").distinct())
    return usage.join(sessions, "session_id", "left_semi")


def backfill_team(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """Fill an empty team from the key, where the key is known."""
    lookup = keys.select(F.col("token").alias("_token"), F.col("team_id").alias("_key_team"))
    return (usage.join(lookup, F.col("api_key") == F.col("_token"), "left")
            .withColumn("team_id", F.coalesce("team_id", "_key_team")).drop("_token", "_key_team"))


# ---- filters ---------------------------------------------------------------
def retention_days(setting: str | int | None) -> float | None:
    """Retention setting in days: a number is days, a text is a duration; None keeps everything."""
    if setting is None or isinstance(setting, bool):
        return None
    if isinstance(setting, int):
        return float(setting)
    unit_seconds = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    number, unit = setting[:-1], setting[-1:]
    if not number.isdigit() or unit not in unit_seconds:
        return None
    return int(number) * unit_seconds[unit] / 86400


def keep_retained(usage: DataFrame, as_of: dt.datetime, setting: str | int | None) -> DataFrame:
    """Keep side of the retention job; an invalid setting keeps everything."""
    days = retention_days(setting)
    if days is None:
        return usage
    return usage.where(F.col("start_time") >= ntz(as_of - dt.timedelta(days=days)))


def unexpired(rows: DataFrame, as_of: dt.datetime, days: int, ts: str = "created_at") -> DataFrame:
    """Rows younger than *days* (30 for conversations, 90 for events)."""
    return rows.where(F.col(ts) > ntz(as_of - dt.timedelta(days=days)))


def keyset_page(rows: DataFrame, cursor: tuple[dt.datetime, int] | None, size: int,
                ts: str = "created_at", row_id: str = "request_id") -> DataFrame:
    """Newest-first page after *cursor* = (created_at, id) of the last row already seen."""
    if cursor is not None:
        at, last_id = cursor
        rows = rows.where((F.col(ts) < ntz(at)) | ((F.col(ts) == ntz(at)) & (F.col(row_id) < F.lit(last_id))))
    return rows.orderBy(F.desc(ts), F.desc(row_id)).limit(size)


def audit_search(audit: DataFrame, *, actor: str | None = None, action: str | None = None, table: str | None = None,
                 since: dt.datetime | None = None, until: dt.datetime | None = None, json_path: str | None = None,
                 needle: str | None = None, offset: int = 0, size: int = 50) -> DataFrame:
    """Audit rows by actor, action, table and time, and by a text inside the JSON before or after."""
    for column, value in (("changed_by", actor), ("action", action), ("table_name", table)):
        if value is not None:
            audit = audit.where(F.col(column) == value)
    audit = audit.where(in_closed_window("updated_at", since, until))
    if json_path and needle is not None:
        before = F.get_json_object("before_value", json_path).contains(needle)
        after = F.get_json_object("updated_values", json_path).contains(needle)
        audit = audit.where(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    return audit.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(size)


# ---- summaries -------------------------------------------------------------
def export_summary(daily: DataFrame) -> DataFrame:
    """Records, spend, tokens, distinct teams and models; a null counts as one more value."""
    def with_null(name: str) -> Column:
        return (F.count_distinct(name) + F.coalesce(F.max(F.col(name).isNull().cast("bigint")), F.lit(0))).cast("bigint")

    return daily.agg(
        F.count(F.lit(1)).alias("total_records"), sum_money("spend").alias("total_spend"),
        sum_count(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        with_null("team_id").alias("unique_teams"), with_null("model").alias("unique_models"))


def cost_by_provider_model_day(usage: DataFrame) -> DataFrame:
    """Daily cost per provider, model and set of tags; rows without cost are left out."""
    tags = F.to_json(F.sort_array(F.array_distinct(
        F.coalesce(F.from_json("request_tags", TAGS_TYPE), F.array().cast("array<string>")))))
    priced = usage.where((F.col("spend") != 0) & F.col("spend").isNotNull())
    named = priced.select(
        F.coalesce(F.when(F.col("provider") != "", F.col("provider")), F.lit("unknown")).alias("provider_name"),
        F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit("unknown")).alias("model_name"),
        day().alias("charge_day"), tags.alias("tags"), "spend")
    return named.groupBy("provider_name", "model_name", "charge_day", "tags").agg(sum_money("spend").alias("billed_cost"))


def cost_batches_by_day(records: DataFrame, stamp: str, amount: str) -> DataFrame:
    """Size of every per-day delivery batch; records whose time cannot be read are left out."""
    parsed = records.withColumn("_at", F.try_to_timestamp(F.col(stamp))).where(F.col("_at").isNotNull())
    return parsed.groupBy(F.to_date("_at").alias("batch_day")).agg(
        F.count(F.lit(1)).alias("records"), sum_money(amount).alias("batch_cost"))


def top_models(usage: DataFrame, n: int) -> DataFrame:
    return spend_by(usage, "model").orderBy(F.desc("total_spend"), "model").limit(n)


def top_keys(usage: DataFrame, n: int) -> DataFrame:
    """The highest-spending keys, one row per tag they used, most used tag first."""
    leaders = spend_by(usage, "api_key").orderBy(F.desc("total_spend"), "api_key").limit(n)
    tags = (usage.select("api_key", F.explode(F.from_json("request_tags", TAGS_TYPE)).alias("tag"))
            .join(leaders.select("api_key"), "api_key", "left_semi")
            .groupBy("api_key", "tag").agg(F.count(F.lit(1)).alias("uses")))
    by_use = Window.partitionBy("api_key").orderBy(F.desc("uses"), "tag")
    return leaders.join(tags.withColumn("tag_rank", F.row_number().over(by_use)), "api_key", "left")


def export_order_limit(daily: DataFrame, limit: int | None) -> DataFrame:
    """Newest days first, with a complete tie-break; the limit must not be negative."""
    if limit is not None and limit < 0:
        raise ValueError("limit must be non-negative")
    ordered = daily.orderBy(F.desc("day"), "user_id", "api_key", "model", "model_group", "provider")
    return ordered if limit is None else ordered.limit(limit)
