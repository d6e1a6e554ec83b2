"""Queries over the usage log: scans, filters, joins, spend views, rollups, breakdowns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.functions.money import sum_money
from ledgerlight.operators import rollups as R
from ledgerlight.operators import usage_reports as U
from ledgerlight.plans.registry import query
from ledgerlight.sources.adapters import EVENTS_AS_OF, USAGE_AS_OF, Tables

MONEY = "CAST(coalesce(sum(spend_units), 0) AS DOUBLE) / 10000000.0"
SINCE_30D = USAGE_AS_OF - dt.timedelta(days=30)
LAST_30D = f"start_time >= TIMESTAMP '{SINCE_30D}'"
WINDOW_START, WINDOW_END = dt.datetime(1998, 1, 1), dt.datetime(1999, 12, 31)
HALF_OPEN = "start_time >= TIMESTAMP '1998-01-01' AND start_time < TIMESTAMP '2000-01-01'"


def recent(t: Tables, with_user: bool = False):
    return t.usage(since=SINCE_30D, with_user=with_user)


def windowed(t: Tables, with_user: bool = False):
    return t.usage(since=WINDOW_START, until=WINDOW_END + dt.timedelta(days=1), with_user=with_user)


# ---- scans and filters -----------------------------------------------------
@query("usage_scan", f"""
SELECT request_id, api_key, model, start_time, spend, prompt_tokens, completion_tokens
FROM usage_rows WHERE {HALF_OPEN}""")
def usage_scan(t: Tables):
    return windowed(t).select("request_id", "api_key", "model", "start_time", "spend",
                              "prompt_tokens", "completion_tokens")


@query("window_filter_halfopen", f"""
SELECT status, count(*)::BIGINT AS requests, {MONEY} AS spend FROM usage_rows WHERE {HALF_OPEN} GROUP BY status""")
def window_filter_halfopen(t: Tables):
    rows = windowed(t).where(U.in_half_open_days("start_time", WINDOW_START, WINDOW_END))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("requests"), sum_money("spend").alias("spend"))


@query("window_filter_closed", """
SELECT event_type, count(*)::BIGINT AS events FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type""")
def window_filter_closed(t: Tables):
    rows = t.raw("events").where(U.in_closed_window(
        "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 12)))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("retention_filter", """
SELECT CAST(start_time AS DATE) AS day, count(*)::BIGINT AS kept FROM usage_rows
WHERE start_time >= TIMESTAMP '2001-11-05' - INTERVAL 365 DAY GROUP BY 1""")
def retention_filter(t: Tables):
    rows = t.usage(since=USAGE_AS_OF - dt.timedelta(days=365))
    return U.keep_retained(rows, USAGE_AS_OF, "365d").groupBy(U.day().alias("day")).agg(
        F.count(F.lit(1)).alias("kept"))


@query("expiry_filter", """
SELECT 'conversation' AS kind, count(*)::BIGINT AS live, min(created_at) AS oldest FROM telemetry
WHERE created_at > TIMESTAMP '2024-02-10' - INTERVAL 30 DAY
UNION ALL
SELECT 'event', count(*)::BIGINT, min(created_at) FROM telemetry
WHERE created_at > TIMESTAMP '2024-02-10' - INTERVAL 90 DAY""")
def expiry_filter(t: Tables):
    as_of = dt.datetime(2024, 2, 10)
    parts = [U.unexpired(t.telemetry(), as_of, days).agg(
        F.count(F.lit(1)).alias("live"), F.min("created_at").alias("oldest")).select(
        F.lit(kind).alias("kind"), "live", "oldest") for kind, days in (("conversation", 30), ("event", 90))]
    return parts[0].unionByName(parts[1])


@query("keyset_page", """
SELECT request_id, created_at, event_type, risk FROM telemetry
WHERE (created_at, request_id) < (TIMESTAMP '2024-01-15 00:00:00', 0)
ORDER BY created_at DESC, request_id DESC LIMIT 50""")
def keyset_page(t: Tables):
    page = U.keyset_page(t.telemetry(), (dt.datetime(2024, 1, 15), 0), 50)
    return page.select("request_id", "created_at", "event_type", "risk")


@query("audit_search", """
SELECT id, updated_at, changed_by, action, object_id FROM (
  SELECT o_orderkey AS id, o_orderdate AS updated_at, 'u' || (o_custkey % 20) AS changed_by,
         CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'O' THEN 'created' ELSE 'updated' END AS action,
         'c' || o_custkey AS object_id, o_orderpriority AS before_text,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'tier-' || (o_custkey % 9) END AS after_text
  FROM orders)
WHERE action = 'updated' AND updated_at >= TIMESTAMP '1996-01-01' AND updated_at <= TIMESTAMP '1999-01-01'
  AND (contains(before_text, 'URGENT') OR coalesce(contains(after_text, 'URGENT'), false))
ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 50""")
def audit_search(t: Tables):
    orders = t.raw("orders")
    action = (F.when(F.col("o_orderstatus") == "F", "deleted").when(F.col("o_orderstatus") == "O", "created")
              .otherwise("updated"))
    audit = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 20).cast("string")).alias("changed_by"),
        action.alias("action"), F.lit("keys").alias("table_name"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("object_id"),
        F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("tier")).alias("metadata"))).alias("before_value"),
        F.when(F.col("o_orderstatus") != "F", F.to_json(F.struct(F.struct(F.concat(
            F.lit("tier-"), (F.col("o_custkey") % 9).cast("string")).alias("tier")).alias("metadata")))
               ).alias("updated_values"))
    found = U.audit_search(audit, action="updated", table="keys", since=dt.datetime(1996, 1, 1),
                           until=dt.datetime(1999, 1, 1), json_path="$.metadata.tier", needle="URGENT",
                           offset=50, size=50)
    return found.select("id", "updated_at", "changed_by", "action", "object_id")


# ---- spend views -----------------------------------------------------------
@query("cache_activity", """
SELECT coalesce(key_alias, 'Unnamed Key') AS api_key_alias, call_type, model, count(*)::BIGINT AS total_rows,
       sum(CASE WHEN cache_hit = 'True' THEN 1 ELSE 0 END)::BIGINT AS cache_hit_true_rows,
       sum(CASE WHEN cache_hit = 'True' THEN completion_tokens ELSE 0 END)::BIGINT AS cached_completion_tokens,
       sum(CASE WHEN cache_hit <> 'True' THEN completion_tokens ELSE 0 END)::BIGINT AS generated_completion_tokens
FROM usage_rows LEFT JOIN api_keys ON api_key = token GROUP BY 1, 2, 3""")
def cache_activity(t: Tables):
    return U.cache_activity(t.usage(), t.keys())


@query("daily_global_spend", f"""
SELECT CAST(start_time AS DATE) AS day, {MONEY} AS total_spend FROM usage_rows WHERE {LAST_30D} GROUP BY 1""")
def daily_global_spend(t: Tables):
    return U.spend_by(U.last_days(recent(t), USAGE_AS_OF), U.day().alias("day"))


@query("last30d_keys", f"""
SELECT api_key, key_alias, key_name, {MONEY} AS total_spend
FROM usage_rows LEFT JOIN api_keys ON api_key = token WHERE {LAST_30D} GROUP BY 1, 2, 3""")
def last30d_keys(t: Tables):
    return U.last30d_keys(recent(t), t.keys())


@query("last30d_models", f"""
SELECT model, {MONEY} AS total_spend FROM usage_rows WHERE {LAST_30D} AND model <> '' GROUP BY 1""")
def last30d_models(t: Tables):
    return U.last30d_models(recent(t))


@query("daily_spend_per_key", f"""
SELECT CAST(start_time AS DATE) AS day, api_key, {MONEY} AS total_spend
FROM usage_rows WHERE {LAST_30D} GROUP BY 1, 2""")
def daily_spend_per_key(t: Tables):
    return U.spend_by(recent(t), U.day().alias("day"), "api_key")


@query("daily_spend_per_user_key", f"""
SELECT CAST(start_time AS DATE) AS day, user_id, api_key, {MONEY} AS total_spend
FROM usage_full WHERE {LAST_30D} GROUP BY 1, 2, 3""")
def daily_spend_per_user_key(t: Tables):
    return U.spend_by(recent(t, with_user=True), U.day().alias("day"), "user_id", "api_key")


@query("daily_tag_spend", f"""
SELECT individual_request_tag, CAST(start_time AS DATE) AS spend_date, count(*)::BIGINT AS log_count,
       {MONEY} AS total_spend
FROM (SELECT unnest(tags) AS individual_request_tag, start_time, spend_units FROM usage_full) GROUP BY 1, 2""")
def daily_tag_spend(t: Tables):
    return U.tag_spend(t.usage(with_user=True))


@query("top_end_users", f"""
SELECT end_user, count(*)::BIGINT AS total_events, {MONEY} AS total_spend
FROM usage_full WHERE {LAST_30D} AND end_user <> '' AND end_user <> user_id
GROUP BY end_user ORDER BY total_spend DESC, end_user LIMIT 100""")
def top_end_users(t: Tables):
    return U.top_end_users(recent(t, with_user=True))


@query("top_models", f"""
SELECT model, {MONEY} AS total_spend FROM usage_rows GROUP BY model ORDER BY total_spend DESC, model LIMIT 10""")
def top_models(t: Tables):
    return U.top_models(t.usage(), 10)


@query("top_keys", f"""
SELECT api_key, total_spend, tag, uses, tag_rank FROM
 (SELECT api_key, {MONEY} AS total_spend FROM usage_full GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) AS leaders
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY uses DESC, tag)::INT AS tag_rank FROM
   (SELECT api_key, tag, count(*)::BIGINT AS uses
    FROM (SELECT api_key, unnest(tags) AS tag FROM usage_full) GROUP BY 1, 2)) AS used USING (api_key)""")
def top_keys(t: Tables):
    return U.top_keys(t.usage(with_user=True), 5)


# ---- joins -----------------------------------------------------------------
@query("key_view", """
SELECT k.project_id, k.team_id, token, key_alias, key_name, team_max_budget, team_tpm_limit, team_rpm_limit, project_alias
FROM api_keys k LEFT JOIN teams USING (team_id) LEFT JOIN projects ON k.project_id = projects.project_id""")
def key_view(t: Tables):
    return U.key_view(t.keys(), t.teams(), t.projects())


DAILY_COLUMNS = ("user_id, day, api_key, model, model_group, provider, spend, prompt_tokens, completion_tokens, "
                 "api_requests, successful_requests, failed_requests, cache_read_tokens, cache_creation_tokens")


def user_daily(t: Tables):
    return R.daily_rollup(t.usage(with_user=True), "user_id")


def enriched(t: Tables):
    return U.enrich_daily(user_daily(t), t.keys(), t.teams(), t.users())


ENRICHED_SQL = f"""
SELECT {DAILY_COLUMNS.replace("user_id", "d.user_id")}, k.team_id, key_alias AS api_key_alias, team_alias, user_email
FROM user_daily d LEFT JOIN api_keys k ON d.api_key = k.token LEFT JOIN teams ON k.team_id = teams.team_id
LEFT JOIN app_users u ON d.user_id = u.user_id"""


@query("usage_enriched", ENRICHED_SQL)
def usage_enriched(t: Tables):
    return enriched(t)


@query("session_history", """
SELECT session_id, request_id, end_time, model, status FROM usage_rows WHERE session_id IN (
  SELECT session_id FROM usage_rows WHERE spend = (SELECT max(spend) FROM usage_rows))""")
def session_history(t: Tables):
    rows = t.usage().select("session_id", "request_id", "end_time", "model", "status", "spend")
    top = rows.agg(F.max("spend").alias("spend"))
    anchors = rows.join(top, "spend", "left_semi").select("request_id")
    return U.session_history(rows.drop("spend"), anchors)


@query("backfill_team", """
SELECT coalesce(own_team, team_id) AS team_id, count(*)::BIGINT AS requests, count(own_team)::BIGINT AS already_set
FROM (SELECT *, CASE WHEN call_no > 5 THEN 't99' END AS own_team FROM usage_rows)
LEFT JOIN api_keys ON api_key = token GROUP BY 1""")
def backfill_team(t: Tables):
    rows = t.usage().withColumn("team_id", F.when(F.col("call_no") > 5, F.lit("t99")))
    rows = rows.withColumn("own_team", F.col("team_id"))
    return U.backfill_team(rows, t.keys()).groupBy("team_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count("own_team").alias("already_set"))


# ---- rollups ---------------------------------------------------------------
ROLLUP_MEASURES = f"""{MONEY} AS spend, sum(prompt_tokens)::BIGINT AS prompt_tokens,
 sum(completion_tokens)::BIGINT AS completion_tokens, count(*)::BIGINT AS api_requests,
 count(*) FILTER (WHERE status = 'success')::BIGINT AS successful_requests,
 count(*) FILTER (WHERE status <> 'success')::BIGINT AS failed_requests,
 coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens,
 coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens"""


def rollup_sql(entity: str, source: str) -> str:
    return (f"SELECT {entity}, CAST(start_time AS DATE) AS day, api_key, model, model_group, provider, {ROLLUP_MEASURES} "
            f"FROM {source} WHERE {entity} IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6")


OWNED = "usage_rows JOIN api_keys ON api_key = token LEFT JOIN teams USING (team_id)"


@query("rollup_user", rollup_sql("user_id", "usage_full"))
def rollup_user(t: Tables):
    return user_daily(t)


@query("rollup_team", rollup_sql("team_id", OWNED))
def rollup_team(t: Tables):
    return R.rollup_by_key_owner(t.usage(), t.keys(), t.teams(), "team_id")


@query("rollup_org", rollup_sql("organization_id", OWNED))
def rollup_org(t: Tables):
    return R.rollup_by_key_owner(t.usage(), t.keys(), t.teams(), "organization_id")


@query("rollup_tag", rollup_sql("tag", "(SELECT *, unnest(tags) AS tag FROM usage_full)"))
def rollup_tag(t: Tables):
    return R.rollup_tag(t.usage(with_user=True))


@query("rollup_end_user", rollup_sql("end_user", "usage_full"))
def rollup_end_user(t: Tables):
    return R.daily_rollup(t.usage(with_user=True), "end_user")


@query("rollup_agent", rollup_sql("agent_id", "usage_rows"))
def rollup_agent(t: Tables):
    return R.daily_rollup(t.usage(), "agent_id")


ENTITY_SQL = f"""
SELECT entity_type, coalesce(entity_id, '') AS entity_id, {MONEY} AS response_cost FROM (
 SELECT 'key' AS entity_type, api_key AS entity_id, spend_units FROM usage_full
 UNION ALL SELECT 'user', user_id, spend_units FROM usage_full
 UNION ALL SELECT 'end_user', end_user, spend_units FROM usage_full
 UNION ALL SELECT 'agent', agent_id, spend_units FROM usage_full
 UNION ALL SELECT 'team', team_id, spend_units FROM usage_full LEFT JOIN api_keys ON api_key = token
 UNION ALL SELECT 'org', organization_id, spend_units FROM usage_full LEFT JOIN api_keys ON api_key = token
           LEFT JOIN teams USING (team_id)) GROUP BY 1, 2"""


def pending(t: Tables):
    summed = R.summed_spend(t.usage(with_user=True), ["api_key", "user_id", "end_user", "agent_id", "model"])
    rows = R.with_entity_columns(summed, t.keys(), t.teams())
    return R.deltas(rows, {k: R.ENTITY_COLUMNS[k] for k in ("key", "user", "end_user", "agent", "team", "org")}
                    | {"unknown_kind": "model"})


@query("entity_totals", ENTITY_SQL)
def entity_totals(t: Tables):
    return R.compact(pending(t)).drop("merged")


@query("queue_compaction", f"""
SELECT entity_type, entity_id, {MONEY} AS response_cost, count(*)::BIGINT AS merged FROM (
 SELECT 'key' AS entity_type, api_key AS entity_id, spend_units, start_time FROM usage_rows
 UNION ALL SELECT 'agent', coalesce(agent_id, ''), spend_units, start_time FROM usage_rows)
GROUP BY 1, 2""")
def queue_compaction(t: Tables):
    return R.compact(R.deltas(R.summed_spend(t.usage(), ["api_key", "agent_id"]), {"key": "api_key", "agent": "agent_id"}))


@query("upsert_increment", """
SELECT api_key, CAST(start_time AS DATE) AS day, count(*)::BIGINT AS api_requests,
       sum(prompt_tokens)::BIGINT AS prompt_tokens FROM usage_rows GROUP BY 1, 2""")
def upsert_increment(t: Tables):
    cut = dt.datetime(2000, 1, 1)
    halves = [rows.groupBy("api_key", U.day().alias("day")).agg(
        F.count(F.lit(1)).alias("api_requests"), F.sum("prompt_tokens").alias("prompt_tokens"))
        for rows in (t.usage(until=cut), t.usage(since=cut))]
    return R.upsert_increment(halves[0], halves[1], ["api_key", "day"], ["api_requests", "prompt_tokens"])


# ---- activity --------------------------------------------------------------
def key_owners(t: Tables):
    return t.keys().select(F.col("token").alias("api_key"), F.col("team_id").alias("entity"))


BREAKDOWN_SQL = f"""
SELECT day, CASE grouping_id(model, model_group, provider, endpoint, mcp_server, api_key, entity)
  WHEN 127 THEN 'total' WHEN 63 THEN 'model' WHEN 95 THEN 'model_group' WHEN 111 THEN 'provider'
  WHEN 119 THEN 'endpoint' WHEN 123 THEN 'mcp_server' WHEN 125 THEN 'api_key' ELSE 'entity' END AS dimension,
  CASE grouping_id(model, model_group, provider, endpoint, mcp_server, api_key, entity)
  WHEN 63 THEN model WHEN 95 THEN model_group WHEN 111 THEN provider WHEN 119 THEN endpoint
  WHEN 123 THEN mcp_server WHEN 125 THEN api_key WHEN 126 THEN entity END AS value, {ROLLUP_MEASURES}
FROM (SELECT *, CAST(start_time AS DATE) AS day, call_type AS endpoint, team_id AS entity
      FROM usage_rows LEFT JOIN api_keys ON api_key = token)
GROUP BY GROUPING SETS ((day), (day, model), (day, model_group), (day, provider), (day, endpoint), (day, mcp_server),
                        (day, api_key), (day, entity)), day"""


@query("daily_activity_breakdown", BREAKDOWN_SQL)
def daily_activity_breakdown(t: Tables):
    return R.daily_activity_breakdown(t.usage().withColumn("endpoint", F.col("call_type")), key_owners(t))


@query("daily_activity_totals", """
SELECT CAST(sum(spend_units) AS DOUBLE) / 10000000.0 AS total_spend, sum(prompt_tokens)::BIGINT AS total_prompt_tokens,
 sum(completion_tokens)::BIGINT AS total_completion_tokens, sum(api_requests)::BIGINT AS total_api_requests,
 sum(successful_requests)::BIGINT AS total_successful_requests, sum(failed_requests)::BIGINT AS total_failed_requests,
 sum(cache_read_tokens)::BIGINT AS total_cache_read_tokens,
 sum(cache_creation_tokens)::BIGINT AS total_cache_creation_tokens,
 sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, ceil(count(*) / 1000.0)::BIGINT AS total_pages
FROM user_daily""")
def daily_activity_totals(t: Tables):
    return R.daily_activity_totals(user_daily(t), 1000)


@query("key_breakdown_per_metric", f"""
SELECT model, api_key, {ROLLUP_MEASURES}, any_value(key_alias) AS key_alias, any_value(team_id) AS team_id
FROM usage_rows LEFT JOIN api_keys ON api_key = token GROUP BY model, api_key""")
def key_breakdown_per_metric(t: Tables):
    daily = t.usage().withColumn("day", U.day()).groupBy("day", "api_key", "model").agg(*R.measures())
    return R.key_breakdown(daily, "model", t.keys())


@query("endpoint_totals", f"SELECT call_type AS endpoint, {ROLLUP_MEASURES} FROM usage_rows GROUP BY 1")
def endpoint_totals(t: Tables):
    return R.endpoint_totals(t.usage())


@query("spend_report", """
WITH per_team AS (
 SELECT CAST(start_time AS DATE) AS day, team_id, team_alias, count(DISTINCT api_key)::BIGINT AS keys_used,
        sum(spend_units) AS units
 FROM usage_rows LEFT JOIN api_keys ON api_key = token LEFT JOIN teams USING (team_id) GROUP BY 1, 2, 3)
SELECT day, team_id, team_alias, keys_used, CAST(units AS DOUBLE) / 10000000.0 AS total_spend,
       CAST(sum(units) OVER (PARTITION BY day) AS DOUBLE) / 10000000.0 AS day_spend FROM per_team""".replace(
    "WITH per_team AS (", "SELECT * FROM (WITH per_team AS (") + ")")
def spend_report(t: Tables):
    return R.spend_report(t.usage(), t.keys(), t.teams())


@query("cost_by_provider_model_day", f"""
SELECT coalesce(provider, 'unknown') AS provider_name, CASE WHEN model = '' THEN 'unknown' ELSE model END AS model_name,
       CAST(start_time AS DATE) AS charge_day,
       '[' || array_to_string(list_transform(list_sort(list_distinct(coalesce(tags, []))), lambda x: '"' || x || '"'), ',')
       || ']' AS tags, {MONEY} AS billed_cost
FROM usage_full WHERE spend_units <> 0 GROUP BY 1, 2, 3, 4""")
def cost_by_provider_model_day(t: Tables):
    return U.cost_by_provider_model_day(t.usage(with_user=True))


@query("cost_batches_by_day", f"""
SELECT CAST(start_time AS DATE) AS batch_day, count(*)::BIGINT AS records, {MONEY} AS batch_cost
FROM usage_rows WHERE call_no <> 7 GROUP BY 1""")
def cost_batches_by_day(t: Tables):
    stamp = F.when(F.col("call_no") == 7, F.lit("not a time")).otherwise(
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return U.cost_batches_by_day(t.usage().withColumn("usage_time", stamp), "usage_time", "spend")


@query("export_summary", f"""
SELECT count(*)::BIGINT AS total_records, {MONEY} AS total_spend,
       sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens,
       (count(DISTINCT team_id) + max(CASE WHEN team_id IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_teams,
       (count(DISTINCT model) + max(CASE WHEN model IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_models
FROM user_daily LEFT JOIN api_keys ON api_key = token""")
def export_summary(t: Tables):
    return U.export_summary(enriched(t))


@query("export_order_limit", f"""
SELECT {DAILY_COLUMNS} FROM user_daily ORDER BY day DESC, user_id, api_key, model, model_group, provider NULLS FIRST
LIMIT 200""")
def export_order_limit(t: Tables):
    return U.export_order_limit(user_daily(t), 200)


@query("usage_export", f"""
SELECT CAST(start_time AS DATE) AS day, team_id, model, {ROLLUP_MEASURES}
FROM usage_rows JOIN api_keys ON api_key = token GROUP BY 1, 2, 3""")
def usage_export(t: Tables):
    return R.usage_export(R.rollup_by_key_owner(t.usage(), t.keys(), t.teams(), "team_id"), "team_id", "daily_model")


@query("usage_export_summary", f"""
SELECT {MONEY} AS total_spend, count(*)::BIGINT AS total_requests,
       count(*) FILTER (WHERE status = 'success')::BIGINT AS total_successful,
       count(*) FILTER (WHERE status <> 'success')::BIGINT AS total_failed,
       count(DISTINCT team_id)::BIGINT AS entities, min(CAST(start_time AS DATE)) AS first_day,
       max(CAST(start_time AS DATE)) AS last_day
FROM usage_rows JOIN api_keys ON api_key = token""")
def usage_export_summary(t: Tables):
    return R.usage_export_summary(R.rollup_by_key_owner(t.usage(), t.keys(), t.teams(), "team_id"), "team_id")


EVENTS_NOW = EVENTS_AS_OF
