"""Billing export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import masking as M
from ledgerlight.operators import billing as B
from ledgerlight.plans.oracle_views import add_view
from ledgerlight.plans.registry import query
from ledgerlight.plans.reports import enriched
from ledgerlight.sources.adapters import Tables

add_view("enriched_daily", """
    SELECT d.*, k.team_id, key_alias AS api_key_alias, team_alias, user_email
    FROM user_daily d LEFT JOIN api_keys k ON d.api_key = k.token LEFT JOIN teams ON k.team_id = teams.team_id
    LEFT JOIN app_users u ON d.user_id = u.user_id""")

SERVICE = "usage-gateway"


def frame(t: Tables):
    return enriched(t).withColumnRenamed("provider", "custom_llm_provider")


COST_SQL = "CAST(CAST((spend_units + 5) // 10 AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6))"
TEXTS = {"BillingAccountType": "API Key", "BillingCurrency": "USD", "ChargeCategory": "Usage", "ChargeFrequency": "Usage-Based",
         "ConsumedUnit": "Requests", "PricingCurrency": "USD", "PricingUnit": "Requests",
         "ServiceCategory": "AI and Machine Learning", "ServiceSubcategory": "Generative AI"}
EMPTY_TEXTS = ("ChargeClass", "ContractedUnitPrice", "InvoiceId", "AvailabilityZone", "PricingCategory", "RegionId",
               "RegionName", "SubAccountType")
EMPTY_PRICES = ("ListUnitPrice", "PricingCurrencyContractedUnitPrice", "PricingCurrencyListUnitPrice")
COSTS = ("BilledCost", "ContractedCost", "EffectiveCost", "ListCost", "PricingCurrencyEffectiveCost")
TAGS_SQL = ("""'{' || array_to_string(list_filter([""" + ", ".join(
    f"""'"{name}":"' || {source} || '"'""" for name, source in (
        ("team_id", "team_id"), ("team_alias", "team_alias"), ("user_id", "user_id"), ("user_email", "user_email"),
        ("api_key_alias", "api_key_alias"), ("model", "model"), ("model_group", "model_group"),
        ("custom_llm_provider", "provider"))) + """], lambda x: x IS NOT NULL), ',') || '}'""")

NORMALIZE_SQL = "SELECT " + ", ".join(
    [f"{COST_SQL} AS {c}" for c in COSTS] + [f"'{v}' AS {k}" for k, v in TEXTS.items()]
    + [f"CAST(NULL AS VARCHAR) AS {c}" for c in EMPTY_TEXTS] + [f"CAST(NULL AS DECIMAL(18,6)) AS {c}" for c in EMPTY_PRICES]
    + ["CAST(1 AS DECIMAL(18,6)) AS ConsumedQuantity", "CAST(1 AS DECIMAL(18,6)) AS PricingQuantity",
       "api_key AS BillingAccountId", "api_key_alias AS BillingAccountName"]
    + [f"strftime(day, '%Y-%m-%dT00:00:00Z') AS {c}" for c in ("BillingPeriodStart", "ChargePeriodStart")]
    + [f"strftime(day + INTERVAL 1 DAY, '%Y-%m-%dT00:00:00Z') AS {c}" for c in ("BillingPeriodEnd", "ChargePeriodEnd")]
    + [f"provider AS {c}" for c in ("InvoiceIssuerName", "ProviderName", "PublisherName")]
    + [f"model AS {c}" for c in ("ChargeDescription", "ResourceId", "ResourceName", "ResourceType")]
    + ["model_group AS ServiceName", "team_id AS SubAccountId", "team_alias AS SubAccountName", f"{TAGS_SQL} AS Tags"]
) + " FROM enriched_daily"


@query("focus_normalize", NORMALIZE_SQL)
def focus_normalize(t: Tables):
    return B.normalize_frame(frame(t))


@query("focus_tags", f"SELECT tags, count(*)::BIGINT AS days FROM (SELECT {TAGS_SQL} AS tags FROM enriched_daily) GROUP BY 1")
def focus_tags(t: Tables):
    return frame(t).groupBy(B.tags_json(B.TAG_COLUMNS).alias("tags")).agg(F.count(F.lit(1)).alias("days"))


def component_sql(expression: str) -> str:
    return (f"coalesce(nullif(trim(regexp_replace(regexp_replace(lower({expression}), '[^a-zA-Z0-9-]', '-', 'g'), '-+', '-', 'g'),"
            f" '-'), ''), 'unknown')")


NAME_SQL = (f"'czrn:{SERVICE}:' || CASE replace(lower(provider), '_', '-') WHEN 'bedrock' THEN 'aws' WHEN 'gemini' THEN 'google'"
            f" ELSE {component_sql('''replace(lower(provider), '_', '-')''')} END || ':cross-region:' || {component_sql('team_id')}"
            f" || ':llm-usage:' || model")


@query("cbf_record", f"""
SELECT strftime(day, '%Y-%m-%dT00:00:00') AS usage_start, spend AS cost, {NAME_SQL} AS resource_id,
       prompt_tokens + completion_tokens AS usage_amount, 'tokens' AS usage_units, model_group AS resource_service,
       CASE WHEN coalesce(api_key_alias, '') <> '' THEN api_key_alias || '|' || left(api_key, 8) ELSE left(api_key, 8) END
         AS resource_account, 'cross-region' AS resource_region, provider AS resource_usage_family,
       coalesce(team_id, '') AS action_operation, 'Usage' AS lineitem_type,
       {component_sql("replace(lower(provider), '_', '-')")} AS tag_provider, model AS tag_model,
       coalesce(team_alias, team_id) AS tag_entity_id, user_email AS tag_user_email,
       CAST(api_requests AS VARCHAR) AS tag_api_requests,
       CAST(14 + CAST(team_alias IS NOT NULL AS INT) + CAST(coalesce(team_alias, team_id) IS NOT NULL AS INT)
            + CAST(api_key_alias IS NOT NULL AS INT) + CAST(user_email IS NOT NULL AS INT) - 2 AS INT) AS tag_count
FROM enriched_daily WHERE successful_requests > 0 AND provider IS NOT NULL AND model <> ''""")
def cbf_record(t: Tables):
    records = B.billing_records(frame(t), SERVICE)
    return records.select("*", F.try_element_at("tags", F.lit("entity_id")).alias("tag_entity_id"),
                          F.try_element_at("tags", F.lit("user_email")).alias("tag_user_email"),
                          F.try_element_at("tags", F.lit("api_requests")).alias("tag_api_requests"),
                          F.size("tags").alias("tag_count")).drop("tags")


@query("resource_name", f"""
SELECT provider, team_id, model, CASE WHEN model <> '' AND provider IS NOT NULL THEN {NAME_SQL} END AS resource_name, count(*)::BIGINT AS days
FROM enriched_daily GROUP BY 1, 2, 3, 4""")
def resource_name(t: Tables):
    counted = frame(t).groupBy(F.col("custom_llm_provider").alias("provider"), "team_id", "model").agg(
        F.count(F.lit(1)).alias("days"))
    return counted.withColumn("resource_name", B.resource_name(SERVICE, "provider", "team_id", "model"))


@query("resource_name_parts", f"""
SELECT resource_id, '{SERVICE}' AS service_type, {component_sql("replace(lower(provider), '_', '-')")} AS provider,
       'cross-region' AS region, {component_sql('team_id')} AS owner_account_id, 'llm-usage' AS resource_type,
       model AS cloud_local_id, rows
FROM (SELECT {NAME_SQL} AS resource_id, provider, team_id, model, count(*)::BIGINT AS rows FROM enriched_daily
      WHERE provider IS NOT NULL AND model <> '' GROUP BY ALL)""")
def resource_name_parts(t: Tables):
    # Names are built once for each of their parts, not for every row.
    parts = frame(t).groupBy("custom_llm_provider", "team_id", "model").agg(F.count(F.lit(1)).alias("rows"))
    named = parts.withColumn("resource_id", B.resource_name(SERVICE, "custom_llm_provider", "team_id", "model"))
    return B.resource_name_parts(named.groupBy("resource_id").agg(F.sum("rows").alias("rows")), "resource_id")


def metric_rows(t: Tables):
    """Usage with the fields a metric point needs; calls of the last line have no provider start time."""
    keys = t.keys().select("token", F.col("team_id").alias("key_team_id"), F.col("key_alias").alias("key_team_alias"))
    return (t.usage().join(keys, F.col("api_key") == F.col("token"), "left")
            .withColumn("team_alias", F.lit(None).cast("string")).withColumn("team_id", F.lit("fallback"))
            .withColumn("api_call_start_time", F.when(F.col("call_no") < 6, F.col("start_time"))))


def status_code():
    return F.when(F.col("status") == "success", "200").otherwise("500")


TAG_LIST_SQL = """list_filter(['env:prod', CASE WHEN coalesce(provider, '') <> '' THEN 'provider:' || provider END,
 CASE WHEN model <> '' THEN 'model_name:' || model END, 'model_group:' || model_group,
 'status_code:' || CASE WHEN status = 'success' THEN '200' ELSE '500' END,
 'team:' || coalesce(key_alias, team_id, 'fallback')], lambda x: x IS NOT NULL)"""


@query("metric_tags", f"""
SELECT array_to_string({TAG_LIST_SQL}, '|') AS tag_text, count(*)::BIGINT AS requests
FROM usage_rows LEFT JOIN api_keys ON api_key = token GROUP BY 1""")
def metric_tags(t: Tables):
    tags = B.metric_tags(["env:prod"], status_code())
    return metric_rows(t).groupBy(F.array_join(tags, "|").alias("tag_text")).agg(F.count(F.lit(1)).alias("requests"))


@query("metric_series", f"""
SELECT request_id, CAST(epoch(end_time) AS BIGINT) AS ts_seconds, metric, type, value, array_to_string(tags, '|') AS tags FROM (
 SELECT *, {TAG_LIST_SQL} AS tags FROM usage_rows LEFT JOIN api_keys ON api_key = token) AS u, LATERAL (
 SELECT 'gateway.request.total_latency' AS metric, 3 AS type, quantity::DOUBLE AS value
 UNION ALL SELECT 'gateway.llm_api.latency', 3, quantity::DOUBLE WHERE call_no < 6
 UNION ALL SELECT 'gateway.llm_api.request_count', 1, 1.0::DOUBLE)""")
def metric_series(t: Tables):
    series = B.metric_series(metric_rows(t), B.metric_tags(["env:prod"], status_code()))
    return series.withColumn("tags", F.array_join("tags", "|"))


@query("metering_event", """
SELECT request_id AS transaction_id, team_id AS external_subscription_id, 'tokens' AS code, model, spend AS response_cost,
       prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens, CAST(NULL AS VARCHAR) AS reason
FROM usage_rows JOIN api_keys ON api_key = token
UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no team_id'
FROM usage_rows WHERE api_key NOT IN (SELECT token FROM api_keys)""")
def metering_event(t: Tables):
    rows = t.usage().join(t.keys().select("token", "team_id"), F.col("api_key") == F.col("token"), "left")
    good, bad = B.metering_events(rows, "team_id", "tokens")
    return good.unionByName(bad.withColumnRenamed("request_id", "transaction_id"), allowMissingColumns=True)


@query("cloudevent", """
SELECT '1.0' AS specversion, 'tokens' AS type, request_id AS id, strftime(end_time, '%Y-%m-%dT%H:%M:%SZ') AS time,
       coalesce(CASE WHEN call_no % 2 = 0 THEN end_user END, user_id) AS subject, 'gateway' AS source,
       model AS data_model, prompt_tokens + completion_tokens AS data_total
FROM usage_full""")
def cloudevent(t: Tables):
    rows = (t.usage(with_user=True).withColumn("request_user", F.when(F.col("call_no") % 2 == 0, F.col("end_user")))
            .withColumn("key_owner", F.col("user_id")))
    events = B.cloud_events(rows, "tokens", "gateway")
    return events.select("*", F.get_json_object("data", "$.model").alias("data_model"),
                         F.get_json_object("data", "$.total_tokens").cast("bigint").alias("data_total")).drop("data")


@query("mask_secrets_by_key", """
SELECT c_custkey, left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) AS api_key,
       CASE WHEN length(c_mktsegment) < 8 THEN c_mktsegment
            ELSE left(c_mktsegment, 4) || repeat('*', length(c_mktsegment) - 8) || right(c_mktsegment, 4) END AS access_token,
       c_name AS max_tokens, c_name AS input_cost_per_token, c_mktsegment AS segment
FROM customer""")
def mask_secrets_by_key(t: Tables):
    config = F.create_map(
        F.lit("api_key"), F.col("c_name"), F.lit("access-token"), F.col("c_mktsegment"), F.lit("max_tokens"), F.col("c_name"),
        F.lit("input_cost_per_token"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    masked = t.raw("customer").select("c_custkey", M.mask_map(config).alias("m"))
    return masked.select("c_custkey", F.col("m")["api_key"].alias("api_key"), F.col("m")["access-token"].alias("access_token"),
                         F.col("m")["max_tokens"].alias("max_tokens"),
                         F.col("m")["input_cost_per_token"].alias("input_cost_per_token"), F.col("m")["segment"].alias("segment"))


@query("payload_fields", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS inner_type, user_id AS inner_user,
       CAST(NULL AS VARCHAR) AS missing FROM events""")
def payload_fields(t: Tables):
    payload = F.to_json(F.struct(F.struct("event_type", "user_id", F.struct("props").alias("raw")).alias("body")))
    rows = t.raw("events").select("event_id", payload.alias("payload"))
    fields = M.payload_fields("payload", {"inner_type": "body.event_type", "inner_user": "body.user_id",
                                          "props": "body.raw.props", "missing": "body.none.here"})
    return rows.select("event_id", *fields).select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "inner_type",
        F.col("inner_user").cast("bigint").alias("inner_user"), "missing")


@query("payload_prune", """
SELECT event_id, '{"body":{"event_type":"' || event_type || '"},"id":' || event_id || '}' AS pruned FROM events""")
def payload_prune(t: Tables):
    payload = F.to_json(F.struct(F.struct("event_type", "user_id", F.struct("value").alias("raw")).alias("body"),
                                 F.col("event_id").alias("id")))
    return t.raw("events").select("event_id", M.payload_prune(payload, ["body.user_id", "body.raw"]).alias("pruned"))


@query("json_fields", """
SELECT conv_id, turn, role || chr(10) || text AS extracted FROM conversations""")
def json_fields(t: Tables):
    payload = F.to_json(F.struct(F.array(F.struct("role", "text")).alias("messages")))
    return t.raw("conversations").select(
        "conv_id", "turn", M.json_text(payload, ["$.messages[0].role", "$.messages[0].text", "$.none"]).alias("extracted"))
