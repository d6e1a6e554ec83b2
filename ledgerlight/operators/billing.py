"""Billing exports: normalised cost frame, billing records, resource names, metrics, metering events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.money import as_col, to_units
from ledgerlight.functions.patterns import only

# Tag columns in export order, constants of the export frame, name format.
TAG_COLUMNS = ("team_id", "team_alias", "user_id", "user_email", "api_key_alias", "model", "model_group",
               "custom_llm_provider")
DECIMAL = "decimal(18,6)"
PERIOD_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
RESOURCE_NAME = r"^czrn:([a-z0-9-]+):([a-zA-Z0-9-]+):([a-z0-9-]+):([a-z0-9-]+):([a-z0-9-]+):(.+)$"
RESOURCE_PARTS = ("service_type", "provider", "region", "owner_account_id", "resource_type", "cloud_local_id")
# Provider names as resource names know them.
PROVIDER_NAMES = {
    "azure": "azure", "azure_ai": "azure", "anthropic": "anthropic", "bedrock": "aws", "vertex_ai": "gcp",
    "gemini": "google", "cohere": "cohere", "huggingface": "huggingface", "replicate": "replicate",
    "together_ai": "together-ai",
}


def tags_json(columns: Sequence[str]) -> Column:
    """JSON object of the non-null tag columns, values as text; '{}' when there is none."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "true"})


def normalize_frame(daily: DataFrame) -> DataFrame:
    """Daily usage to the normalised cost-and-usage frame (always the populated types)."""
    available = [c for c in TAG_COLUMNS if c in daily.columns]
    cost = (F.coalesce(to_units("spend"), F.lit(0)).cast("decimal(28,0)") / F.lit(10_000_000).cast("decimal(9,0)")).cast(DECIMAL)
    start = F.date_format(F.col("day"), PERIOD_FORMAT)
    end = F.date_format(F.date_add("day", 1), PERIOD_FORMAT)
    one = F.lit(1).cast(DECIMAL)
    no_text, no_price = F.lit(None).cast("string"), F.lit(None).cast(DECIMAL)
    provider = F.col("custom_llm_provider").cast("string")
    model = F.col("model").cast("string")
    return daily.select(
        cost.alias("BilledCost"), F.col("api_key").cast("string").alias("BillingAccountId"),
        F.col("api_key_alias").cast("string").alias("BillingAccountName"), F.lit("API Key").alias("BillingAccountType"),
        F.lit("USD").alias("BillingCurrency"), end.alias("BillingPeriodEnd"), start.alias("BillingPeriodStart"),
        F.lit("Usage").alias("ChargeCategory"), no_text.alias("ChargeClass"), model.alias("ChargeDescription"),
        F.lit("Usage-Based").alias("ChargeFrequency"), end.alias("ChargePeriodEnd"), start.alias("ChargePeriodStart"),
        one.alias("ConsumedQuantity"), F.lit("Requests").alias("ConsumedUnit"), cost.alias("ContractedCost"),
        no_text.alias("ContractedUnitPrice"), cost.alias("EffectiveCost"), provider.alias("InvoiceIssuerName"),
        no_text.alias("InvoiceId"), cost.alias("ListCost"), no_price.alias("ListUnitPrice"),
        no_text.alias("AvailabilityZone"), F.lit("USD").alias("PricingCurrency"), no_text.alias("PricingCategory"),
        one.alias("PricingQuantity"), no_price.alias("PricingCurrencyContractedUnitPrice"),
        cost.alias("PricingCurrencyEffectiveCost"), no_price.alias("PricingCurrencyListUnitPrice"),
        F.lit("Requests").alias("PricingUnit"), provider.alias("ProviderName"), provider.alias("PublisherName"),
        no_text.alias("RegionId"), no_text.alias("RegionName"), model.alias("ResourceId"), model.alias("ResourceName"),
        model.alias("ResourceType"), F.lit("AI and Machine Learning").alias("ServiceCategory"),
        F.lit("Generative AI").alias("ServiceSubcategory"), F.col("model_group").cast("string").alias("ServiceName"),
        F.col("team_id").cast("string").alias("SubAccountId"), F.col("team_alias").cast("string").alias("SubAccountName"),
        no_text.alias("SubAccountType"), tags_json(available).alias("Tags"))


# ---- resource names --------------------------------------------------------
def name_component(value: Column | str, allow_uppercase: bool = False) -> Column:
    """Letters, digits and single inner hyphens; anything else becomes a hyphen; empty is 'unknown'."""
    raw = as_col(value).cast("string")
    base = raw if allow_uppercase else F.lower(raw)
    clean = F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9-]", "-"), "-+", "-")
    clean = F.regexp_replace(clean, "^-|-$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def name_provider(provider: Column | str) -> Column:
    """Provider part.  Underscores turn to hyphens before the look-up, so entries
    with an underscore are never found and such a provider keeps its own name."""
    dashed = F.replace(F.lower(as_col(provider)), F.lit("_"), F.lit("-"))
    known = F.create_map(*[F.lit(part) for pair in PROVIDER_NAMES.items() for part in pair])
    return F.coalesce(F.try_element_at(known, dashed), dashed)


def resource_name(service: str, provider: Column | str, owner: Column | str, model: Column | str,
                  region: str = "cross-region", resource_type: str = "llm-usage") -> Column:
    """czrn:service:provider:region:owner:type:model; null where the provider or the result is not valid."""
    name = F.concat_ws(
        ":", F.lit("czrn"), name_component(F.lit(service), allow_uppercase=True),
        name_component(name_provider(provider)), name_component(F.lit(region)), name_component(owner),
        name_component(F.lit(resource_type)), F.coalesce(as_col(model), F.lit("None")))
    return F.when(as_col(provider).isNotNull(), F.nullif(F.regexp_extract(name, RESOURCE_NAME, 0), F.lit("")))


def resource_name_parts(df: DataFrame, column: str) -> DataFrame:
    """Six parts of every valid name; invalid names are left out."""
    return split_name(only(df, F.col(column).rlike(RESOURCE_NAME)), column)


def split_name(df: DataFrame, column: str) -> DataFrame:
    """Parts of names known to be valid: only the last part may contain a colon."""
    pieces = F.split(column, ":", 7)
    return df.withColumn("_pieces", pieces).select(*df.columns, *[
        F.col("_pieces")[i + 1].alias(part) for i, part in enumerate(RESOURCE_PARTS)])


# ---- billing records -------------------------------------------------------
def billing_records(daily: DataFrame, service: str) -> DataFrame:
    """Daily usage to billing records with a map of the meaningful tags.

    Rows without a successful request, provider, tokens or spend are left out.
    """
    kept = daily.where((F.col("successful_requests") > 0) & F.col("custom_llm_provider").isNotNull()
                       & F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
                       & F.col("spend").isNotNull())
    named = kept.withColumn("resource_id", resource_name(service, "custom_llm_provider", "team_id", "model"))
    parts = split_name(named, "resource_id").where(F.col("resource_id").isNotNull())
    prefix = F.substring("api_key", 1, 8)

    def known(column: str) -> Column:
        return F.when(F.col(column) != "", F.col(column))

    entity = F.coalesce(known("team_alias"), known("team_id"), F.lit("unknown"))
    dimensions = {
        "entity_type": F.lit("team"), "entity_id": entity, "team_alias": F.coalesce(known("team_alias"), F.lit("unknown")),
        "model": F.col("model"), "model_group": F.col("model_group"), "provider": F.col("custom_llm_provider"),
        "api_key_prefix": prefix, "api_key_alias": F.col("api_key_alias"), "user_email": F.col("user_email"),
        "api_requests": F.col("api_requests"), "successful_requests": F.col("successful_requests"),
        "failed_requests": F.col("failed_requests"), "cache_creation_tokens": F.col("cache_creation_tokens"),
        "cache_read_tokens": F.col("cache_read_tokens"),
        "prompt_tokens": F.when(F.col("prompt_tokens") > 0, F.col("prompt_tokens")),
        "completion_tokens": F.when(F.col("completion_tokens") > 0, F.col("completion_tokens")),
    }
    tags = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k in dimensions]),
                          F.array(*[v.cast("string") for v in dimensions.values()])),
        lambda _, v: v.isNotNull() & ~v.isin("", "N/A", "unknown"))
    return parts.select(
        F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("usage_start"), F.col("spend").alias("cost"), "resource_id",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("usage_amount"), F.lit("tokens").alias("usage_units"),
        F.col("model_group").alias("resource_service"),
        F.when(F.coalesce("api_key_alias", F.lit("")) != "", F.concat_ws("|", "api_key_alias", prefix))
        .otherwise(prefix).alias("resource_account"),
        F.col("region").alias("resource_region"), F.col("custom_llm_provider").alias("resource_usage_family"),
        F.coalesce("team_id", F.lit("")).alias("action_operation"), F.lit("Usage").alias("lineitem_type"),
        F.col("provider").alias("tag_provider"), F.col("cloud_local_id").alias("tag_model"), tags.alias("tags"))


# ---- metrics and metering --------------------------------------------------
def metric_tags(base: Sequence[str], status_code: Column) -> Column:
    """Tag list of a metric point; the team is the first known of four fields."""
    def tag(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}:"), value))

    def known(column: str) -> Column:
        return F.when(F.col(column) != "", F.col(column))

    team = F.coalesce(known("key_team_alias"), known("team_alias"), known("key_team_id"), known("team_id"))
    return F.array_compact(F.array(
        *[F.lit(b) for b in base], tag("provider", F.col("provider")), tag("model_name", F.col("model")),
        tag("model_group", F.col("model_group")), tag("status_code", status_code), tag("team", team)))


def metric_series(usage: DataFrame, tags: Column, prefix: str = "gateway") -> DataFrame:
    """Up to three points per request: total latency, provider latency and the count."""
    end = F.unix_micros(F.col("end_time").cast("timestamp"))
    start = F.unix_micros(F.col("start_time").cast("timestamp"))
    call = F.unix_micros(F.col("api_call_start_time").cast("timestamp"))

    def point(metric: str, kind: int, value: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(f"{prefix}.{metric}").alias("metric"), F.lit(kind).alias("type"),
                                        value.alias("value")))

    points = F.array_compact(F.array(
        point("request.total_latency", 3, (end - start) / 1e6, start.isNotNull() & end.isNotNull()),
        point("llm_api.latency", 3, (end - call) / 1e6, call.isNotNull() & end.isNotNull()),
        point("llm_api.request_count", 1, F.lit(1.0), F.lit(True))))
    return (usage.withColumn("tags", tags).withColumn("point", F.explode(points))
            .select("request_id", F.floor(end / 1_000_000).alias("ts_seconds"), "point.metric", "point.type",
                    "point.value", "tags"))


CHARGE_BY = {"end_user_id": "end_user", "user_id": "user_id", "team_id": "team_id"}


def metering_events(usage: DataFrame, charge_by: str, code: str) -> tuple[DataFrame, DataFrame]:
    """Billable events of the requests whose customer is known, and the rejected requests."""
    if charge_by not in CHARGE_BY:
        raise ValueError(f"charge_by must be one of {sorted(CHARGE_BY)}")
    customer = F.col(CHARGE_BY[charge_by])
    good = usage.where(customer.isNotNull()).select(
        F.col("request_id").alias("transaction_id"), customer.alias("external_subscription_id"), F.lit(code).alias("code"),
        "model", F.col("spend").alias("response_cost"), "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    bad = usage.where(customer.isNull()).select("request_id", F.lit(f"no {charge_by}").alias("reason"))
    return good, bad


def cloud_events(usage: DataFrame, event_type: str, source: str) -> DataFrame:
    """Event envelopes; the subject is the given user, else the owner of the key."""
    subject = F.coalesce(F.col("request_user"), F.col("key_owner"))
    data = F.to_json(F.struct(
        "model", F.col("spend").alias("cost"), "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens")))
    return usage.where(subject.isNotNull()).select(
        F.lit("1.0").alias("specversion"), F.lit(event_type).alias("type"), F.col("request_id").alias("id"),
        F.date_format("end_time", PERIOD_FORMAT).alias("time"), subject.cast("string").alias("subject"),
        F.lit(source).alias("source"), data.alias("data"))
