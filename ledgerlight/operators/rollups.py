"""Daily rollups, totals per entity, increments and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.money import count_if, from_units, sum_count, sum_money, to_units
from ledgerlight.operators.usage_reports import TAGS_TYPE, day

ROLLUP_DIMS = ("day", "api_key", "model", "model_group", "provider")
COUNTERS = ("prompt_tokens", "completion_tokens", "api_requests", "successful_requests", "failed_requests",
            "cache_read_tokens", "cache_creation_tokens")


def measures(prefix: str = "") -> list[Column]:
    """The eight measures of a rollup, from request rows."""
    ok = F.col("status") == "success"
    return [
        sum_money("spend").alias(f"{prefix}spend"),
        sum_count("prompt_tokens").alias(f"{prefix}prompt_tokens"),
        sum_count("completion_tokens").alias(f"{prefix}completion_tokens"),
        F.count(F.lit(1)).alias(f"{prefix}api_requests"),
        count_if(ok).alias(f"{prefix}successful_requests"),
        count_if(~ok).alias(f"{prefix}failed_requests"),
        sum_count("cache_read_tokens").alias(f"{prefix}cache_read_tokens"),
        sum_count("cache_creation_tokens").alias(f"{prefix}cache_creation_tokens"),
    ]


def merged_measures() -> list[Column]:
    """The same measures from rows that already carry them."""
    return [sum_money("spend").alias("spend"), *[sum_count(c).alias(c) for c in COUNTERS]]


def daily_rollup(usage: DataFrame, entity: str) -> DataFrame:
    """entity × day × key × model × model group × provider; rows without the entity are left out."""
    rows = usage.where(F.col(entity).isNotNull()).withColumn("day", day())
    return rows.groupBy(entity, *ROLLUP_DIMS).agg(*measures())


def with_entity_columns(usage: DataFrame, keys: DataFrame, teams: DataFrame) -> DataFrame:
    """Team and organisation of the key."""
    owner = (keys.select("token", "team_id")
             .join(teams.select("team_id", "organization_id"), "team_id", "left"))
    return usage.join(owner, F.col("api_key") == F.col("token"), "left").drop("token")


def rollup_by_key_owner(usage: DataFrame, keys: DataFrame, teams: DataFrame, entity: str) -> DataFrame:
    """Rollup for an entity that follows from the key (team, organisation).

    The key is a rollup dimension anyway, so the requests are summed first and
    the owner is joined to the sums.
    """
    summed = usage.withColumn("day", day()).groupBy(*ROLLUP_DIMS).agg(*measures())
    owned = with_entity_columns(summed, keys, teams).where(F.col(entity).isNotNull())
    return owned.groupBy(entity, *ROLLUP_DIMS).agg(*merged_measures())


def rollup_tag(usage: DataFrame) -> DataFrame:
    """Requests are summed by the text of their tag list; each different text is parsed, and its sums exploded, once."""
    summed = usage.where(F.col("request_tags").isNotNull()).withColumn("day", day()).groupBy("request_tags", *ROLLUP_DIMS).agg(*measures())
    tagged = summed.withColumn("tag", F.explode(F.from_json("request_tags", TAGS_TYPE))).where(F.col("tag").isNotNull())
    return tagged.groupBy("tag", *ROLLUP_DIMS).agg(*merged_measures())


# ---- entity totals and compaction -----------------------------------------
ENTITY_COLUMNS = {
    "key": "api_key", "user": "user_id", "end_user": "end_user", "team": "team_id",
    "team_member": "team_member", "org": "organization_id", "tag": "tag", "agent": "agent_id",
}


def summed_spend(usage: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spend and number of requests of every combination of entities, before any of them is taken apart."""
    return usage.groupBy(*columns).agg(sum_money("spend").alias("spend"), F.count(F.lit(1)).alias("merged"))


def deltas(usage: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One pending (entity_type, entity_id, response_cost, merged) row per row of *usage* and entity column.

    Rows may be requests or sums of them; *merged* is the number of requests in a row, if there is such a column.
    """
    merged = F.col("merged") if "merged" in usage.columns else F.lit(1).cast("bigint")
    pairs = F.array(*[F.struct(F.lit(kind).alias("entity_type"), F.col(col).cast("string").alias("entity_id"))
                      for kind, col in columns.items()])
    return usage.select(F.explode(pairs).alias("pair"), F.col("spend").alias("response_cost"), merged.alias("merged")).select(
        "pair.entity_type", "pair.entity_id", "response_cost", "merged")


def compact(pending: DataFrame) -> DataFrame:
    """Merge pending deltas by (type, id); a missing type is skipped, a missing id becomes ''."""
    known = pending.where(F.col("entity_type").isin(*ENTITY_COLUMNS))
    return known.groupBy("entity_type", F.coalesce("entity_id", F.lit("")).alias("entity_id")).agg(
        sum_money("response_cost").alias("response_cost"), F.sum("merged").alias("merged"))


def upsert_increment(stored: DataFrame, delta: DataFrame, key: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Stored counters plus deltas, one row per key."""
    columns = [*key, *counters]
    return stored.select(*columns).unionByName(delta.select(*columns)).groupBy(*key).agg(
        *[sum_count(c).alias(c) for c in counters])


# ---- activity --------------------------------------------------------------
BREAKDOWNS = ("model", "model_group", "provider", "endpoint", "mcp_server", "api_key", "entity")


def daily_activity_breakdown(usage: DataFrame, owners: DataFrame, dims: Sequence[str] = BREAKDOWNS) -> DataFrame:
    """Totals per day and, for each dimension, per day and value — one scan by grouping sets.

    The requests are first summed over all dimensions together, so that the
    grouping-set expansion and the join with *owners* (api_key, entity) handle
    sums and not requests.
    """
    own = [d for d in dims if d != "entity"]
    summed = usage.withColumn("day", day()).groupBy("day", *own).agg(*measures())
    if "entity" in dims:
        summed = summed.join(owners.select("api_key", "entity"), "api_key", "left")
    sets = [["day"], *[["day", d] for d in dims]]
    levels = summed.groupingSets(sets, "day", *dims).agg(
        *merged_measures(), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dimension = F.lit("total")
    value = F.lit(None).cast("string")
    for d in dims:
        dimension = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dimension)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return levels.select("day", dimension.alias("dimension"), value.alias("value"), "spend", *COUNTERS)


def daily_activity_totals(daily: DataFrame, page_size: int) -> DataFrame:
    """Nine grand totals with the number of pages the daily rows fill."""
    return daily.agg(
        *[m.alias(f"total_{n}") for m, n in zip(merged_measures(), ("spend", *COUNTERS))],
        sum_count(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.ceil(F.count(F.lit(1)) / F.lit(page_size)).cast("bigint").alias("total_pages"))


def key_breakdown(daily: DataFrame, dim: str, keys: DataFrame) -> DataFrame:
    """Metrics per key within each value of *dim*, with the alias and team of the key."""
    per_key = daily.groupBy(dim, "api_key").agg(*merged_measures())
    info = keys.select(F.col("token").alias("api_key"), "key_alias", "team_id")
    return per_key.join(info, "api_key", "left")


def endpoint_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.col("call_type").alias("endpoint")).agg(*measures())


def spend_report(usage: DataFrame, keys: DataFrame, teams: DataFrame) -> DataFrame:
    """Per day: each team with its spend, and the day's total beside it."""
    per_key = usage.groupBy(day().alias("day"), "api_key").agg(F.sum(to_units("spend")).alias("_units"))
    owners = keys.select("token", "team_id").join(teams.select("team_id", "team_alias"), "team_id", "left")
    per_team = (per_key.join(owners, F.col("api_key") == F.col("token"), "left")
                .groupBy("day", "team_id", "team_alias")
                .agg(F.sum("_units").alias("_units"), F.count(F.lit(1)).alias("keys_used")))
    per_day = per_team.groupBy("day").agg(F.sum("_units").alias("_day_units"))
    return per_team.join(per_day, "day").select(
        "day", "team_id", "team_alias", "keys_used", from_units("_units").alias("total_spend"),
        from_units("_day_units").alias("day_spend"))


def usage_export(daily: DataFrame, entity: str, scope: str) -> DataFrame:
    """Entity export at scope daily, daily_key or daily_model."""
    extra = {"daily": [], "daily_key": ["api_key"], "daily_model": ["model"]}[scope]
    return daily.groupBy("day", entity, *extra).agg(*merged_measures())


def usage_export_summary(daily: DataFrame, entity: str) -> DataFrame:
    return daily.agg(sum_money("spend").alias("total_spend"), sum_count("api_requests").alias("total_requests"),
                     sum_count("successful_requests").alias("total_successful"),
                     sum_count("failed_requests").alias("total_failed"),
                     F.count_distinct(entity).alias("entities"), F.min("day").alias("first_day"),
                     F.max("day").alias("last_day"))
