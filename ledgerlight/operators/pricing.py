"""Price every request of a usage table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import cost as C
from ledgerlight.functions.money import from_units, sum_money, to_units
from ledgerlight.sources.adapters import ntz


def with_rates(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join with the price list; an override wins, an unpriced request takes the default rate.

    A popular price entry makes a hot join key; the price list is the small side
    and is broadcast when its measured size allows, and AQE splits the skewed
    partitions of the sort-merge join otherwise.
    """
    joined = usage.join(prices, "part_id", "left")
    return (joined
            .withColumn("effective_input_rate",
                        F.coalesce("override_rate", "input_rate", F.lit(C.DEFAULT_UNPRICED_RATE)))
            .withColumn("effective_output_rate", F.coalesce("output_rate", F.lit(C.DEFAULT_UNPRICED_RATE))))


def price_bands(priced: DataFrame) -> DataFrame:
    """Add an array of three price bands built from the band size and the flat rates."""
    size = F.col("band_size") * 10
    def band(low, high, factor):
        return F.struct(
            low.cast("bigint").alias("low"), high.cast("bigint").alias("high"),
            (F.col("input_rate") * factor).alias("input_rate"),
            (F.col("output_rate") * factor).alias("output_rate"),
            (F.col("cache_read_rate") * factor).alias("cache_rate"))
    return priced.withColumn("bands", F.when(F.col("input_rate").isNotNull(), F.array(
        band(F.lit(0), size, 1.0), band(size, size * 2, 0.5), band(size * 2, size * 4, 0.25))))


def tier_overlap_cost(requests: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """Range join of token counts with overlapping price bands (key, band_no, low, high, rate).

    Equality on the price key keeps the join partitioned; a request meets only
    the bands that begin below its token count.  The tokens above the highest
    band are added at that band's rate.
    """
    joined = requests.join(bands, (requests[key] == bands["band_key"]) & (requests["tokens"] > bands["low"]))
    piece = F.greatest(F.least("tokens", "high") - F.col("low"), F.lit(0)) + F.when(
        F.col("is_last"), F.greatest(F.col("tokens") - F.col("high"), F.lit(0))).otherwise(0)
    return joined.groupBy("request_id").agg(sum_money(piece * F.col("rate")).alias("tier_cost"),
                                            F.count(F.lit(1)).alias("bands_used"))


def user_model_cost(usage: DataFrame) -> DataFrame:
    """Current cost and cost per model of every user, one row per user and model; requests without a user are a group too.

    The window sees one row per model of a user, never requests.
    """
    per_model = usage.groupBy("user_id", "model").agg(sum_money("spend").alias("model_cost"))
    return per_model.withColumn("current_cost", from_units(F.sum(to_units("model_cost")).over(Window.partitionBy("user_id"))))


def over_budget(usage: DataFrame, budgets: DataFrame) -> DataFrame:
    """(user_id, spend, max_budget, exceeded) of every user with a budget: spend at or above it; a null side means no check."""
    spent = usage.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(sum_money("spend").alias("spend"))
    return budgets.join(spent, "user_id", "left").select(
        "user_id", "spend", "max_budget", F.coalesce(F.col("spend") >= F.col("max_budget"), F.lit(False)).alias("exceeded"))


def provider_budget(usage: DataFrame, limits: DataFrame, since, until) -> DataFrame:
    """Spend per provider within a period against its limit; no limit leaves the remainder empty."""
    rows = usage.where((F.col("start_time") >= ntz(since)) & (F.col("start_time") < ntz(until)))
    spent = rows.where(F.col("provider").isNotNull()).groupBy("provider").agg(sum_money("spend").alias("spend"))
    return (limits.join(spent, "provider", "full")
            .select("provider", F.coalesce("spend", F.lit(0.0)).alias("spend"), "budget_limit",
                    (F.col("budget_limit") - F.coalesce("spend", F.lit(0.0))).alias("remaining"),
                    (F.coalesce("spend", F.lit(0.0)) >= F.col("budget_limit")).alias("exhausted")))
