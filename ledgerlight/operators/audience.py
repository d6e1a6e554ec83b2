"""Who uses the gateway: active users, agents, usage bands, quotas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.money import count_if, sum_count, sum_money
from ledgerlight.operators.usage_reports import TAGS_TYPE, day

AGENT_PREFIX = "User-Agent: "

# Bands of successful requests per user.
BANDS = ((1, 9, "1-9 requests"), (10, 99, "10-99 requests"), (100, 999, "100-999 requests"),
         (1000, 9999, "1K-9.9K requests"), (10000, 99999, "10K-99.9K requests"), (100000, None, "100K+ requests"))


def with_agent_tag(usage: DataFrame) -> DataFrame:
    """One row per request and distinct agent tag."""
    tags = F.array_distinct(F.from_json("request_tags", TAGS_TYPE))
    agents = F.filter(tags, lambda t: t.startswith(AGENT_PREFIX))
    return usage.withColumn("tag", F.explode(agents))


def active_users(tagged: DataFrame, as_of: dt.date, bucket_days: int) -> DataFrame:
    """Distinct users per tag in buckets of *bucket_days* days, counted back from *as_of*."""
    bucket = F.floor(F.date_diff(F.lit(as_of), day()) / bucket_days).cast("bigint")
    return tagged.groupBy("tag", bucket.alias("bucket")).agg(F.count_distinct("user_id").alias("active_users"))


def active_user_sketches(tagged: DataFrame) -> DataFrame:
    """Mergeable user sketches per tag and day; week and month counts need not touch the log again."""
    return tagged.groupBy("tag", day().alias("day")).agg(F.hll_sketch_agg("user_id").alias("users"))


def active_users_from_sketches(sketches: DataFrame, as_of: dt.date, bucket_days: int) -> DataFrame:
    bucket = F.floor(F.date_diff(F.lit(as_of), F.col("day")) / bucket_days).cast("bigint")
    return sketches.groupBy("tag", bucket.alias("bucket")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users"))


def _counts() -> list[Column]:
    ok = F.col("status") == "success"
    return [F.count(F.lit(1)).alias("total_requests"), count_if(ok).alias("successful_requests"),
            count_if(~ok).alias("failed_requests"),
            sum_count(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
            sum_money("spend").alias("total_spend")]


def user_agent_summary(tagged: DataFrame) -> DataFrame:
    """Per tag; the distinct users are counted on the (tag, user) sums."""
    per_user = tagged.groupBy("tag", "user_id").agg(*_counts())
    return per_user.groupBy("tag").agg(
        F.count("user_id").alias("unique_users"), *[F.sum(c).alias(c) for c in (
            "total_requests", "successful_requests", "failed_requests", "total_tokens")],
        sum_money("total_spend").alias("total_spend"))


def per_user_usage(tagged: DataFrame, users: DataFrame) -> DataFrame:
    per_user = tagged.groupBy("user_id", F.col("tag").alias("user_agent")).agg(*_counts())
    return per_user.join(users.select("user_id", "user_email"), "user_id", "left")


def usage_histogram(per_user: DataFrame, agents: int) -> DataFrame:
    """Users per band of successful requests, for the most common agents."""
    common = (per_user.groupBy("user_agent").agg(F.count(F.lit(1)).alias("_users"))
              .orderBy(F.desc("_users"), "user_agent").limit(agents).select("user_agent"))
    band = F.lit(None).cast("string")
    for low, high, name in BANDS:
        inside = F.col("successful_requests") >= low
        if high is not None:
            inside = inside & (F.col("successful_requests") <= high)
        band = F.when(inside, F.lit(name)).otherwise(band)
    banded = per_user.join(common, "user_agent", "left_semi").withColumn("category", band)
    return banded.where(F.col("category").isNotNull()).groupBy("category", "user_agent").agg(
        F.count(F.lit(1)).alias("users"))


def quota_remaining(used: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Used and allowed per entity; without a limit the remainder is unknown."""
    counted = used.groupBy(key).agg(F.count(F.lit(1)).alias("used"))
    return limits.join(counted, key, "left").select(
        key, "allowed", F.coalesce("used", F.lit(0)).alias("used"),
        (F.col("allowed") - F.coalesce("used", F.lit(0))).alias("remaining"))
