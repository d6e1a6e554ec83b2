"""Capacity and what-if reports over deployments, wildcard routes and tags."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.ordered import running_totals

# Characters that add to the specificity of a route pattern.
PATTERN_SPECIALS = ("*", "+", "?", "\\", "^", "$", "|", "(", ")")
UNPRICED_RATE = 5.0


# ---- tags ------------------------------------------------------------------
def tags_match_any(request: Column, deployment: Column) -> Column:
    """Some tag in common; a request without tags never matches."""
    return (F.size(request) > 0) & F.arrays_overlap(request, deployment)


def tags_match_all(request: Column, deployment: Column) -> Column:
    """All request tags known to the deployment; a request without tags never matches."""
    return (F.size(request) > 0) & (F.size(F.array_except(request, deployment)) == 0)


# ---- wildcard routes -------------------------------------------------------
def route_regex(pattern: str) -> str:
    """Pattern text with every * matching anything."""
    return "(.*)".join(re.escape(part) for part in pattern.split("*"))


def specificity(regex: str) -> tuple[int, int]:
    return len(regex), sum(regex.count(c) for c in PATTERN_SPECIALS)


def wildcard_route(model: Column, routes: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """First matching route of *model*, most specific pattern first: (pattern, deployment).

    The routes are configuration, so they become one CASE expression: no join,
    and later patterns are not tried once one has matched.  A pattern has to match
    at the start of the name.
    """
    ordered = sorted(routes, key=lambda r: specificity(route_regex(r[0])), reverse=True)
    pattern, deployment = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, target in reversed(ordered):
        hit = model.rlike("^" + route_regex(text))
        pattern = F.when(hit, F.lit(text)).otherwise(pattern)
        deployment = F.when(hit, F.lit(target)).otherwise(deployment)
    return pattern, deployment


# ---- deployments -----------------------------------------------------------
def slot_usage(usage: DataFrame, unit: str) -> DataFrame:
    """Tokens and requests per model group, slot and deployment."""
    return usage.groupBy(
        "route_group", F.date_trunc(unit, "start_time").cast("timestamp_ntz").alias("slot"), "deployment_id").agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tpm"), F.count(F.lit(1)).alias("rpm"))


def candidates(used: DataFrame, deployments: DataFrame) -> DataFrame:
    """Every deployment of the group for every slot in which the group had traffic, unused ones at zero."""
    slots = used.select("route_group", "slot").distinct()
    return (slots.join(deployments, "route_group")
            .join(used, ["route_group", "slot", "deployment_id"], "left").fillna(0, ["tpm", "rpm"]))


def cheapest_deployment(options: DataFrame, input_tokens: int) -> DataFrame:
    """Lowest input plus output rate among the deployments that keep within their limits."""
    fits = (~F.coalesce(F.col("tpm") + input_tokens > F.col("tpm_limit"), F.lit(False))
            & ~F.coalesce(F.col("rpm") + 1 > F.col("rpm_limit"), F.lit(False)))
    rate = (F.coalesce("input_rate", F.lit(UNPRICED_RATE)) + F.coalesce("output_rate", F.lit(UNPRICED_RATE)))
    return options.where(fits).groupBy("route_group", "slot").agg(
        F.min_by("deployment_id", F.struct(rate.alias("rate"), F.col("deployment_id"))).alias("chosen"),
        F.min(rate).alias("rate"), F.count(F.lit(1)).alias("options"))


def least_used_deployment(options: DataFrame, input_tokens: int) -> DataFrame:
    """Fewest tokens so far in the slot.  The request limit is already closed when the next
    request would reach it, and it is only looked at for deployments that were used."""
    fits = (~F.coalesce(F.col("tpm") + input_tokens > F.col("tpm_limit"), F.lit(False))
            & ~F.coalesce((F.col("rpm") > 0) & (F.col("rpm") + 1 >= F.col("rpm_limit")), F.lit(False)))
    return options.where(fits).groupBy("route_group", "slot").agg(
        F.min_by("deployment_id", F.struct("tpm", "deployment_id")).alias("chosen"), F.min("tpm").alias("tpm"),
        F.count(F.lit(1)).alias("options"))


def least_busy(usage: DataFrame, deployments: DataFrame, unit: str) -> DataFrame:
    """Deployment with the fewest requests in flight at the end of each slot with traffic."""
    ends = F.date_trunc(unit, F.col("at")).cast("timestamp_ntz").alias("slot")
    line = usage.select("route_group", "deployment_id", F.explode(F.array(
        F.struct(F.col("start_time").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("step")))).alias("e")).select(
        "route_group", "deployment_id", "e.at", "e.step")
    per_slot = line.groupBy("route_group", "deployment_id", ends).agg(F.sum("step").alias("_change"))
    slots = per_slot.select("route_group", "slot").distinct()
    full = (slots.join(deployments.select("route_group", "deployment_id"), "route_group")
            .join(per_slot, ["route_group", "slot", "deployment_id"], "left").fillna(0, ["_change"]))
    running = running_totals(full, ["route_group", "deployment_id"], ["slot"],
                             {"in_flight": F.col("_change")}, F.trunc("slot", "year"), inclusive=True)
    return running.groupBy("route_group", "slot").agg(
        F.min_by("deployment_id", F.struct("in_flight", "deployment_id")).alias("chosen"),
        F.min("in_flight").alias("in_flight"))


def weighted_pick(usage: DataFrame, deployments: DataFrame, weight: str) -> DataFrame:
    """Repeatable weighted choice: the request id decides where on the weight line a request falls.

    The deployments of a group are configuration; they travel as one small array per group.
    """
    packed = deployments.groupBy("route_group").agg(
        F.sort_array(F.collect_list(F.struct("deployment_id", F.col(weight).cast("double").alias("weight")))).alias("_d"))
    point = F.pmod(F.xxhash64("request_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    total = F.aggregate("_d", F.lit(0.0), lambda acc, d: acc + d["weight"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("pick"))

    def step(acc: Column, d: Column) -> Column:
        upto = acc["sum"] + d["weight"]
        chosen = F.coalesce(acc["pick"], F.when(upto > F.col("_p") * F.col("_w"), d["deployment_id"]))
        return F.struct(upto.alias("sum"), chosen.alias("pick"))

    return (usage.join(packed, "route_group").withColumn("_p", point).withColumn("_w", total)
            .withColumn("chosen", F.aggregate("_d", start, step)["pick"]).drop("_d", "_p", "_w"))
