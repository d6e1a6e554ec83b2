"""Policies: who they apply to, what they inherit, which guardrails remain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import written


@dataclass(frozen=True)
class Attachment:
    """Scope of a policy: pattern lists; an empty tag list means that tags are not looked at."""

    policy: str
    teams: Sequence[str] = ("*",)
    keys: Sequence[str] = ("*",)
    models: Sequence[str] = ("*",)
    tags: Sequence[str] = field(default_factory=tuple)


def matches_any(value: Column, patterns: Sequence[str]) -> Column:
    """Equality, or a prefix where the pattern ends in *; an unknown value only matches a bare *."""
    if "*" in patterns:
        return F.lit(True)
    exact = [p for p in patterns if not p.endswith("*")]
    hit = value.isin(*exact) if exact else F.lit(False)
    for pattern in patterns:
        if pattern.endswith("*"):
            hit = hit | value.startswith(pattern[:-1])
    return F.coalesce(hit, F.lit(False))


def _some_tag(tags: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(F.exists(tags, lambda t: matches_any(t, patterns)), F.lit(False))


def matching_policies(attachments: Sequence[Attachment], team: Column, key: Column, model: Column,
                      tags: Column) -> Column:
    """Names of the policies whose scope fits, as an array.

    The attachments are configuration: each becomes a predicate inside one
    projection, so matching is a map-side step without a join.
    """
    tests = []
    for a in attachments:
        hit = matches_any(team, a.teams) & matches_any(key, a.keys) & matches_any(model, a.models)
        if a.tags:
            hit = hit & _some_tag(tags, a.tags)
        tests.append(F.when(hit, F.lit(a.policy)))
    return F.array_compact(F.array(*tests))


def model_condition(model: Column, condition: Sequence[str] | str) -> Column:
    """Exact text or whole-text regular expression, one or several; an unknown model never matches."""
    patterns = [condition] if isinstance(condition, str) else list(condition)
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | (model == pattern) | model.rlike(f"^(?:{pattern})$")
    return F.coalesce(hit, F.lit(False))


def inheritance_chains(policies: DataFrame) -> DataFrame:
    """Ancestors of every policy from the root to itself, and whether a cycle was cut.

    Each round joins the chains with themselves and so doubles their length; a
    chain goes on until it reaches its root or repeats a name, so the number of
    rounds is the logarithm of the longest chain and no depth is cut.  Each round
    is written to the shared folder, since a self-join would otherwise double the
    plan.  The chain ends before the first name it would repeat, and at a parent
    that does not exist.
    """
    known = policies.select(F.col("policy").alias("_name"))
    links = (policies.join(known, policies["parent"] == F.col("_name"), "left")
             .select("policy", F.array("policy").alias("up"), F.col("_name").alias("next")))
    while True:
        links = written(links, "policy-chains")
        if links.where(F.col("next").isNotNull()).isEmpty():
            break
        step = links.select(F.col("policy").alias("_p"), F.col("up").alias("_up"), F.col("next").alias("_next"))
        links = links.join(step, F.col("next") == F.col("_p"), "left").select(
            "policy", F.concat("up", F.coalesce("_up", F.array().cast("array<string>"))).alias("up"),
            F.col("_next").alias("next"))
        repeats = F.size(F.array_distinct("up")) < F.size("up")
        links = links.withColumn("next", F.when(~repeats, F.col("next")))
    # up runs from the policy to the root; cut it at the first repetition.
    size = F.size("up")
    repeat = F.filter(F.sequence(F.lit(2), F.greatest(size, F.lit(2))),
                      lambda i: (i <= size) & F.array_contains(F.slice("up", F.lit(1), i - 1), F.get(F.col("up"), i - 1)))
    keep = F.when(F.size(repeat) > 0, F.get(repeat, F.lit(0)) - 1).otherwise(size)
    return links.select("policy", F.reverse(F.slice("up", F.lit(1), keep)).alias("chain"),
                        (F.size(repeat) > 0).alias("cyclic"))


def effective_guardrails(policies: DataFrame, chains: DataFrame, applies: Column) -> DataFrame:
    """Guardrails of every policy: root to leaf, each step adds and then removes.

    *applies* is the condition of a single policy; one that fails is skipped.
    The ordered list per policy is as long as its chain.
    """
    rules = policies.select(F.col("policy").alias("ancestor"), "add", "remove", applies.alias("_applies"))
    steps = (chains.select("policy", F.posexplode("chain").alias("depth", "ancestor")).join(rules, "ancestor")
             .groupBy("policy").agg(F.sort_array(F.collect_list(F.struct("depth", "_applies", "add", "remove"))).alias("_steps")))

    def fold(acc: Column, s: Column) -> Column:
        return F.when(s["_applies"], F.array_except(F.array_union(acc, s["add"]), s["remove"])).otherwise(acc)

    return steps.select("policy", F.sort_array(F.aggregate(
        "_steps", F.array().cast("array<string>"), fold)).alias("guardrails"))
