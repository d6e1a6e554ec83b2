"""From findings to decisions, and the evaluation of decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.money import count_if

# Order of actions and risks, rules that alone only sanitise.
ACTIONS = ("allow", "sanitize", "require_approval", "block")
RISKS = ("none", "low", "medium", "high", "critical")
INJECTION_RULE_PREFIXES = ("PI-", "II-", "RP-")


@dataclass(frozen=True)
class Policy:
    block: float = 0.86
    approval: float = 0.68
    sanitize: float = 0.45


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    rank = F.lit(None).cast("int")
    for i, name in enumerate(order):
        rank = F.when(value == name, F.lit(i)).otherwise(rank)
    return rank


def _name(rank: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in order]), rank + 1)


def decide(findings: DataFrame, request_id: str, policy: Policy = Policy()) -> DataFrame:
    """One decision per request with findings; a hot request only costs a partial aggregate."""
    injection = F.lit(False)
    for prefix in INJECTION_RULE_PREFIXES:
        injection = injection | F.col("rule_id").startswith(prefix)
    rows = findings.withColumn("_inj", injection).withColumn("_a", _rank(F.col("action"), ACTIONS)).withColumn(
        "_r", _rank(F.col("risk"), RISKS))
    enforced = ~F.col("_inj")
    summed = rows.groupBy(request_id).agg(
        F.max("score").alias("_score"), F.max("_r").alias("_risk"), F.count(F.lit(1)).alias("findings"),
        F.max("_inj").alias("_injected"), F.max(F.when(enforced, F.col("_a"))).alias("_action"),
        F.coalesce(F.max(F.when(enforced, F.col("score"))), F.lit(0.0)).alias("_escore"),
        F.coalesce(F.max(F.when(enforced, F.col("_r"))), F.lit(0)).alias("_erisk"))
    base = F.coalesce("_action", F.when(F.col("_injected"), 1).otherwise(0))
    action = (F.when((F.col("_escore") >= policy.block) | (F.col("_erisk") == 4), 3)
              .when((F.col("_escore") >= policy.approval) & (base != 3), 2)
              .when(((F.col("_score") >= policy.sanitize) | F.col("_injected")) & (base == 0), 1).otherwise(base))
    return summed.select(request_id, _name(action, ACTIONS).alias("action"), _name(F.col("_risk"), RISKS).alias("risk"),
                         F.bround("_score", 3).alias("score"), "findings")


def with_default_allow(requests: DataFrame, decisions: DataFrame, request_id: str) -> DataFrame:
    """Decisions for all requests; one without findings is allowed."""
    return requests.select(request_id).join(decisions, request_id, "left").select(
        request_id, F.coalesce("action", F.lit("allow")).alias("action"), F.coalesce("risk", F.lit("none")).alias("risk"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def findings_ranked(findings: DataFrame, request_id: str) -> DataFrame:
    """Findings of a request by falling score."""
    order = Window.partitionBy(request_id).orderBy(F.desc("score"), "rule_id")
    return findings.withColumn("position", F.row_number().over(order))


def distinct_rules(findings: DataFrame, doc_id: str) -> DataFrame:
    """Number of distinct rules and types per text, and the rules as sorted text."""
    unique = findings.select(doc_id, "rule_id", "type").distinct()
    return unique.groupBy(doc_id).agg(
        F.count_distinct("rule_id").alias("rules"), F.count_distinct("type").alias("types"),
        F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rule_ids"))


def security_group_counts(events: DataFrame) -> DataFrame:
    """Events by type, risk, stage and rule in one pass of grouping sets over pre-summed rows."""
    dims = ("event_type", "risk", "stage", "rule_id")
    exploded = events.select("event_type", "risk", "stage", F.explode_outer("rule_ids").alias("rule_id"))
    summed = exploded.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"))
    levels = summed.groupingSets([[d] for d in dims], *dims).agg(
        F.sum("_n").alias("events"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        dimension = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dimension)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return levels.select(dimension.alias("dimension"), value.alias("value"), "events")


def gateway_decide(rows: DataFrame) -> DataFrame:
    """Ordered gate: authorisation, tool policy, tenant, confirmation, injection or context, intent, personal data.

    Needs authorized, auth_reason, tool (null without a call), tool_allowed, tool_risk, tool_reason, tenant, scope_tenant,
    confirmation (none, valid or a rejection reason), injection_safe, injection_risk, context_score, intent, intent_score,
    pii (array).
    """
    has_tool = F.col("tool").isNotNull()
    scope = F.trim(F.coalesce("scope_tenant", F.lit("")))
    tenant = F.coalesce("tenant", F.lit(""))
    gates = [
        (~F.col("authorized"), "high", "block", F.concat(F.lit("unauthorized: "), F.coalesce("auth_reason", F.lit("")))),
        (has_tool & ~F.col("tool_allowed"), F.when(F.col("tool_risk") == "low", "medium").otherwise(F.col("tool_risk")), "block",
         F.concat(F.lit("tool_policy_violation:"), F.coalesce("tool_reason", F.lit("")))),
        (has_tool & ((tenant == "") | (scope == "")), "high", "block", F.lit("tool_scope_ownership_unverifiable")),
        (has_tool & (scope != tenant), "high", "block", F.lit("tool_scope_privilege_escalation_attempt")),
        (has_tool & (F.col("tool_risk") == "high") & (F.col("confirmation") == "none"), "high", "require_confirmation",
         F.lit("high_risk_tool_confirmation_required")),
        (has_tool & (F.col("tool_risk") == "high") & (F.col("confirmation") != "valid"), "high", "block",
         F.concat(F.lit("tool_confirmation_rejected:"), F.col("confirmation"))),
        (~F.col("injection_safe") | (F.col("context_score") >= 40),
         F.when((F.col("injection_risk") == "high") | (F.col("context_score") >= 70), "high").otherwise("medium"), "sanitize",
         F.lit("prompt_injection_warned")),
        (~has_tool & (F.col("intent") == "execute") & (F.col("intent_score") >= 50), "medium", "require_confirmation",
         F.lit("execute_intent_requires_confirmation")),
        (F.size("pii") > 0, "medium", "sanitize", F.concat(F.lit("pii_detected: "), F.array_join("pii", ", "))),
    ]
    action, risk, reason = F.lit("allow"), F.lit("low"), F.lit("allowed")
    for condition, gate_risk, gate_action, gate_reason in reversed(gates):
        hit = F.coalesce(condition, F.lit(False))
        action = F.when(hit, F.lit(gate_action)).otherwise(action)
        risk = F.when(hit, F.lit(gate_risk) if isinstance(gate_risk, str) else gate_risk).otherwise(risk)
        reason = F.when(hit, gate_reason).otherwise(reason)
    return rows.withColumn("action", action).withColumn("risk", risk).withColumn("reason", reason)


def attack_eval(decided: DataFrame, expected: str = "expected_action") -> DataFrame:
    """Totals over labelled cases."""
    passed = count_if(F.col("action") == F.col(expected))
    total = F.count(F.lit(1))
    return decided.agg(
        total.alias("total"), passed.alias("passed"), count_if(F.col("action") == "block").alias("blocked"),
        count_if(F.col("action") == "sanitize").alias("sanitized"),
        count_if(F.col("action") == "require_approval").alias("approval_required"),
        F.when(total > 0, F.bround(passed / total, 4)).otherwise(0.0).alias("pass_rate"))


def attack_failures(decided: DataFrame, case_id: str, expected: str = "expected_action") -> DataFrame:
    return decided.where(F.col("action") != F.col(expected)).select(
        case_id, expected, F.col("action").alias("actual_action"), "risk", "score")


def classifier_eval(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Confusion counts with precision, recall and F1."""
    counts = rows.agg(count_if(predicted & actual).alias("tp"), count_if(predicted & ~actual).alias("fp"),
                      count_if(~predicted & actual).alias("fn"), count_if(~predicted & ~actual).alias("tn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return counts.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
                         F.round(f1, 6).alias("f1"))


def replay(old: DataFrame, new: DataFrame, request_id: str) -> DataFrame:
    """Requests whose decision differs under the new policy."""
    before = old.select(request_id, F.col("action").alias("old_action"), F.col("score").alias("old_score"))
    after = new.select(request_id, F.col("action").alias("new_action"), F.col("score").alias("new_score"))
    return before.join(after, request_id, "full").where(~F.col("old_action").eqNullSafe(F.col("new_action")))
