"""Guardrail, policy and tool bridges, daily counters and compliance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.money import count_if, sum_money
from ledgerlight.operators.usage_reports import day

ENTRY = "struct<guardrail_id:string,guardrail_name:string,guardrail_status:string,guardrail_mode:string,policy_id:string>"
METADATA = f"guardrail_information array<{ENTRY}>, standard_logging_guardrail_information array<{ENTRY}>"
TOOL_CALLS = "array<struct<function:struct<name:string>>>"
RESPONSE = f"tool_calls {TOOL_CALLS}, choices array<struct<message:struct<tool_calls:{TOOL_CALLS}>>>"
REQUEST = f"body struct<tools:{TOOL_CALLS}>, tools {TOOL_CALLS}"

# Fixed values.
INTERVENED_STATES = ("guardrail_intervened", "failed", "blocked")


def security_daily(telemetry: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return telemetry.groupBy(day("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), count_if(ok).alias("successes"), count_if(~ok).alias("failures"),
        count_if(F.col("injection_detected")).alias("injections"), count_if(F.col("dlp_detected")).alias("dlp_hits"),
        sum_money("latency_ms").alias("latency_sum"), F.count("latency_ms").alias("latency_samples"))


def action_of(status: Column) -> Column:
    """blocked, flagged or passed, by words inside the status."""
    text = F.lower(F.coalesce(status, F.lit("")))
    return (F.when(text.contains("intervened") | text.contains("block"), "blocked")
            .when(text.contains("fail") | text.contains("error"), "flagged").otherwise("passed"))


def with_entries(usage: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Replace the metadata by its guardrail entries; anything that cannot be read is an empty list.

    Parsing is a step of its own, so every document is parsed once.
    """
    parsed = usage.withColumn("_meta", F.from_json(metadata, METADATA)).drop(metadata)
    first = F.col("_meta.guardrail_information")
    both = F.when(F.size(first) > 0, first).otherwise(F.col("_meta.standard_logging_guardrail_information"))
    return parsed.withColumn("entries", F.coalesce(both, F.array().cast(f"array<{ENTRY}>"))).drop("_meta")


def guardrail_index_rows(usage: DataFrame) -> DataFrame:
    """One row per request and entry that names its guardrail, duplicates included."""
    named = usage.where(F.col("request_id").isNotNull() & F.col("start_time").isNotNull())
    rows = with_entries(named.select("request_id", "start_time", "metadata")).select(
        "request_id", "start_time", F.explode("entries").alias("e"))
    name = F.coalesce(F.nullif(F.col("e.guardrail_id"), F.lit("")), F.nullif(F.col("e.guardrail_name"), F.lit("")))
    return rows.select("request_id", "start_time", name.alias("guardrail_id"), F.col("e.policy_id").alias("policy_id"),
                       action_of(F.col("e.guardrail_status")).alias("action")).where(F.col("guardrail_id").isNotNull())


def daily_metrics(index_rows: DataFrame, key: str) -> DataFrame:
    """Evaluated, passed, blocked and flagged per key and day; duplicates count."""
    return index_rows.where(F.col(key).isNotNull()).groupBy(key, day().alias("day")).agg(
        F.count(F.lit(1)).alias("requests_evaluated"), count_if(F.col("action") == "passed").alias("passed_count"),
        count_if(F.col("action") == "blocked").alias("blocked_count"),
        count_if(F.col("action") == "flagged").alias("flagged_count"))


def insert_ignore(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """New bridge rows: one per key, keys that exist already are left out."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def overview(metrics: DataFrame) -> DataFrame:
    """Totals over guardrails: blocked is estimated from each rounded fail rate; the mean latency is unweighted."""
    blocked = F.floor(F.col("requests_evaluated") * F.col("fail_rate") / 100.0 + 0.5)
    summed = metrics.agg(
        F.coalesce(F.sum("requests_evaluated"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum(blocked), F.lit(0)).alias("total_blocked"), F.avg("avg_latency").alias("_latency"),
        F.count(F.lit(1)).alias("guardrails"))
    rate = F.when(F.col("total_requests") > 0,
                  F.round((1.0 - F.col("total_blocked") / F.col("total_requests")) * 100.0, 1)).otherwise(0.0)
    return summed.select("total_requests", "total_blocked", rate.alias("pass_rate"),
                         F.coalesce(F.floor(F.col("_latency") + 0.5), F.lit(0)).alias("avg_latency"), "guardrails")


# ---- tools -----------------------------------------------------------------
def ranked(rows: DataFrame, metric: str, tie: str, descending: bool = True) -> DataFrame:
    """All rows with their position by *metric*, in either direction; equal ones by *tie*.  One row per guardrail is sorted."""
    first = F.desc(metric) if descending else F.asc(metric)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(first, tie)))


def _names(calls: Column) -> Column:
    return F.transform(F.coalesce(calls, F.from_json(F.lit("[]"), TOOL_CALLS)), lambda c: F.trim(c["function"]["name"]))


def tool_names(namespaced: Column, answer: Column, asked: Column) -> Column:
    """Distinct tool names of a request: the namespaced field, the calls of the parsed response (top level and
    first choice) and the tools offered in the parsed request."""
    first_choice = F.get(answer["choices"], F.lit(0))["message"]["tool_calls"]
    offered = F.when(asked["body"].isNotNull(), asked["body"]["tools"]).otherwise(asked["tools"])
    every = F.concat(F.array(F.trim(namespaced)), _names(answer["tool_calls"]), _names(first_choice), _names(offered))
    return F.array_distinct(F.filter(every, lambda n: n.isNotNull() & (n != "")))


def tool_index(usage: DataFrame) -> DataFrame:
    parsed = usage.select("request_id", "start_time", "tool_name", F.from_json("response", RESPONSE).alias("_answer"),
                          F.from_json("request", REQUEST).alias("_asked"))
    names = tool_names(F.col("tool_name"), F.col("_answer"), F.col("_asked"))
    return parsed.select("request_id", "start_time", F.explode(names).alias("tool_name"))


# ---- compliance ------------------------------------------------------------
def compliance_checks(usage: DataFrame) -> DataFrame:
    """Six check rows per request with outcome and detail."""
    screened = with_entries(usage.select("request_id", "user_id", "model", "start_time", "metadata")).withColumn(
        "_pre_call", F.filter("entries", lambda g: F.coalesce(g["guardrail_mode"], F.lit("pre_call")) == "pre_call"))
    pre_call = F.col("_pre_call")
    base = screened.select("request_id", "user_id", "model", "start_time", F.size("entries").alias("_all"),
                        F.size(pre_call).alias("_pre"),
                        F.coalesce(F.exists(pre_call, lambda g: g["guardrail_status"].isin(*INTERVENED_STATES)),
                                   F.lit(False)).alias("_stopped"),
                        F.coalesce(F.forall(pre_call, lambda g: g["guardrail_status"].eqNullSafe(F.lit("success"))),
                                   F.lit(False)).alias("_clean"))

    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")) != ""

    missing = F.array_join(F.array_compact(F.array(
        F.when(~known("user_id"), F.lit("user_id")), F.when(~known("model"), F.lit("model")),
        F.when(F.col("start_time").isNull(), F.lit("timestamp")), F.when(F.col("_all") == 0, F.lit("guardrail_results")))), ", ")
    audit_detail = F.when(missing == "", "All required audit fields present").otherwise(F.concat(F.lit("Missing: "), missing))
    pre_count, clean = F.col("_pre").cast("string"), (F.col("_pre") > 0) & F.col("_clean")

    def check(name: str, article: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), F.lit(article).alias("article"), passed.alias("passed"),
                        detail.alias("detail"))

    # Names, articles and detail texts of the checks.
    checks = F.array(
        check("Guardrails applied", "Art. 9", F.col("_all") > 0,
              F.when(F.col("_all") > 0, F.concat(F.col("_all").cast("string"), F.lit(" guardrail(s) applied")))
              .otherwise("No guardrails applied")),
        check("Content screened before LLM", "Art. 5", F.col("_pre") > 0,
              F.when(F.col("_pre") > 0, F.concat(pre_count, F.lit(" pre-call guardrail(s) screened content")))
              .otherwise("No pre-call screening applied")),
        check("Audit record complete", "Art. 12", missing == "", audit_detail),
        check("Data protection applied", "Art. 32", F.col("_pre") > 0,
              F.when(F.col("_pre") > 0, F.concat(pre_count, F.lit(" pre-call guardrail(s) protect data")))
              .otherwise("No pre-call data protection applied")),
        check("Sensitive data protected", "Art. 5(1)(c)", F.col("_stopped") | clean,
              F.when(F.col("_stopped"), "Guardrail intervened to protect sensitive data")
              .when(clean, "No sensitive data detected").otherwise("No pre-call guardrails to protect sensitive data")),
        check("Audit record complete", "Art. 30", missing == "", audit_detail))
    return base.select("request_id", F.inline(checks))
