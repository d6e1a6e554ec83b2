"""Queries on guardrails, policies, tools and compliance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerlight.operators import guardrails as G
from ledgerlight.operators import policies as PO
from ledgerlight.operators import rollups as R
from ledgerlight.operators import usage_reports as U
from ledgerlight.plans.oracle_views import add_view
from ledgerlight.plans.registry import query
from ledgerlight.sources.adapters import Tables

add_view("guardrail_base", """
    SELECT *, NOT (session_id % 31 = 0 OR session_id % 50 = 0) AS readable,
           CASE quantity % 5 WHEN 0 THEN 'guardrail_intervened' WHEN 1 THEN 'guardrail_failed_to_respond' ELSE 'success' END
             AS main_status,
           CASE quantity % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'flagged' ELSE 'passed' END AS main_action
    FROM usage_rows""")
add_view("guardrail_rows", """
    SELECT request_id, start_time, 'g' || (part_id % 4) AS guardrail_id, 'p' || (deployment_no % 3) AS policy_id,
           main_action AS action FROM guardrail_base WHERE readable AND call_no <= 5
    UNION ALL SELECT request_id, start_time, 'pii-mask', NULL, 'passed' FROM guardrail_base WHERE readable AND call_no IN (2, 4)
    UNION ALL SELECT request_id, start_time, 'g' || (part_id % 4), 'p' || (deployment_no % 3), main_action
    FROM guardrail_base WHERE readable AND call_no = 2""")


def with_metadata(usage):
    """Usage rows with guardrail entries as JSON metadata, some of it missing or unreadable."""
    status = (F.when(F.col("quantity") % 5 == 0, "guardrail_intervened")
              .when(F.col("quantity") % 5 == 1, "guardrail_failed_to_respond").otherwise("success"))
    none = F.lit(None).cast("string")
    main = F.struct(
        F.concat(F.lit("g"), (F.col("part_id") % 4).cast("string")).alias("guardrail_id"), none.alias("guardrail_name"),
        status.alias("guardrail_status"),
        F.when(F.col("part_id") % 2 == 0, "pre_call").otherwise("post_call").alias("guardrail_mode"),
        F.concat(F.lit("p"), (F.col("deployment_no") % 3).cast("string")).alias("policy_id"))
    mask = F.struct(none.alias("guardrail_id"), F.lit("pii-mask").alias("guardrail_name"),
                    F.lit("success").alias("guardrail_status"), none.alias("guardrail_mode"), none.alias("policy_id"))
    entries = F.array_compact(F.array(F.when(F.col("call_no") <= 5, main), F.when(F.col("call_no").isin(2, 4), mask),
                                      F.when(F.col("call_no") == 2, main)))
    text = F.when(F.col("call_no") == 3, F.to_json(F.struct(entries.alias("standard_logging_guardrail_information")))
                  ).otherwise(F.to_json(F.struct(entries.alias("guardrail_information"))))
    return usage.withColumn("metadata", F.when(F.col("session_id") % 31 == 0, none)
                            .when(F.col("session_id") % 50 == 0, F.lit("{bad")).otherwise(text))


def index_rows(t: Tables):
    return G.guardrail_index_rows(with_metadata(t.usage()))


def daily_sql(key: str) -> str:
    return f"""
SELECT {key}, CAST(start_time AS DATE) AS day, count(*)::BIGINT AS requests_evaluated,
 count(*) FILTER (WHERE action = 'passed')::BIGINT AS passed_count,
 count(*) FILTER (WHERE action = 'blocked')::BIGINT AS blocked_count,
 count(*) FILTER (WHERE action = 'flagged')::BIGINT AS flagged_count
FROM guardrail_rows WHERE {key} IS NOT NULL GROUP BY 1, 2"""


@query("guardrail_daily", daily_sql("guardrail_id"))
def guardrail_daily(t: Tables):
    return G.daily_metrics(index_rows(t), "guardrail_id")


@query("policy_daily", daily_sql("policy_id"))
def policy_daily(t: Tables):
    return G.daily_metrics(index_rows(t), "policy_id")


@query("guardrail_action", """
SELECT main_status AS status, main_action AS action, count(*)::BIGINT AS requests FROM guardrail_base GROUP BY 1, 2""")
def guardrail_action(t: Tables):
    status = (F.when(F.col("quantity") % 5 == 0, "guardrail_intervened")
              .when(F.col("quantity") % 5 == 1, "guardrail_failed_to_respond").otherwise("success"))
    return t.usage().groupBy(status.alias("status"), G.action_of(status).alias("action")).agg(
        F.count(F.lit(1)).alias("requests"))


@query("guardrail_overview", """
SELECT sum(n)::BIGINT AS total_requests, sum(floor(n * rate / 100.0::DOUBLE + 0.5::DOUBLE))::BIGINT AS total_blocked,
 round((1.0::DOUBLE - sum(floor(n * rate / 100.0::DOUBLE + 0.5::DOUBLE)) / sum(n)) * 100.0::DOUBLE, 1) AS pass_rate,
 floor(avg(latency) + 0.5::DOUBLE)::BIGINT AS avg_latency, count(*)::BIGINT AS guardrails
FROM (SELECT guardrail_id, count(*) AS n, floor(count(*) FILTER (WHERE action = 'blocked') * 100.0::DOUBLE / count(*)) AS rate,
             CASE WHEN guardrail_id <> 'g1' THEN (count(*) % 97)::DOUBLE END AS latency FROM guardrail_rows GROUP BY 1)""")
def guardrail_overview(t: Tables):
    totals = index_rows(t).groupBy("guardrail_id").agg(
        F.count(F.lit(1)).alias("requests_evaluated"), F.count_if(F.col("action") == "blocked").alias("_blocked"))
    metrics = totals.select(
        "requests_evaluated", F.floor(F.col("_blocked") * 100.0 / F.col("requests_evaluated")).alias("fail_rate"),
        F.when(F.col("guardrail_id") != "g1", (F.col("requests_evaluated") % 97).cast("double")).alias("avg_latency"))
    return G.overview(metrics)


@query("guardrail_sort", """
SELECT guardrail_id, count(*)::BIGINT AS requests_evaluated,
 row_number() OVER (ORDER BY count(*) DESC, guardrail_id)::INT AS position FROM guardrail_rows GROUP BY 1
ORDER BY count(*) DESC, guardrail_id""")
def guardrail_sort(t: Tables):
    totals = index_rows(t).groupBy("guardrail_id").agg(F.count(F.lit(1)).alias("requests_evaluated"))
    return G.ranked(totals, "requests_evaluated", "guardrail_id")


@query("index_insert_ignore", """
SELECT request_id, guardrail_id, min(start_time) AS start_time FROM guardrail_rows
WHERE (request_id, guardrail_id) NOT IN (
  SELECT (request_id, guardrail_id) FROM guardrail_rows WHERE start_time < TIMESTAMP '1999-01-01')
GROUP BY 1, 2""")
def index_insert_ignore(t: Tables):
    stored = G.guardrail_index_rows(with_metadata(t.usage(until=dt.datetime(1999, 1, 1))))
    return G.insert_ignore(index_rows(t), stored, ["request_id", "guardrail_id"]).select(
        "request_id", "guardrail_id", "start_time")


# ---- tools -----------------------------------------------------------------
add_view("tool_rows", """
    SELECT DISTINCT request_id, start_time, tool_name FROM (
      SELECT request_id, start_time, 'srv-' || (part_id % 3) AS tool_name FROM usage_rows WHERE call_no = 1
      UNION ALL SELECT request_id, start_time, unnest(['search', 'fetch-' || (part_id % 5)]) FROM usage_rows
                WHERE call_no BETWEEN 2 AND 4
      UNION ALL SELECT request_id, start_time, unnest(['search', 'write-' || (part_id % 4)]) FROM usage_rows
                WHERE call_no BETWEEN 3 AND 5)""")


def with_tools(usage):
    """Usage rows with tool names in the three places they occur in; some payloads are unreadable."""
    part = F.col("part_id")
    def call(name):
        return F.concat(F.lit('[{"function":{"name":"'), name, F.lit('"}}]'))
    response = F.concat(F.lit('{"tool_calls":'), call(F.lit("search")), F.lit(',"choices":[{"message":{"tool_calls":'),
                        call(F.concat(F.lit("fetch-"), (part % 5).cast("string"))), F.lit('}},{"message":{"tool_calls":'),
                        call(F.lit("ignored")), F.lit("}}]}"))
    request = F.concat(F.lit('{"body":{"tools":[{"function":{"name":"search"}},{"function":{"name":"write-'),
                       (part % 4).cast("string"), F.lit('"}}]}}'))
    bad = F.when(F.col("call_no") == 6, F.lit("{bad"))
    return (usage.withColumn("tool_name", F.when(F.col("call_no") == 1, F.concat(F.lit(" srv-"), (part % 3).cast("string"),
                                                                                 F.lit(" "))))
            .withColumn("response", F.when(F.col("call_no").between(2, 4), response).otherwise(bad))
            .withColumn("request", F.when(F.col("call_no").between(3, 5), request).otherwise(bad)))


@query("tool_names", "SELECT tool_name, count(*)::BIGINT AS requests FROM tool_rows GROUP BY 1")
def tool_names(t: Tables):
    return G.tool_index(with_tools(t.usage())).groupBy("tool_name").agg(F.count(F.lit(1)).alias("requests"))


@query("tool_usage_lookup", """
SELECT tool_name, request_id, start_time, model, spend FROM (
  SELECT tool_name, request_id, start_time FROM tool_rows
  QUALIFY row_number() OVER (PARTITION BY tool_name ORDER BY start_time DESC, request_id) <= 20)
JOIN usage_rows USING (request_id, start_time)""")
def tool_usage_lookup(t: Tables):
    usage = t.usage()
    newest = Window.partitionBy("tool_name").orderBy(F.desc("start_time"), "request_id")
    last = (G.tool_index(with_tools(usage)).withColumn("_n", F.row_number().over(newest)).where("_n <= 20").drop("_n"))
    return last.join(usage.select("request_id", "model", "spend"), "request_id").select(
        "tool_name", "request_id", "start_time", "model", "spend")


@query("unmatched_allowlist", """
SELECT tool_name, tool_name NOT IN ('search', 'srv-0', 'srv-1', 'write-2') AS unlisted, count(*)::BIGINT AS calls
FROM tool_rows GROUP BY 1, 2""")
def unmatched_allowlist(t: Tables):
    return allowlist_flags(G.tool_index(with_tools(t.usage())), "tool_name", ["search", "srv-0", "srv-1", "write-2"]).groupBy(
        "tool_name", "unlisted").agg(F.count(F.lit(1)).alias("calls"))


def allowlist_flags(calls, tool: str, allowed: list[str]):
    """Calls of tools that are not allowed; an empty list checks nothing."""
    return calls.withColumn("unlisted", ~F.col(tool).isin(*allowed) if allowed else F.lit(False))


@query("tenant_scope_mismatch", """
SELECT CASE WHEN team_id IS NULL OR scope = '' THEN 'tool_scope_ownership_unverifiable'
            WHEN team_id <> scope THEN 'tool_scope_privilege_escalation_attempt' ELSE 'ok' END AS verdict,
       count(*)::BIGINT AS calls
FROM (SELECT *, CASE WHEN part_id % 9 = 0 THEN '' ELSE 't' || (part_id % 25) END AS scope FROM usage_rows)
LEFT JOIN api_keys ON api_key = token GROUP BY 1""")
def tenant_scope_mismatch(t: Tables):
    rows = R.with_entity_columns(t.usage(), t.keys(), t.teams())
    scope = F.when(F.col("part_id") % 9 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("t"), (F.col("part_id") % 25).cast("string")))
    return rows.groupBy(tenant_verdict(F.col("team_id"), scope).alias("verdict")).agg(F.count(F.lit(1)).alias("calls"))


def tenant_verdict(tenant, scope):
    clean = F.trim(F.coalesce(scope, F.lit("")))
    return (F.when(F.coalesce(tenant, F.lit("")).isin("") | (clean == ""), "tool_scope_ownership_unverifiable")
            .when(tenant != clean, "tool_scope_privilege_escalation_attempt").otherwise("ok"))


# ---- policies --------------------------------------------------------------
ATTACHMENTS = (
    PO.Attachment("global"),
    PO.Attachment("big-teams", teams=("NATION_1*", "NATION_2")),
    PO.Attachment("aliased-openai", keys=("alias-1*", "alias-3"), models=("openai/*",)),
    PO.Attachment("urgent", teams=("NATION_*",), tags=("1-*", "2-HIGH")),
    PO.Attachment("exact-model", models=("azure/chat-3-8b", "vertex_ai/chat-2-*")),
)
TEAM_SQL = "starts_with(coalesce(team_alias, ''), 'NATION_1') OR coalesce(team_alias, '') = 'NATION_2'"


@query("policy_match", f"""
SELECT request_id, policy FROM (
 SELECT request_id, unnest(list_filter(['global', CASE WHEN {TEAM_SQL} THEN 'big-teams' END,
   CASE WHEN (starts_with(coalesce(key_alias, ''), 'alias-1') OR coalesce(key_alias, '') = 'alias-3')
             AND starts_with(model, 'openai/') THEN 'aliased-openai' END,
   CASE WHEN starts_with(coalesce(team_alias, ''), 'NATION_')
             AND len(list_filter(coalesce(tags, []), lambda x: starts_with(x, '1-') OR x = '2-HIGH')) > 0 THEN 'urgent' END,
   CASE WHEN model = 'azure/chat-3-8b' OR starts_with(model, 'vertex_ai/chat-2-') THEN 'exact-model' END],
   lambda x: x IS NOT NULL)) AS policy
 FROM usage_full LEFT JOIN api_keys ON api_key = token LEFT JOIN teams USING (team_id))""")
def policy_match(t: Tables):
    names = t.keys().select("token", "key_alias", "team_id").join(t.teams().select("team_id", "team_alias"), "team_id", "left")
    # The stored columns go through the joins; the texts made of them are built behind.
    lines = t.usage_lines(with_user=True).join(names, F.concat(F.lit("k"), F.col("l_suppkey").cast("string")) == F.col("token"), "left")
    rows = lines.select(*t.usage_columns(with_user=True), "key_alias", "team_alias").select(
        "request_id", "model", "request_tags", "key_alias", "team_alias")
    hits = PO.matching_policies(ATTACHMENTS, F.col("team_alias"), F.col("key_alias"), F.col("model"),
                                F.from_json("request_tags", U.TAGS_TYPE))
    return rows.select("request_id", F.explode(hits).alias("policy"))


@query("model_condition", """
SELECT model, model = 'openai/chat-0-3b' OR regexp_full_match(model, '(openai|azure)/chat-1[0-9]*-(7|13)b')
       OR model = 'anthropic/chat-(' AS matches, count(*)::BIGINT AS requests FROM usage_rows GROUP BY 1, 2""")
def model_condition(t: Tables):
    condition = ["openai/chat-0-3b", "(openai|azure)/chat-1[0-9]*-(7|13)b"]
    models = t.usage().groupBy("model").agg(F.count(F.lit(1)).alias("requests"))
    return models.select("model", PO.model_condition(F.col("model"), condition).alias("matches"), "requests")


add_view("policy_list", """
    SELECT 'r' || s_suppkey AS policy, s_suppkey AS n,
           CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent_n,
           ['g' || (s_nationkey % 7), 'g' || (s_suppkey % 5)] AS added,
           CASE WHEN s_suppkey % 4 = 0 THEN ['g' || (s_suppkey % 3)] ELSE [] END AS removed,
           s_suppkey % 6 <> 5 AS applies FROM supplier""")


def policy_list(t: Tables):
    n, nation = F.col("s_suppkey"), F.col("s_nationkey")
    def g(col, m):
        return F.concat(F.lit("g"), (col % m).cast("string"))
    empty = F.array().cast("array<string>")
    return t.raw("supplier").select(
        F.concat(F.lit("r"), n.cast("string")).alias("policy"),
        F.when(n > 0, F.concat(F.lit("r"), F.floor(n / 3).cast("string"))).alias("parent"),
        F.array(g(nation, 7), g(n, 5)).alias("add"), F.when(n % 4 == 0, F.array(g(n, 3))).otherwise(empty).alias("remove"),
        (n % 6 != 5).alias("applies"))


CHAIN_SQL = """
WITH RECURSIVE walk AS (
  SELECT policy, n, policy AS chain, {start} AS guards FROM policy_list WHERE parent_n IS NULL
  UNION ALL
  SELECT c.policy, c.n, walk.chain || '>' || c.policy, {step} FROM policy_list c JOIN walk ON c.parent_n = walk.n)"""


def recursive(select: str, start: str = "NULL::VARCHAR[]", step: str = "NULL::VARCHAR[]") -> str:
    return f"SELECT * FROM ({CHAIN_SQL.format(start=start, step=step)} {select})"


@query("inheritance_chain", recursive("SELECT policy, chain, false AS cyclic FROM walk"))
def inheritance_chain(t: Tables):
    chains = PO.inheritance_chains(policy_list(t).select("policy", "parent"))
    return chains.select("policy", F.array_join("chain", ">").alias("chain"), "cyclic")


FOLD = ("CASE WHEN {c}applies THEN list_filter(list_distinct(list_concat({acc}, {c}added)),"
        " lambda x: NOT list_contains({c}removed, x)) ELSE {acc} END")


@query("effective_guardrails", recursive(
    "SELECT policy, array_to_string(list_sort(guards), ',') AS guardrails FROM walk",
    FOLD.format(c="", acc="CAST([] AS VARCHAR[])"), FOLD.format(c="c.", acc="walk.guards")))
def effective_guardrails(t: Tables):
    rules = policy_list(t)
    chains = PO.inheritance_chains(rules.select("policy", "parent"))
    return PO.effective_guardrails(rules, chains, F.col("applies")).select(
        "policy", F.array_join("guardrails", ",").alias("guardrails"))


# ---- compliance ------------------------------------------------------------
@query("compliance_checks", """
WITH base AS (
 SELECT request_id, model, readable,
  CASE WHEN readable THEN (call_no <= 5)::INT + (call_no IN (2, 4))::INT + (call_no = 2)::INT ELSE 0 END AS n_all,
  CASE WHEN readable THEN (call_no <= 5 AND part_id % 2 = 0)::INT + (call_no IN (2, 4))::INT
       + (call_no = 2 AND part_id % 2 = 0)::INT ELSE 0 END AS n_pre,
  readable AND call_no <= 5 AND part_id % 2 = 0 AND main_status = 'guardrail_intervened' AS stopped,
  readable AND NOT (call_no <= 5 AND part_id % 2 = 0 AND main_status <> 'success') AS clean FROM guardrail_base),
 audit AS (SELECT *, concat_ws(', ', CASE WHEN model = '' THEN 'model' END, CASE WHEN n_all = 0 THEN 'guardrail_results' END)
             AS missing FROM base)
SELECT request_id, 'Guardrails applied' AS check_name, 'Art. 9' AS article, n_all > 0 AS passed,
       CASE WHEN n_all > 0 THEN n_all || ' guardrail(s) applied' ELSE 'No guardrails applied' END AS detail FROM audit
UNION ALL SELECT request_id, 'Content screened before LLM', 'Art. 5', n_pre > 0,
       CASE WHEN n_pre > 0 THEN n_pre || ' pre-call guardrail(s) screened content' ELSE 'No pre-call screening applied' END FROM audit
UNION ALL SELECT request_id, 'Audit record complete', unnest(['Art. 12', 'Art. 30']), missing = '',
       CASE WHEN missing = '' THEN 'All required audit fields present' ELSE 'Missing: ' || missing END FROM audit
UNION ALL SELECT request_id, 'Data protection applied', 'Art. 32', n_pre > 0,
       CASE WHEN n_pre > 0 THEN n_pre || ' pre-call guardrail(s) protect data' ELSE 'No pre-call data protection applied' END FROM audit
UNION ALL SELECT request_id, 'Sensitive data protected', 'Art. 5(1)(c)', stopped OR (n_pre > 0 AND clean),
       CASE WHEN stopped THEN 'Guardrail intervened to protect sensitive data' WHEN n_pre > 0 AND clean
            THEN 'No sensitive data detected' ELSE 'No pre-call guardrails to protect sensitive data' END FROM audit"""
       .replace("WITH base AS", "SELECT * FROM (WITH base AS") + ")")
def compliance_checks(t: Tables):
    return G.compliance_checks(with_metadata(t.usage(with_user=True)))
