"""The domain views once more as SQL, for the independent check.

``with_views`` puts the common table expressions a statement mentions in front
of it.  The texts repeat the mapping of sources/adapters.py in SQL and share no
code with it.
"""

from __future__ import annotations

import re

_MODEL_SIZE = ("CASE l_partkey % 7 WHEN 0 THEN '3' WHEN 1 THEN '7' WHEN 2 THEN '13' WHEN 3 THEN '34' "
               "WHEN 4 THEN '70' WHEN 5 THEN '8' ELSE '180' END")
_VENDOR = "CASE l_partkey % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'vertex_ai' ELSE 'azure' END"
_CENTS = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
_PERCENT = "CAST(floor((1.0 - l_discount) * 100 + 0.5) AS BIGINT)"
_START = ("l_shipdate + ((l_orderkey * 13 + l_partkey * 7 + l_linenumber * 601) % 86400) * INTERVAL '1' SECOND")
_Q = "CAST(l_quantity AS BIGINT)"

VIEWS: dict[str, str] = {
    "usage_rows": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CENTS}) AS request_id,
               l_orderkey AS session_id,
               'k' || l_suppkey AS api_key,
               CASE WHEN l_partkey % 89 = 0 THEN ''
                    ELSE {_VENDOR} || '/chat-' || (l_partkey % 25) || '-' || {_MODEL_SIZE} || 'b' END AS model,
               CASE WHEN l_partkey % 97 <> 0 THEN {_VENDOR} END AS provider,
               'group-' || (l_partkey % 5) AS model_group,
               CASE WHEN l_linenumber % 3 = 0 THEN 'embedding' ELSE 'completion' END AS call_type,
               {_START} AS start_time,
               {_START} + {_Q} * INTERVAL '1' SECOND AS end_time,
               {_Q} * 10 AS prompt_tokens, {_Q} * 4 AS completion_tokens,
               {_CENTS} * {_PERCENT} AS spend_units,
               CAST({_CENTS} * {_PERCENT} AS DOUBLE) / 10000000.0 AS spend,
               CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL
                    WHEN l_linestatus = 'F' THEN 'True' ELSE 'False' END AS cache_hit,
               CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL
                    WHEN l_linestatus = 'F' THEN {_Q} * 5 ELSE 0 END AS cache_read_tokens,
               CASE WHEN l_linenumber = 3 THEN {_Q} * 2 ELSE 0 END AS cache_creation_tokens,
               CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END AS status,
               CASE WHEN l_linenumber <= 4 THEN 'agent-' || (l_suppkey % 6) END AS agent_id,
               CASE WHEN l_linenumber = 1 THEN 'srv' || (l_partkey % 3) END AS mcp_server,
               l_partkey AS part_id, l_suppkey AS deployment_no, l_linenumber AS call_no,
               {_Q} AS quantity, l_discount AS discount, l_orderkey, l_linenumber, l_partkey
        FROM lineitem""",
    "usage_full": """
        SELECT usage_rows.*, 'u' || o_custkey AS user_id,
               CASE WHEN l_linenumber % 4 = 0 THEN 'u' || o_custkey WHEN l_linenumber % 4 = 1 THEN ''
                    ELSE 'e' || (l_partkey % 200) END AS end_user,
               CASE WHEN l_orderkey % 53 = 0 THEN NULL
                    WHEN l_orderkey % 7 = 0 THEN CAST([] AS VARCHAR[])
                    WHEN l_linenumber = 2
                      THEN [o_orderpriority, o_orderpriority, 'User-Agent: agent-' || l_linenumber]
                    ELSE [o_orderpriority, 'User-Agent: agent-' || l_linenumber] END AS tags
        FROM usage_rows LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "api_keys": """
        SELECT 'k' || s_suppkey AS token,
               CASE WHEN s_suppkey % 5 <> 0 THEN 'alias-' || (s_suppkey % 40) END AS key_alias,
               s_name AS key_name, 't' || s_nationkey AS team_id,
               CASE WHEN s_suppkey % 3 = 0 THEN 'p' || (s_suppkey % 8) END AS project_id
        FROM supplier WHERE s_acctbal >= 0""",
    "teams": """
        SELECT 't' || n_nationkey AS team_id, n_name AS team_alias, 'o' || n_regionkey AS organization_id,
               n_nationkey * 100.0::DOUBLE AS team_max_budget, n_nationkey::BIGINT * 1000 AS team_tpm_limit,
               CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey::BIGINT * 10 END AS team_rpm_limit
        FROM nation""",
    "projects": "SELECT 'p' || r_regionkey AS project_id, r_name AS project_alias FROM region",
    "organizations": "SELECT 'o' || r_regionkey AS organization_id, r_name AS organization_alias FROM region",
    "app_users": """
        SELECT 'u' || c_custkey AS user_id,
               CASE WHEN c_acctbal >= 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS user_email,
               c_name AS user_alias, c_mktsegment AS segment, c_acctbal AS balance, c_acctbal < 0 AS blocked
        FROM customer""",
    "price_list": """
        SELECT p_partkey AS part_id, p_retailprice / 10000000.0::DOUBLE AS input_rate,
               p_retailprice / 10000000.0::DOUBLE * 4.0::DOUBLE AS output_rate,
               CASE WHEN p_size % 2 = 0 THEN p_retailprice / 10000000.0::DOUBLE / 2.0::DOUBLE END AS cache_read_rate,
               CASE WHEN p_size % 3 = 0 THEN p_retailprice / 10000000.0::DOUBLE * 6.0::DOUBLE END AS reasoning_rate,
               CASE WHEN p_size > 40 THEN p_retailprice / 10000000.0::DOUBLE * 2.0::DOUBLE END AS override_rate,
               p_size::BIGINT AS band_size, p_type AS price_class
        FROM part""",
    "user_daily": """
        SELECT user_id, CAST(start_time AS DATE) AS day, api_key, model, model_group, provider,
               CAST(sum(spend_units) AS DOUBLE) / 10000000.0 AS spend, sum(spend_units)::BIGINT AS spend_units,
               sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
               count(*)::BIGINT AS api_requests,
               count(*) FILTER (WHERE status = 'success')::BIGINT AS successful_requests,
               count(*) FILTER (WHERE status <> 'success')::BIGINT AS failed_requests,
               coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens,
               coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens
        FROM usage_full GROUP BY ALL""",
    "telemetry": """
        SELECT event_id AS request_id, user_id AS session_id, ts AS created_at, event_type,
               CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, value AS latency_ms,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS score,
               CAST(json_extract_string(props, '$.k') AS BIGINT) >= 80 AS injection_detected,
               CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 60 AND 89 AS dlp_detected,
               CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 THEN 'high'
                    WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 70 THEN 'medium'
                    WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 'low' ELSE 'none' END AS risk,
               CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 'input' ELSE 'output' END AS stage
        FROM events""",
    "chat": """
        SELECT conv_id, turn, role, text,
               TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn * 7) * INTERVAL '1' SECOND AS ts
        FROM conversations""",
    "cases": "SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)",
}


def add_view(name: str, sql: str) -> None:
    """Register another view; it may mention the ones defined before."""
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix *sql* with the views it mentions, in order of definition."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        body = queue.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", body):
                needed.add(name)
                queue.append(VIEWS[name])
    if not needed:
        return sql
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {parts}\n{sql}"
