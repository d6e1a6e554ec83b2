"""Queries that price the usage log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.functions import cost as C
from ledgerlight.functions.money import sum_money
from ledgerlight.operators import pricing as P
from ledgerlight.plans.oracle_views import add_view
from ledgerlight.plans.registry import query
from ledgerlight.sources.adapters import Tables

add_view("priced_rows", """
    SELECT u.*, p.input_rate, p.output_rate, p.cache_read_rate, p.reasoning_rate, p.override_rate, p.band_size,
           p.price_class, completion_tokens // 4 AS reasoning_tokens, coalesce(cache_read_tokens, 0) AS cached,
           quantity // 10 AS searches
    FROM usage_rows u LEFT JOIN price_list p USING (part_id)""")


def priced(t: Tables):
    rows = P.with_rates(t.usage(), t.prices())
    return (rows.withColumn("reasoning_tokens", F.floor(F.col("completion_tokens") / 4))
            .withColumn("searches", F.floor(F.col("quantity") / 10)))


def costed(t: Tables, cost):
    return priced(t).select("request_id", F.round(cost, 12).alias("cost"))


def row_sql(expression: str) -> str:
    return f"SELECT request_id, round({expression}, 12) AS cost FROM priced_rows"


col = F.col


@query("rate_join", """
SELECT price_class, count(*)::BIGINT AS requests,
       CAST(sum(CAST(floor(coalesce(override_rate, input_rate, 5.0::DOUBLE) * prompt_tokens * 10000000.0::DOUBLE + 0.5::DOUBLE)
            AS BIGINT)) AS DOUBLE) / 10000000.0 AS input_cost
FROM priced_rows GROUP BY 1""")
def rate_join(t: Tables):
    return priced(t).groupBy("price_class").agg(
        F.count(F.lit(1)).alias("requests"),
        sum_money(col("effective_input_rate") * col("prompt_tokens")).alias("input_cost"))


@query("cost_flat", row_sql(
    "(prompt_tokens - cached) * coalesce(input_rate, 0) + cached * coalesce(cache_read_rate, input_rate, 0)"))
def cost_flat(t: Tables):
    return costed(t, C.prompt_cost(col("prompt_tokens"), col("cache_read_tokens"), col("input_rate"), col("cache_read_rate")))


@query("cost_reasoning", row_sql(
    "(completion_tokens - reasoning_tokens) * coalesce(output_rate, 0)"
    " + reasoning_tokens * coalesce(reasoning_rate, output_rate, 0)"))
def cost_reasoning(t: Tables):
    return costed(t, C.completion_cost(col("completion_tokens"), col("reasoning_tokens"), col("output_rate"),
                                       col("reasoning_rate")))


BANDS_SQL = """
least(n, band_size * 10) * input_rate
+ greatest(least(n, band_size * 20) - band_size * 10, 0) * input_rate * 0.5::DOUBLE
+ greatest(n - band_size * 20, 0) * input_rate * 0.25::DOUBLE"""


@query("cost_tiered", f"""
SELECT request_id, round(coalesce(CASE WHEN n > 0 THEN {BANDS_SQL} END, 0), 12) AS cost
FROM (SELECT *, prompt_tokens - cached AS n FROM priced_rows)""")
def cost_tiered(t: Tables):
    rows = P.price_bands(priced(t))
    tokens = col("prompt_tokens") - F.coalesce("cache_read_tokens", F.lit(0))
    return rows.select("request_id", F.round(F.coalesce(C.tiered_cost(tokens, col("bands"), "input_rate"), F.lit(0.0)), 12)
                       .alias("cost"))


@query("tier_range_join", """
SELECT request_id,
  CAST(sum(CAST(floor(piece * rate * 10000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000000.0 AS tier_cost,
  count(*)::BIGINT AS bands_used
FROM (
  SELECT request_id, rate, greatest(least(tokens, high) - low, 0)
         + CASE WHEN band_no = 3 THEN greatest(tokens - high, 0) ELSE 0 END AS piece
  FROM (SELECT request_id, part_id, prompt_tokens AS tokens FROM usage_rows) r
  JOIN (SELECT part_id, 1 AS band_no, 0 AS low, band_size * 10 AS high, input_rate AS rate FROM price_list
        UNION ALL SELECT part_id, 2, band_size * 10, band_size * 20, input_rate * 0.5::DOUBLE FROM price_list
        UNION ALL SELECT part_id, 3, band_size * 20, band_size * 40, input_rate * 0.25::DOUBLE FROM price_list) b
    ON r.part_id = b.part_id AND tokens > low)
GROUP BY request_id""")
def tier_range_join(t: Tables):
    bands = P.price_bands(t.prices()).select(
        col("part_id").alias("band_key"), F.posexplode("bands").alias("band_no", "band")).select(
        "band_key", "band.low", "band.high", col("band.input_rate").alias("rate"), (col("band_no") == 2).alias("is_last"))
    requests = t.usage().select("request_id", "part_id", col("prompt_tokens").alias("tokens"))
    return P.tier_overlap_cost(requests, bands, "part_id")


FACTOR_SQL = ("(CASE WHEN mcp_server = 'srv1' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END"
              " * CASE WHEN call_no = 2 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END)")


@query("cost_multiplier", row_sql(
    f"(prompt_tokens * coalesce(input_rate, 0) - cached * coalesce(cache_read_rate, 0)) * {FACTOR_SQL}"
    " + cached * coalesce(cache_read_rate, 0)"))
def cost_multiplier(t: Tables):
    factor = (F.when(col("mcp_server") == "srv1", 1.1).otherwise(1.0) * F.when(col("call_no") == 2, 6.0).otherwise(1.0))
    cache = C.or_zero("cache_read_tokens") * C.or_zero("cache_read_rate")
    return costed(t, C.multiplied(C.or_zero("prompt_tokens") * C.or_zero("input_rate"), cache, factor))


@query("cost_addons", row_sql(
    "coalesce(CASE WHEN call_no = 4 THEN spend END, prompt_tokens * coalesce(input_rate, 0) + searches * 0.000002::DOUBLE"
    " + completion_tokens * coalesce(output_rate, 0) + reasoning_tokens * coalesce(reasoning_rate, 0)"
    " + searches * 0.005::DOUBLE)"))
def cost_addons(t: Tables):
    given = F.when(col("call_no") == 4, col("spend"))
    rates = {"input": col("input_rate"), "citation": F.lit(0.000002), "output": col("output_rate"),
             "reasoning": col("reasoning_rate"), "search": F.lit(0.005)}
    return costed(t, C.with_addons(given, col("prompt_tokens"), col("completion_tokens"), col("searches"),
                                   col("reasoning_tokens"), col("searches"), rates))


@query("cost_per_second", row_sql(
    "coalesce(CASE WHEN call_type = 'embedding' THEN input_rate * 1000.0::DOUBLE END * quantity,"
    " output_rate * 100.0::DOUBLE * quantity, 0)"))
def cost_per_second(t: Tables):
    first = F.when(col("call_type") == "embedding", col("input_rate") * 1000.0)
    return costed(t, C.per_second(col("quantity"), first, col("output_rate") * 100.0))


@query("cost_per_character", """
SELECT request_id, round(coalesce(CASE WHEN chars * 4 > 128000 THEN chars * input_rate * 2.0::DOUBLE
                                       ELSE chars * cache_read_rate END,
         CASE WHEN tokens > 128000 THEN tokens * input_rate * 2.0::DOUBLE ELSE tokens * coalesce(input_rate, 0) END), 12) AS cost,
       round(CASE WHEN tokens > 128000 AND cache_read_rate IS NOT NULL THEN tokens * cache_read_rate
                  ELSE tokens * coalesce(input_rate, 0) END, 12) AS token_cost
FROM (SELECT *, prompt_tokens * 100 AS chars, prompt_tokens * 400 AS tokens FROM priced_rows)""")
def cost_per_character(t: Tables):
    characters, tokens = col("prompt_tokens") * 100, col("prompt_tokens") * 400
    by_token = C.per_token_cliff(tokens, col("input_rate"), col("input_rate") * 2.0)
    return priced(t).select(
        "request_id",
        F.round(C.per_character(characters, col("cache_read_rate"), col("input_rate") * 2.0, by_token), 12).alias("cost"),
        F.round(C.per_token_cliff(tokens, col("input_rate"), col("cache_read_rate")), 12).alias("token_cost"))


@query("cost_visible_plus_reasoning", row_sql(
    "prompt_tokens * coalesce(input_rate, 0) + (completion_tokens + reasoning_tokens) * coalesce(output_rate, 0)"
    " + searches * 0.025::DOUBLE"))
def cost_visible_plus_reasoning(t: Tables):
    return costed(t, C.visible_plus_reasoning(
        col("prompt_tokens"), col("completion_tokens"), col("reasoning_tokens"), col("searches"), col("input_rate"),
        col("output_rate")))


@query("cost_per_query", row_sql(
    "coalesce(CASE WHEN call_no = 1 THEN spend END, CASE WHEN call_no = 2 THEN 0.01::DOUBLE END,"
    " prompt_tokens * coalesce(input_rate, 0) + completion_tokens * coalesce(output_rate, 0))"))
def cost_per_query(t: Tables):
    return costed(t, C.per_query(
        F.when(col("call_no") == 1, col("spend")), F.when(col("call_no") == 2, 0.01), col("prompt_tokens"),
        col("completion_tokens"), col("input_rate"), col("output_rate")))


@query("cost_per_tool", """
SELECT request_id, coalesce(CASE 'tool' || (part_id % 6) WHEN 'tool0' THEN 0.1::DOUBLE WHEN 'tool1' THEN 0.25::DOUBLE
                                 WHEN 'tool2' THEN 0.0::DOUBLE END,
                            CASE WHEN mcp_server = 'srv0' THEN 0.05::DOUBLE END, 0) AS cost
FROM usage_rows WHERE mcp_server IS NOT NULL""")
def cost_per_tool(t: Tables):
    prices = F.create_map(F.lit("tool0"), F.lit(0.1), F.lit("tool1"), F.lit(0.25), F.lit("tool2"), F.lit(0.0))
    tool = F.concat(F.lit("tool"), (col("part_id") % 6).cast("string"))
    default = F.when(col("mcp_server") == "srv0", 0.05)
    return t.usage().where(col("mcp_server").isNotNull()).select(
        "request_id", C.per_tool(tool, prices, default).alias("cost"))


SIZE_SQL = """CASE WHEN size <= 4 THEN 'up-to-4b' WHEN size <= 8 THEN '4.1b-8b' WHEN size <= 21 THEN '8.1b-21b'
 WHEN size <= 41 THEN '21.1b-41b' WHEN size <= 80 THEN '41.1b-80b' WHEN size <= 110 THEN '81.1b-110b' ELSE name END"""


@query("model_size_category", f"""
SELECT name, {SIZE_SQL.replace('81.1b', '80.1b').replace('80.1b-110b', '81.1b-110b')} AS category,
  CASE WHEN product <= 56 THEN 'moe-up-to-56b' WHEN product <= 176 THEN 'moe-56b-to-176b'
       WHEN size <= 4 THEN 'up-to-4b' WHEN size <= 16 THEN '4.1b-to-16b' WHEN size > 16 THEN 'above-16b'
       ELSE 'default' END AS mixture_category, count(*)::BIGINT AS requests
FROM (SELECT name, TRY_CAST(regexp_extract(name, '(\\d+)b', 1) AS BIGINT) AS size,
             TRY_CAST(regexp_extract(name, '(\\d+)x(\\d+)b', 1) AS BIGINT)
             * TRY_CAST(regexp_extract(name, '(\\d+)x(\\d+)b', 2) AS BIGINT) AS product
      FROM (SELECT CASE WHEN call_no = 7 THEN replace(model, '-8b', '-8x22b') WHEN call_no = 6 THEN replace(model, '-7b', '-8x7b')
                        WHEN call_no = 5 THEN replace(model, '-3b', '-3.5b') ELSE model END AS name FROM usage_rows))
GROUP BY 1, 2, 3""")
def model_size_category(t: Tables):
    name = (F.when(col("call_no") == 7, F.replace(col("model"), F.lit("-8b"), F.lit("-8x22b")))
            .when(col("call_no") == 6, F.replace(col("model"), F.lit("-7b"), F.lit("-8x7b")))
            .when(col("call_no") == 5, F.replace(col("model"), F.lit("-3b"), F.lit("-3.5b"))).otherwise(col("model")))
    counted = t.usage().groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("name", C.size_category(col("name")).alias("category"),
                          C.mixture_category(col("name")).alias("mixture_category"), "requests")


@query("cost_breakdown", """
SELECT request_id, round(original, 12) AS original_cost, round(original * pct, 12) AS discount_amount,
       round((original - original * pct) * 0.2::DOUBLE + 0.001::DOUBLE, 12) AS margin_amount,
       round((original - original * pct) + ((original - original * pct) * 0.2::DOUBLE + 0.001::DOUBLE), 12) AS total_cost
FROM (SELECT request_id, discount AS pct, prompt_tokens * coalesce(input_rate, 0) + completion_tokens * coalesce(output_rate, 0)
             + searches * 0.005::DOUBLE + (0.0::DOUBLE + 0.0001::DOUBLE * call_no + 0.0002::DOUBLE) AS original FROM priced_rows)""")
def cost_breakdown(t: Tables):
    extra = F.create_map(F.lit("storage"), F.lit(0.0001) * col("call_no"), F.lit("transfer"), F.lit(0.0002))
    parts = C.breakdown(C.or_zero("prompt_tokens") * C.or_zero("input_rate"),
                        C.or_zero("completion_tokens") * C.or_zero("output_rate"), col("searches") * 0.005, extra,
                        col("discount"), F.lit(0.2), F.lit(0.001))
    return priced(t).select("request_id", *[F.round(v, 12).alias(k) for k, v in parts.items()])


@query("user_model_cost", """
SELECT user_id, model, CAST(units AS DOUBLE) / 10000000.0 AS model_cost,
       CAST(sum(units) OVER (PARTITION BY user_id) AS DOUBLE) / 10000000.0 AS current_cost
FROM (SELECT user_id, model, sum(spend_units) AS units FROM usage_full GROUP BY 1, 2)""")
def user_model_cost(t: Tables):
    return P.user_model_cost(t.usage(with_user=True))


@query("user_budget_check", """
SELECT user_id, spend, max_budget, coalesce(spend >= max_budget, false) AS exceeded
FROM (SELECT 'u' || c_custkey AS user_id, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal * 0.01 END AS max_budget FROM customer)
LEFT JOIN (SELECT user_id, CAST(sum(spend_units) AS DOUBLE) / 10000000.0 AS spend FROM usage_full GROUP BY 1) USING (user_id)""")
def user_budget_check(t: Tables):
    budgets = t.raw("customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
                                       F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") * 0.01).alias("max_budget"))
    return P.over_budget(t.usage(with_user=True), budgets)


@query("provider_budget", """
SELECT provider, coalesce(spend, 0) AS spend, budget_limit, budget_limit - coalesce(spend, 0) AS remaining,
       coalesce(spend, 0) >= budget_limit AS exhausted
FROM (SELECT provider, CAST(sum(spend_units) AS DOUBLE) / 10000000.0 AS spend FROM usage_rows
      WHERE provider IS NOT NULL AND start_time >= TIMESTAMP '2000-01-01' AND start_time < TIMESTAMP '2000-02-01' GROUP BY 1)
FULL JOIN (SELECT * FROM (VALUES ('openai', 100.0::DOUBLE), ('anthropic', 1000000.0::DOUBLE), ('bedrock', 50.0::DOUBLE))
           AS v(provider, budget_limit)) USING (provider)""")
def provider_budget(t: Tables):
    limits = t.spark.createDataFrame([("openai", 100.0), ("anthropic", 1000000.0), ("bedrock", 50.0)],
                                     "provider string, budget_limit double")
    since, until = dt.datetime(2000, 1, 1), dt.datetime(2000, 2, 1)
    return P.provider_budget(t.usage(since=since, until=until), limits, since, until)
