"""The registered queries of this subpackage and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import alignment, audit, collisions, decontaminate, lm, metric_search, mixing, placement, simhash, substrings, toxicity, urls, warc
from ledgerlight.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


MIX_SQL = """
WITH sized AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
ranked AS (
    SELECT source, source_size, 2 * source_size AS cap, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
           1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources),
levels AS (
    SELECT *, (total - COALESCE(sum(cap) OVER w, 0)::DOUBLE) / (sum(weight) OVER () - COALESCE(sum(weight) OVER w, 0))::DOUBLE AS level,
           cap::DOUBLE / weight AS full_at FROM ranked
    WINDOW w AS (ORDER BY cap::DOUBLE / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source, source_size, least(cap::DOUBLE, weight * COALESCE((SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, level LIMIT 1), 'inf'::DOUBLE)) AS target
    FROM levels),
rates AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
"""


@query("op9_mix_sources", MIX_SQL)
def op9(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op6_shard_placement")
def op6(spark, sf_dir):
    return placement.placement_report(table(spark, sf_dir, "documents"))


@query("op4_simhash_balls")
def op4(spark, sf_dir):
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


@query("op3_suffix_decontamination")
def op3(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_warc_index")
def op2(spark, sf_dir):
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query("op7_url_templates")
def op7(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op1_substring_dedup")
def op1(spark, sf_dir):
    return substrings.cut_report(table(spark, sf_dir, "documents"))


@query("op5_weak_toxicity")
def op5(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_trie_language_model")
def op10(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query("op8_collision_counting")
def op8(spark, sf_dir):
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


TOP_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
ranked AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
           row_number() OVER (PARTITION BY q.number ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
    FROM whole q JOIN whole c ON q.number <> c.number AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op11_exact_top_k", TOP_SQL)
def op11(spark, sf_dir):
    return metric_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


AUDIT_SQL = """
WITH texts AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
marked AS (
    SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS failed FROM words),
named AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
kinds AS (
    SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM marked LEFT JOIN named USING (doc_id) GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT [a.x, b.x, c.x, d.x, e.x] AS xs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
    SELECT array_to_string(xs, '') AS filter_order, step::INT AS step, bits[step] AS own, COALESCE(list_sum(bits[:step - 1]), 0)::INT AS before
    FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
counted AS (
    SELECT part, filter_order, step, own, COALESCE(sum(n) FILTER ((failed & (before | own)) = 0), 0) AS kept,
           COALESCE(sum(n) FILTER ((failed & before) = 0 AND (failed & own) > 0), 0) AS removed,
           COALESCE(sum(n) FILTER ((failed & before) > 0 AND (failed & own) > 0), 0) AS redundant,
           COALESCE(sum(n) FILTER (failed = own), 0) AS unique_fails,
           COALESCE(sum(good) FILTER ((failed & before) = 0 AND (failed & own) > 0), 0) AS good_lost,
           COALESCE(sum(toxic) FILTER ((failed & before) = 0 AND (failed & own) > 0), 0) AS toxic_lost
    FROM kinds, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark, sf_dir):
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
