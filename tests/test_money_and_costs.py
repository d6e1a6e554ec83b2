import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import cost as C
from ledgerlight.functions.money import sum_money


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def bands(*rows):
    return F.array(*[F.struct(F.lit(lo).cast("bigint").alias("low"), F.lit(hi).cast("bigint").alias("high"),
                              F.lit(rate).cast("double").alias("rate"), F.lit(other).cast("double").alias("other"))
                     for lo, hi, rate, other in rows])


THREE = ((0, 100, 0.01, 0.5), (100, 500, 0.005, None), (500, 1000, 0.001, None))


@pytest.mark.parametrize("tokens,expected", [
    (0, 0.0), (-5, 0.0), (50, 0.5), (100, 1.0), (150, 1.25), (500, 3.0), (1000, 3.5), (1500, 4.0)])
def test_tiers_are_marginal(spark, tokens, expected):
    got = one(spark, c=C.tiered_cost(F.lit(tokens).cast("bigint"), bands(*THREE), "rate")).c
    assert got == pytest.approx(expected)


def test_tiers_may_come_unsorted_and_fall_back(spark):
    mixed = bands(THREE[1], THREE[0])
    assert one(spark, c=C.tiered_cost(F.lit(150).cast("bigint"), mixed, "rate")).c == pytest.approx(1.25)
    fallback = bands((0, 10, None, 2.0))
    assert one(spark, c=C.tiered_cost(F.lit(4).cast("bigint"), fallback, "rate", "other")).c == pytest.approx(8.0)
    empty = F.filter(bands(THREE[0]), lambda b: F.lit(False))
    assert one(spark, c=C.tiered_cost(F.lit(4).cast("bigint"), empty, "rate")).c == 0.0


def test_cache_rate_falls_back_to_input_rate(spark):
    null = F.lit(None).cast("double")
    row = one(spark, own=C.prompt_cost(F.lit(100), F.lit(40), F.lit(0.1), F.lit(0.01)),
              other=C.prompt_cost(F.lit(100), F.lit(40), F.lit(0.1), null))
    assert (row.own, row.other) == (pytest.approx(6.4), pytest.approx(10.0))


def test_priorities(spark):
    null = F.lit(None).cast("double")
    prices = F.create_map(F.lit("search"), F.lit(0.2), F.lit("free"), F.lit(0.0))
    row = one(spark, given=C.per_query(F.lit(3.0), F.lit(1.0), F.lit(1), F.lit(1), F.lit(1.0), F.lit(1.0)),
              fixed=C.per_query(null, F.lit(1.0), F.lit(1), F.lit(1), F.lit(1.0), F.lit(1.0)),
              tokens=C.per_query(null, null, F.lit(2), F.lit(3), F.lit(1.0), null), nothing=C.per_query(null, null, F.lit(2), F.lit(3), null, null),
              tool=C.per_tool(F.lit("search"), prices, F.lit(0.5)), free=C.per_tool(F.lit("free"), prices, F.lit(0.5)),
              other=C.per_tool(F.lit("x"), prices, F.lit(0.5)), none=C.per_tool(F.lit("x"), prices, null))
    assert row.asDict() == {"given": 3.0, "fixed": 1.0, "tokens": 2.0, "nothing": 0.0, "tool": 0.2, "free": 0.0, "other": 0.5, "none": 0.0}


def test_long_context_is_a_cliff(spark):
    row = one(spark, below=C.per_token_cliff(F.lit(128_000), F.lit(1.0), F.lit(2.0)),
              above=C.per_token_cliff(F.lit(128_001), F.lit(1.0), F.lit(2.0)))
    assert (row.below, row.above) == (128_000.0, 256_002.0)


@pytest.mark.parametrize("name,first,second", [
    ("Chat-3b", "up-to-4b", "up-to-4b"), ("chat-3.5b", "4.1b-8b", "4.1b-to-16b"), ("m-70b", "41.1b-80b", "above-16b"),
    ("m-180b", "m-180b", "above-16b"), ("m-8x7b", "4.1b-8b", "moe-up-to-56b"), ("m-8x22b", "21.1b-41b", "moe-56b-to-176b"),
    ("tiny", "tiny", "default")])
def test_sizes(spark, name, first, second):
    row = one(spark, a=C.size_category(F.lit(name)), b=C.mixture_category(F.lit(name)))
    assert (row.a, row.b) == (first, second)


def test_money_does_not_depend_on_order(spark):
    values = [0.1] * 10 + [1e6, 1e-7, -0.3]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    up = frame.orderBy("v").coalesce(1).agg(sum_money("v").alias("s")).first().s
    down = frame.orderBy(F.desc("v")).coalesce(1).agg(sum_money("v").alias("s")).first().s
    assert up == down == 1000000.7000001
