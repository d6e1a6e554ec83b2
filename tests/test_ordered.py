"""Bucketed windows equal plain windows, also when one key holds most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlight.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    return spark.range(6000).select(
        "id", hot.alias("key"), (F.pmod(F.xxhash64("id"), F.lit(1000)) - 200).alias("value"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64(F.col("id") + 7), F.lit(400_000))).cast("timestamp_ntz").alias("ts"))


def same(left, right):
    columns = sorted(left.columns)
    return sorted(map(tuple, left.select(columns).collect())) == sorted(map(tuple, right.select(columns).collect()))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_totals(rows, inclusive):
    got = O.running_totals(rows, ["key"], ["ts", "id"], {"total": F.col("value")}, F.to_date("ts"), inclusive)
    frame = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    assert same(got, rows.withColumn("total", F.coalesce(F.sum("value").over(frame), F.lit(0))))


def test_ordinals(rows):
    got = O.ordinals(rows, ["key"], ["ts", "id"], F.to_date("ts"))
    assert same(got, rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")).cast("bigint")))


@pytest.mark.parametrize("seconds", [30, 3600, 200_000])
@pytest.mark.parametrize("open_start", [True, False])
def test_trailing_count(rows, seconds, open_start):
    unique = rows.dropDuplicates(["key", "ts"])
    got = O.trailing_count(unique, ["key"], "ts", "id", seconds, open_start).select("id", "recent")
    span = seconds * 1_000_000 - (1 if open_start else 0)
    frame = Window.partitionBy("key").orderBy(O.epoch_micros("ts")).rangeBetween(-span, 0)
    assert same(got, unique.select("id", F.count(F.lit(1)).over(frame).alias("recent")))


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_trailing_rows(rows, block):
    numbered = O.ordinals(rows, ["key"], ["ts", "id"], F.to_date("ts"))
    got = O.trailing_rows(numbered, ["key"], "ordinal", 3, {"s": F.sum("value")}, block=block)
    frame = Window.partitionBy("key").orderBy("ordinal").rowsBetween(-2, 0)
    assert same(got, numbered.withColumn("s", F.sum("value").over(frame)))


@pytest.mark.parametrize("gap", [10, 60, 5000])
def test_gap_sessions(rows, gap):
    got = O.gap_sessions(rows, ["key"], "ts", gap, {"total": F.col("value")}).select(
        "key", "session_start", "session_end", "rows_in_session", "total")
    order = Window.partitionBy("key").orderBy("ts", "id")
    jump = F.coalesce(O.epoch_micros("ts") - F.lag(O.epoch_micros("ts")).over(order) > gap * 1_000_000, F.lit(True))
    plain = rows.withColumn("_j", jump.cast("int")).withColumn("_s", F.sum("_j").over(order)).groupBy("key", "_s").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("rows_in_session"),
        F.sum("value").alias("total")).drop("_s")
    assert same(got, plain)
