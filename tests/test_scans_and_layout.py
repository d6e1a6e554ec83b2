"""Measured buckets, quantiles without a width, file layouts, the shared folder, streams whose state ends."""

import datetime as dt
import glob
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlight import session
from ledgerlight.operators import ordered as O
from ledgerlight.operators import quantiles as Q
from ledgerlight.sources import writers as W
from ledgerlight.streaming import jobs as J
from ledgerlight.streaming import runner as RN
from ledgerlight.streaming import stateful as ST


@pytest.fixture(scope="module")
def hot(spark):
    """Nine of ten rows belong to one key and lie within one day."""
    key = F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 > 0, F.concat(F.lit("k"), F.col("id") % 30))
    skewed = F.pow(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000.0, F.lit(4.0)) * 80_000_000_000
    return spark.range(20_000).select("id", key.alias("key"), F.timestamp_micros((F.lit(1_700_000_000_000_000) + skewed + F.col("id")).cast("bigint")).cast("timestamp_ntz").alias("ts"),
                                      (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) - 50).alias("value")).repartition(6)


def same(left, right):
    columns = sorted(left.columns)
    return sorted(map(repr, map(tuple, left.select(columns).collect()))) == sorted(map(repr, map(tuple, right.select(columns).collect())))


def test_buckets_hold_about_the_same_rows(hot):
    sizes = [r["count"] for r in O.measured_buckets(hot, ["key"], "ts", 500).groupBy("key", "_bucket").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 1000 and len(sizes) >= 36
    order = [(r.low, r.high) for r in O.measured_buckets(hot, ["key"], "ts", 500).where("key = 'hot'").groupBy("_bucket").agg(
        F.min("ts").alias("low"), F.max("ts").alias("high")).orderBy("_bucket").collect()]
    assert all(a[1] < b[0] for a, b in zip(order, order[1:]))


def test_scans_equal_plain_windows(hot, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 700)
    for inclusive in (True, False):
        frame = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        assert same(O.running_totals(hot, ["key"], ["ts", "id"], {"x": F.col("value")}, inclusive=inclusive), hot.withColumn("x", F.coalesce(F.sum("value").over(frame), F.lit(0))))
        assert same(O.running_maxima(hot, ["key"], ["ts", "id"], {"x": F.col("value")}, inclusive=inclusive), hot.withColumn("x", F.max("value").over(frame)))


def test_numbers_dates_and_nulls_as_order(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 20)
    base = spark.range(300).select("id", F.lit("k").alias("key"), F.when(F.col("id") % 9 > 0, F.pmod(F.xxhash64("id"), F.lit(97)) / 7.0).alias("d"))
    base = base.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.floor("d").cast("int"))).withColumn("n", F.floor("d").cast("int"))
    for column in ("d", "day", "n"):
        frame = Window.partitionBy("key").orderBy(column, "id").rowsBetween(Window.unboundedPreceding, 0)
        got = O.running_totals(base, ["key"], [column, "id"], {"x": F.col("id")}, inclusive=True)
        assert same(got, base.withColumn("x", F.sum("id").over(frame)))


@pytest.mark.parametrize("scale", [1.0, -1e9])
def test_quantiles_of_any_range(spark, scale):
    draw = np.random.default_rng(3)
    values = {"a": draw.random(30_001) ** 3 * scale, "b": np.repeat(draw.random(7) * scale, 900), None: draw.random(1) * scale, "two": draw.random(2) * scale}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "key string, v double").repartition(5)
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    nearest = {r.key: r for r in Q.nearest_rank(frame, ["key"], "v", fractions).collect()}
    between = {r.key: r for r in Q.interpolated(frame, ["key"], "v", fractions).collect()}
    assert set(nearest) == set(between) == set(values)
    for key, vs in values.items():
        ordered = np.sort(vs)
        for name, f in fractions.items():
            assert nearest[key][name] == ordered[int(np.floor((len(vs) - 1) * f))]
            assert between[key][name] == pytest.approx(np.quantile(vs, f), rel=1e-9)


def test_few_values_are_counted_one_by_one(spark):
    """Of a large group only values near the wanted ranks are counted, far fewer than there are."""
    frame = spark.range(40_000).select(F.lit("k").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("v"))
    kept = Q._ranked(frame, ["key"], "v", {"p50": 0.5, "p99": 0.99}).count()
    assert 0 < kept < 4_000


# ---- layout ----------------------------------------------------------------
def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_a_window_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "layout")
    start = dt.datetime(2024, 1, 1)
    rows = spark.range(400).select("id", (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 72).cast("int"), secs=F.col("id").cast("decimal(18,6)"))).alias("at"))
    W.write_partitioned(rows, path, "at", hourly=True)
    before = files(path)
    assert len(before) == len({os.path.dirname(f) for f in before}) == 72
    window = W.export_window(dt.datetime(2024, 1, 3, 5), "daily")
    W.write_partitioned(rows.withColumn("id", F.col("id") + 1000), path, "at", hourly=True, window=window)
    after = files(path)
    inside = lambda f: f.startswith("date=2024-01-02/")
    assert {f: t for f, t in after.items() if not inside(f)} == {f: t for f, t in before.items() if not inside(f)}
    assert not {f for f in after if inside(f)} & set(before) and len(after) == 72
    back = spark.read.parquet(path)
    assert back.count() == 400 and back.where("date = '2024-01-02'").agg(F.min("id")).first()[0] >= 1000


def test_shared_folder_without_a_setting(spark, monkeypatch):
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})()
        sparkContext = spark.sparkContext

    folder = session.shared_dir(Unset)
    assert folder == session.shared_dir(Unset) and os.path.isdir(folder)
    monkeypatch.setattr(Unset, "sparkContext", type("S", (), {"master": "spark://host:1", "applicationId": "x"})())
    with pytest.raises(ValueError):
        session.shared_dir(Unset)


# ---- streams ---------------------------------------------------------------
def in_parts(spark, tmp_path, rows, schema):
    """Rows as a stream; the last column is the micro-batch that a row comes in."""
    frame = spark.createDataFrame(rows, schema + ", part int")
    for n in range(rows[-1][-1] + 1):
        frame.where(F.col("part") == n).drop("part").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03d}"))
    return spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def states(stream, tmp_path):
    """Rows of state after each micro-batch, and the output."""
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return kept, stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def test_state_ends_after_silence(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    rows = [(f"k{i}", i, at(i / 10), True, 0) for i in range(20)] + [("k1", 100, at(8), False, 1), ("new", 101, at(3000), True, 2), ("new", 102, at(6000), False, 3)]
    kept, out = states(ST.cooldown(in_parts(spark, tmp_path, rows, "key string, request_id bigint, created_at timestamp, failed boolean"), "key", 600), tmp_path)
    assert max(kept) >= 20 and kept[-1] < 10
    assert {r.request_id for r in out if r.cooling} == {100}


def test_spend_of_a_silent_session_starts_anew(spark, tmp_path):
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    rows = [("s", 1, at(0), 5, 0), ("s", 2, at(1), 7, 1), ("other", 3, at(400), 1, 2), ("s", 4, at(401), 2, 3), ("s", 5, at(402), 2, 4)]
    _, out = states(ST.session_spend(in_parts(spark, tmp_path, rows, "key string, request_id bigint, created_at timestamp, units bigint"), "key", 10, silence_seconds=86_400), tmp_path)
    assert {r.request_id: (r.units_before, r.over_budget) for r in out} == {1: (0, False), 2: (5, False), 3: (0, False), 4: (0, False), 5: (2, False)}


def test_spend_keeps_state_by_bucket(spark, tmp_path):
    """State and calls follow the buckets, not the sessions; the results are those of a sequential pass."""
    draw = random.Random(5)
    at = lambda seconds: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)
    names = [None, *range(10**17, 10**17 + 1500)]
    rows = [(draw.choice(names) if i % 9 else None, i, at(40 * i + draw.randrange(30)), draw.choice([None, -3, 0, 2, 7]), i // 1000) for i in range(4000)]
    rows += [(10**17, 5000, at(0), 5, 0), (10**17, 5000, at(0), 5, 0)]
    rows.sort(key=lambda r: r[-1])
    stream = in_parts(spark, tmp_path, rows, "key bigint, request_id bigint, created_at timestamp, units bigint")
    kept, out = states(ST.session_spend(stream, "key", 10, silence_seconds=30_000), tmp_path)
    totals, newest, expected = {}, {}, []
    for key, request, moment, units, _ in sorted(rows, key=lambda r: (r[-1], r[2], r[1])):
        if key in newest and moment - newest[key] > dt.timedelta(seconds=30_000):
            totals[key] = 0
        expected.append((key, request, totals.get(key, 0), totals.get(key, 0) >= 10))
        totals[key], newest[key] = totals.get(key, 0) + max(0, units or 0), moment
    got = Counter(tuple(r) for r in out)
    assert (Counter(expected) - got, got - Counter(expected)) == (Counter(), Counter())
    assert 0 < max(kept) <= 4 * (ST.BUCKETS + 1)


class FakeState:
    """State of one key and its timers, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_silent_sessions_leave_their_bucket():
    held, clock = FakeState(), type("T", (), {"getCurrentWatermarkInMs": lambda self: self.now, "getExpiryTimeInMs": lambda self: self.now})()
    spend = ST.Spend("key", "string", 60_000_000, 10)
    spend.init(held)
    feed = lambda *rows: [tuple(r) for f in spend.handleInputRows((3,), iter([pd.DataFrame(
        [(k, i, pd.Timestamp(s, unit="s"), u) for k, i, s, u in rows], columns=["key", "request_id", "created_at", "units"])]), clock) for r in f.itertuples(index=False)]
    assert feed(("a", 1, 0, 4), ("b", 2, 10, 5), ("a", 3, 20, 7)) == [("a", 1, 0, False), ("a", 3, 4, False), ("b", 2, 0, False)]
    assert held.timers == {70_001}
    assert feed(("b", 4, 30, 1), ("c", 5, 5, 1)) == [("b", 4, 5, False), ("c", 5, 0, False)]
    assert held.timers == {65_001}
    held.timers.clear()
    clock.now = 66_000
    assert list(spend.handleExpiredTimer((3,), clock, clock)) == []
    assert held.value[0] == ["a", "b"] and held.timers == {80_001}
    assert feed(("a", 6, 70, 1), ("a", 7, 140, 1)) == [("a", 6, 11, True), ("a", 7, 0, False)]
    held.timers.clear()
    clock.now = 90_001
    assert list(spend.handleExpiredTimer((3,), clock, clock)) == [] and held.value[0] == ["a"]
    held.timers.clear()
    clock.now = 300_000
    assert list(spend.handleExpiredTimer((3,), clock, clock)) == [] and held.value is None and not held.timers


def test_findings_of_chunks(spark, tmp_path):
    text = "words " * 60 + "card 4111 1111 1111 1111 and mail someone@example.com " + "tail " * 80
    pieces = [text[i:i + 37] for i in range(0, len(text), 37)]
    rows = [(1, i, p, i == len(pieces) - 1, i // 5) for i, p in enumerate(pieces)]
    kept, out = states(ST.chunk_redaction(in_parts(spark, tmp_path, rows, "stream_id bigint, chunk_no bigint, chunk string, is_last boolean"), "stream_id", dt.date(2024, 6, 1)), tmp_path)
    assert kept[-1] == 0 and max(kept) > 0
    assert max(r.events for r in out) == 2 and sum(len(r.types.split(",")) for r in out if r.types) == 2
    borders = range(37, len(text), 37)
    crossing = sum(any(a < b < a + n for b in borders) for a, n in ((text.index("4111"), 19), (text.index("someone"), 19)))
    assert sum(r.crossing for r in out) == crossing > 0


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    # A micro-batch is judged by the rows up to two batches earlier.
    rows = [(1, at(0), 0), (2, at(100), 0), (6, at(101), 1), (3, at(95), 2), (4, at(10), 2), (5, at(89), 2), (2, at(100), 2)]
    stream = in_parts(spark, tmp_path, rows, "request_id bigint, created_at timestamp")
    table, late = RN.run_append_dropping(J.unique_requests(stream, delay="10 minutes"), "t-late")
    assert sorted(r.request_id for r in table.collect()) == [1, 2, 3, 6] and late == 2


def test_replay_is_in_order_and_whole(spark):
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(5000))).alias("at"))
    folder = RN.run_batches(RN.replayed(rows, "at", "t-replay"), "t-replayed", lambda batch, number, home: batch.withColumn("n", F.lit(number)).write.parquet(f"{home}/{number}"))
    got = spark.read.option("recursiveFileLookup", True).parquet(folder).groupBy("n").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("rows")).orderBy("n").collect()
    assert len(got) == 4 and sum(r["rows"] for r in got) == 1000 and all(a.high < b.low for a, b in zip(got, got[1:]))


def test_every_token_format_has_its_needles_and_algolia_ends_at_a_border(spark):
    from ledgerlight.functions.rule_catalog import TOKEN_NEEDLES, TOKEN_SECRETS
    from ledgerlight.operators import dlp

    assert {name for name, _, _ in TOKEN_SECRETS} == set(TOKEN_NEEDLES)
    key = "LTAI" + "a1b2c3d4e5" * 2
    docs = spark.createDataFrame([(1, f"id {key};"), (2, f"id {key}x"), (3, f"x{key}"), (4, f"id {key.lower()}"), (5, "")], "doc_id bigint, text string")
    found = {(r.doc_id, r.detector) for r in dlp.secret_catalog(docs, "doc_id", "text").collect()}
    assert {d for d, name in found if name == "algolia_api_key"} == {1, 4}
