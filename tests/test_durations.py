import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import durations as D


def ts(text):
    return dt.datetime.fromisoformat(text)


CASES = [  # duration, now (UTC), zone, expected (UTC)
    ("1d", "2023-05-15 10:00:00", "UTC", "2023-05-16 00:00:00"),
    ("7d", "2023-05-15 10:00:00", "UTC", "2023-05-22 00:00:00"),
    ("7d", "2023-05-17 10:00:00", "UTC", "2023-05-22 00:00:00"),
    ("30d", "2023-12-15 10:00:00", "UTC", "2024-01-01 00:00:00"),
    ("3d", "2023-05-15 10:00:00", "UTC", "2023-05-18 00:00:00"),
    ("2h", "2023-05-15 10:30:00", "UTC", "2023-05-15 12:00:00"),
    ("5h", "2023-05-15 23:30:00", "UTC", "2023-05-16 01:00:00"),
    ("15m", "2023-05-15 10:22:33", "UTC", "2023-05-15 10:30:00"),
    ("30m", "2023-05-15 23:45:00", "UTC", "2023-05-16 00:00:00"),
    ("30s", "2023-05-15 23:59:45", "UTC", "2023-05-16 00:00:00"),
    ("0h", "2023-05-15 10:22:33", "UTC", "2023-05-15 10:22:33"),
    ("1mo", "2023-12-31 10:00:00", "UTC", "2024-01-01 00:00:00"),
    ("nonsense", "2023-05-15 10:00:00", "UTC", "2023-05-16 00:00:00"),
    ("1d", "2023-05-15 10:00:00", "US/Eastern", "2023-05-16 04:00:00"),
    ("1d", "2023-05-15 02:00:00", "US/Eastern", "2023-05-15 04:00:00"),
    ("1d", "2023-03-11 20:00:00", "US/Eastern", "2023-03-12 05:00:00"),
    ("7d", "2023-03-11 20:00:00", "US/Eastern", "2023-03-13 04:00:00"),
    ("1d", "2023-05-15 10:00:00", "Asia/Kolkata", "2023-05-15 18:30:00"),
]


def test_next_reset(spark):
    frame = spark.createDataFrame([(i, d, ts(n), z) for i, (d, n, z, _) in enumerate(CASES)],
                                  "i int, d string, n timestamp_ntz, z string")
    got = frame.select("i", D.next_reset_utc("d", F.col("n"), "z").alias("r")).orderBy("i").collect()
    assert [str(r.r) for r in got] == [c[3] for c in CASES]


@pytest.mark.parametrize("duration,expected", [
    ("30s", 30), ("15m", 900), ("2h", 7200), ("1d", 86400), ("1w", 604800), ("1mo", 29 * 86400), ("x", None), ("5y", None)])
def test_seconds(spark, duration, expected):
    as_of = F.lit("2024-01-31 05:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(D.duration_seconds(F.lit(duration), as_of).alias("s")).first().s == expected
