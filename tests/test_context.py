import datetime as dt

from ledgerlight.operators import context as CX


def probing(spark, messages):
    start = dt.datetime(2024, 1, 1)
    rows = [(conv, n, "user", "jailbreak" if warned else "hello", start + dt.timedelta(seconds=at)) for conv, n, warned, at in messages]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, ts timestamp_ntz")
    return {(r.conv_id, r.turn): (r.probes, r.probing) for r in CX.repeated_probing(CX.numbered(CX.flagged(frame))).collect()}


def test_silence_forgets_warnings(spark):
    # Conversation 1 pauses for just over 30 minutes, 2 for exactly 30; 3 pauses twice.
    got = probing(spark, [(1, 0, True, 0), (1, 1, True, 60), (1, 2, True, 60 + 1801), (1, 3, True, 60 + 1802),
                          (2, 0, True, 0), (2, 1, True, 60), (2, 2, True, 60 + 1800),
                          (3, 0, True, 0), (3, 1, False, 4000), (3, 2, True, 8000), (3, 3, True, 8001), (3, 4, True, 8002)])
    assert [got[1, n] for n in range(4)] == [(1, None), (2, "medium"), (1, None), (2, "medium")]
    assert [got[2, n] for n in range(3)] == [(1, None), (2, "medium"), (3, "high")]
    assert [got[3, n] for n in range(5)] == [(1, None), (0, None), (1, None), (2, "medium"), (3, "high")]


def test_only_ten_messages_count(spark):
    got = probing(spark, [(1, n, n in (0, 5, 20), n * 1700) for n in range(22)])
    assert [got[1, n][0] for n in (5, 9, 10, 14, 15, 20)] == [2, 2, 1, 1, 0, 1]
