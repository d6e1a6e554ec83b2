import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import readers as RD
from ledgerlight.sources import writers as W
from ledgerlight.operators import usage_reports as U


def test_records_with_raw_newlines_across_splits(spark, tmp_path):
    records = [{"id": i, "text": 'line\n"quoted" \\ and\n\nmore }\n{ ' + "x" * (i % 50)} for i in range(400)]
    for part in range(2):
        with open(tmp_path / f"f{part}.jsonl", "w") as out:
            for r in records[part::2]:
                out.write(json.dumps(r).replace("\\n", "\n") + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = RD.read_json_records(spark, str(tmp_path), "id bigint, text string").select("id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.id, r.text) for r in rows) == [(r["id"], r["text"]) for r in records]


def test_a_bad_tail_fails_the_job(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": 2, "text": "never closed\n')
    with pytest.raises(Exception, match="cannot be parsed"):
        RD.read_json_records(spark, str(tmp_path), "id bigint, text string").collect()


def test_model_rewrite_keeps_the_rest(spark):
    line = '{"custom_id":"a","body":{"messages":[{"role":"user","content":"the \\"model\\": \\"x\\""}],"model":"old"},"n":1}'
    got = RD.rewrite_model(spark.createDataFrame([(line,)], "line string"), "line", "new").first().line
    assert json.loads(got) == {**json.loads(line), "body": {**json.loads(line)["body"], "model": "new"}}


def test_dimension_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,day,tags,note\n1,2024-01-02,"{a,""b c""}",x\nbad,never,{},NULL\n3,,NULL,\n')
    rows = RD.read_dimension_csv(spark, str(tmp_path), [("id", "int"), ("day", "date"), ("tags", "array<string>"), ("note", "string")]).collect()
    assert [tuple(r) for r in rows] == [(1, dt.date(2024, 1, 2), ["a", "b c"], "x"), (None, None, [], None), (3, None, None, None)]


def test_export_windows_are_aligned_and_named():
    now = dt.datetime(2024, 3, 1, 0, 20)
    assert W.export_window(now, "hourly").name == "usage-20240229T230000Z-20240301T000000Z"
    assert W.export_window(now, "daily").start == dt.datetime(2024, 2, 29)
    assert W.export_window(now, "interval", 900).end == dt.datetime(2024, 3, 1, 0, 15)
    with pytest.raises(ValueError):
        W.export_window(now, "weekly")


def test_closed_windows_repeat_boundary_rows(spark):
    window = W.export_window(dt.datetime(2024, 1, 2, 5), "daily")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 2),)], "t timestamp_ntz")
    assert rows.where(W.in_window("t", window)).count() == 1
    assert rows.where(W.in_window("t", window, closed=True)).count() == 2


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 3)), (2, dt.datetime(2024, 1, 2, 4))], "id int, t timestamp_ntz")
    W.write_partitioned(rows, path, "t", hourly=True)
    W.write_partitioned(rows.where("id = 2").withColumn("id", F.lit(9)), path, "t", hourly=True)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 9]


def test_csv_has_doubles_and_headers_in_every_file(spark, tmp_path):
    path = str(tmp_path / "csv")
    W.write_frame_csv(spark.range(25).select(F.col("id").cast("decimal(18,6)").alias("cost")), path, rows_per_file=3)
    files = list((tmp_path / "csv").glob("*.csv"))
    assert len(files) >= 8 and all(f.read_text().startswith("cost\n") for f in files)
    assert spark.read.option("header", True).csv(path).where("cost = '3.0'").count() == 1


@pytest.mark.parametrize("setting,days", [("30d", 30), (7, 7), ("12h", 0.5), ("x", None), (None, None), ("d", None)])
def test_retention_setting(setting, days):
    assert U.retention_days(setting) == days


def test_envelopes(spark):
    lines = spark.createDataFrame([(1, '{"version":1,"requestId":"a","createdAt":"2024-01-01T00:00:00Z","security":{"risk":"low"}}'),
                                   (2, '{"version":1,"requestId":'), (3, '{"version":2,"requestId":"b"}'), (4, '{"version":1}')],
                                  "source_id bigint, value string")
    parsed = RD.parse_envelopes(lines)
    assert {(r.source_id, r.error_kind) for r in RD.dead_letters(parsed, "source_id").collect()} == {
        (2, "malformed"), (3, "unsupported_version"), (4, "incomplete")}
    conversations, events = RD.telemetry_flatten(parsed)
    assert conversations.first().request_id == "a" and events.first().rule_id is None
