"""Writers for audit logs, billing exports, object layouts and messages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.sources.adapters import ntz


def sorted_json(columns: list[str]) -> Column:
    """Row as JSON with its keys in alphabetical order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def append_audit(events: DataFrame, path: str) -> None:
    """Append decision events as JSON lines with sorted keys."""
    events.select(sorted_json(events.columns).alias("value")).write.mode("append").text(path)


def write_frame_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def decimals_as_double(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                          for f in frame.schema.fields])


def write_frame_csv(frame: DataFrame, path: str, rows_per_file: int | None = None, compression: str = "none") -> None:
    """CSV with a header in every file; decimals are written as doubles.  *rows_per_file* splits the export, *compression*
    names a codec for its files (gzip, ...)."""
    writer = decimals_as_double(frame).write.mode("overwrite").option("header", True).option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


@dataclass(frozen=True)
class ExportWindow:
    """Half-open time window of one export run."""

    start: dt.datetime
    end: dt.datetime
    frequency: str

    @property
    def name(self) -> str:
        """Run name from the window bounds, so that re-runs write the same place and others never collide."""
        return f"usage-{self.start:%Y%m%dT%H%M%SZ}-{self.end:%Y%m%dT%H%M%SZ}"


def export_window(now: dt.datetime, frequency: str, interval_seconds: int | None = None) -> ExportWindow:
    """Last complete hour, day or interval before *now*, aligned to its boundary."""
    if frequency == "hourly":
        end = now.replace(minute=0, second=0, microsecond=0)
        return ExportWindow(end - dt.timedelta(hours=1), end, frequency)
    if frequency == "daily":
        end = now.replace(hour=0, minute=0, second=0, microsecond=0)
        return ExportWindow(end - dt.timedelta(days=1), end, frequency)
    if frequency == "interval" and interval_seconds:
        epoch = dt.datetime(1970, 1, 1)
        steps = int((now - epoch).total_seconds()) // interval_seconds
        end = epoch + dt.timedelta(seconds=steps * interval_seconds)
        return ExportWindow(end - dt.timedelta(seconds=interval_seconds), end, frequency)
    raise ValueError(f"unsupported frequency: {frequency}")


def in_window(ts: str, window: ExportWindow, closed: bool = False) -> Column:
    """Rows of a window; *closed* also delivers rows exactly at its end (and the next window delivers them again)."""
    upper = F.col(ts) <= ntz(window.end) if closed else F.col(ts) < ntz(window.end)
    return (F.col(ts) >= ntz(window.start)) & upper


# Rows of a file, and files that a task writes.
ROWS_PER_FILE, FILES_PER_TASK = 1_000_000, 64


def write_partitioned(frame: DataFrame, path: str, ts: str, hourly: bool, window: ExportWindow | None = None, form: str = "parquet",
                      columns: Sequence[Column] | None = None) -> None:
    """Layout date=YYYY-MM-DD[/hour=HH].  With a *window* the run writes the rows of that window only.  A run into a path that
    exists replaces the partitions of its rows, all others keep their files.

    Partitions are counted first.  A quiet hour is one file, a day with a third of all rows is cut into files of about
    ROWS_PER_FILE rows and written by many tasks; a task gets a bounded number of files and rows, so many small partitions
    are spread over all cores although they are few bytes.  *columns* are what is written, made of the frame's columns (all
    of them by default) behind the shuffle.
    """
    if window is not None:
        frame = frame.where(in_window(ts, window))
    keys = ["date", "hour"] if hourly else ["date"]
    rows = frame.withColumn("date", F.date_format(ts, "yyyy-MM-dd"))
    if hourly:
        rows = rows.withColumn("hour", F.date_format(ts, "HH"))
    parts = F.ceil(F.col("_n") / F.lit(ROWS_PER_FILE)).cast("int")
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", parts)
    total = counted.agg(F.sum("_parts").alias("files"), F.sum("_n").alias("rows")).first()
    tasks = max(1, -(-(total.files or 0) // FILES_PER_TASK), -(-(total.rows or 0) // ROWS_PER_FILE))
    large = counted.where("_parts > 1").select(*keys, "_parts")
    salt = F.pmod(F.xxhash64(*frame.columns), F.coalesce("_parts", F.lit(1))).alias("_salt")
    rows = rows.join(large, keys, "left").select(*frame.columns, *keys, salt).repartition(tasks, *keys, "_salt").drop("_salt")
    writer = rows.select(*(columns or frame.columns), *keys).write.partitionBy(*keys).format(form)
    if window is None:
        try:
            # Tasks move their own files into place; the path is new, so a failed run leaves nothing that a reader knows of.
            writer.mode("errorifexists").option("mapreduce.fileoutputcommitter.algorithm.version", "2").save(path)
            return
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
        writer = rows.select(*(columns or frame.columns), *keys).write.partitionBy(*keys).format(form)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def message_rows(frame: DataFrame, key: str) -> DataFrame:
    """Key and JSON value for a message topic (works for batch and streaming writers)."""
    return frame.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*frame.columns)).alias("value"))


def publish_messages(frame: DataFrame, key: str, servers: str, topic: str, checkpoint: str | None = None):
    """Send rows to a topic; a streaming frame needs a checkpoint and returns its query (the connector must be installed)."""
    rows = message_rows(frame, key)
    if frame.isStreaming:
        return (rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
                .option("checkpointLocation", checkpoint).start())
    return rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def dataset_export(conversations: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    """Training export, sanitised by default: assistant = approved and successful, security = approved labels
    with risk and rule ids."""
    rows = conversations.join(labels.where("approved"), "request_id")
    if kind == "assistant":
        return rows.where("status = 'success'").select("request_id", F.col("sanitized_text").alias("messages"), "created_at")
    if kind == "security":
        return rows.select("request_id", F.col("sanitized_text").alias("messages"), "label", "risk", "rule_ids", "created_at")
    raise ValueError("kind must be assistant or security")
