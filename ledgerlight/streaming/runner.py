"""Starting streams, and sinks whose final state can be read as a table.

Checkpoints and tables live in the shared folder of the cluster.  Every sink
is idempotent: a micro-batch that is repeated after a failure writes the same
place again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.session import fresh_path
from ledgerlight.sources.adapters import telemetry_view

# Our own choice; the reference behaviour knows no event time.
WATERMARK = "10 minutes"


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table folder as a file stream, one file per micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 1)
            .parquet(sf_dir))


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security telemetry as a stream; event time needs a zoned timestamp."""
    rows = telemetry_view(table_stream(spark, sf_dir, "events"))
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Envelope lines from a topic, for production (needs the connector on the class path)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("maxOffsetsPerTrigger", per_trigger).load().select(F.col("value").cast("string").alias("value")))


def replayed(rows: DataFrame, ts: str, label: str, slices: int = 4, slice_rows: int = 1_000_000) -> DataFrame:
    """The rows of a table as a stream in several micro-batches, in time order: slices of bounded size, written one after another.

    The table is dealt to its slices in one pass; the files of the stream are then copied from one slice each, so that their
    times of change follow the time order.
    """
    spark = rows.sparkSession
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    count = rows.count()
    slices = max(slices, -(-count // slice_rows))
    edges = rows.agg(F.percentile_approx(micros, [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    home, edges = fresh_path(spark, label), sorted(set(edges))
    number = F.lit(0)
    for edge in edges:
        number = number + (micros >= edge).cast("int")
    # Rows without a time are in no slice.
    dealt = fresh_path(spark, f"{label}-dealt")
    rows.where(micros.isNotNull() | F.lit(not edges)).withColumn("_slice", F.coalesce(number, F.lit(0))).write.partitionBy("_slice").parquet(dealt)
    for i in range(len(edges) + 1):
        part = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(dealt).where(F.col("_slice") == i).drop("_slice")
        part.coalesce(1).write.parquet(f"{home}/{i:06d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(home)


def _finish(writer, trigger: dict) -> int:
    """Run to the end of the input; rows that stateful operators dropped because they came behind the watermark."""
    query = writer.trigger(**trigger).start()
    try:
        query.awaitTermination()
        return sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in (p["stateOperators"] or []))
    finally:
        query.stop()


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Run to the end of the available input into an append-only table and read it."""
    spark = stream.sparkSession
    home = fresh_path(spark, label)
    _finish(stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/table")
            .option("checkpointLocation", f"{home}/checkpoint"), {"availableNow": True})
    return spark.read.schema(stream.schema).parquet(f"{home}/table")


def run_append_dropping(stream: DataFrame, label: str) -> tuple[DataFrame, int]:
    """run_append, and how many rows came too late.

    Rows are told apart where the first stateful operator takes single rows (removal of repeats, custom state); a windowed
    sum counts its partial sums instead.
    """
    spark = stream.sparkSession
    home, kept = fresh_path(spark, label), "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "1000000")
    try:
        dropped = _finish(stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/table")
                          .option("checkpointLocation", f"{home}/checkpoint"), {"availableNow": True})
    finally:
        spark.conf.set(kept, before)
    return spark.read.schema(stream.schema).parquet(f"{home}/table"), dropped


def run_batches(stream: DataFrame, label: str, write: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run with a function per micro-batch, write(batch, batch_id, folder); returns the folder."""
    home = fresh_path(stream.sparkSession, label)
    _finish(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint")
            .foreachBatch(lambda batch, number: write(batch, number, f"{home}/table")), {"availableNow": True})
    return f"{home}/table"


def _write_batch(batch: DataFrame, number: int, folder: str) -> None:
    batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run_update(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run an update-mode stream and read the newest version of every key."""
    spark = stream.sparkSession
    folder = run_batches(stream, label, _write_batch, mode="update")
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("_batch")).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
