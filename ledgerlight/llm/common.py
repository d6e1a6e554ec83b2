"""Helpers that several operators share: reading, session settings, intermediate tables, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import tune, written

BLANK_WORDS = "[^\\x20\\x09-\\x0D]+"

# Bytes of text that travel to a Python worker at a time.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the operators: bounded Arrow batches, so a worker never holds more than a few of them."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Else the splits of a scan would depend on how many executors are up.
    spark.conf.set("spark.sql.files.minPartitionNum", "32")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z in lower case, everything else unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo *modulus*; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame, label: str) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph: (node, component).

    Alternates large-star and small-star steps: each reconnects a node's neighbours to the smallest of them,
    so the number of edges never grows and the number of rounds is logarithmic.  A hub's edges are first
    reduced to one minimum by partial aggregation and then joined, where a skewed partition can be split.
    Every round is a written table.  *edges*: two BIGINT columns without null; loops are ignored.
    """
    current = written(edges.toDF("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while True:
        both = current.union(current.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).where("u != v").distinct())
        current = written(small, label)
        after = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if after == before:
            return current.toDF("node", "component")
        before = after
