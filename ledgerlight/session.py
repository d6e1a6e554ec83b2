"""Session settings shared by every job."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings.  AQE splits skewed join partitions and coalesces small
# ones; the forced variant also splits when an extra shuffle is needed, which
# is the right trade when one key may hold a large share of the rows.  No job
# carries a broadcast hint: Spark compares the measured size of a side with
# spark.sql.autoBroadcastJoinThreshold and falls back to a sort-merge join.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bytes of rows that travel to a Python worker at a time, however long the texts are.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def build_session(app: str = "ledgerlight", master: str | None = None, partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """Create (or reuse) a session; master and partitions are for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created, and make the package known to its workers."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (an installed package needs no sending)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/ledgerlight", "zip", home.parent, home.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute a table of texts over all cores when its files give too few tasks.

    Scanning texts costs CPU, not I/O, so a small file with one row group would
    leave a cluster idle.  A large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, *keys) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster for checkpoints and intermediate tables.

    The cluster names it in spark.checkpoint.dir.  Only where that is unset in a
    local run do we choose a folder ourselves; a cluster without one is an error,
    because executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting cannot be changed while Spark runs, so the folder is remembered here.
        if context.applicationId not in _FOLDERS:
            _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="ledgerlight-")
        folder = _FOLDERS[context.applicationId]
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    Cuts the lineage of iterative jobs in a way that survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
