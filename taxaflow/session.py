"""Session settings and durable lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "taxaflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew splitting and UTC timestamps.

    Attaching a per-group table to raw rows (list lengths, removed taxa,
    medians) is left to adaptive execution: it broadcasts the small side only
    after measuring it, and splits the shuffle partitions of hot keys otherwise.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as a table and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    A table has true sizes, which tells Spark what is small enough to broadcast,
    and carries none of the plan's accumulated constraints into the next round.
    ``discard`` deletes it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of this write when it is over
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.durable_folder = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of ``durable`` tables that are no longer read."""
    for table in tables:
        folder = getattr(table, "durable_folder", None)
        if folder:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A name for a new folder where all executors can write.

    It lies in the folder that the session names in ``spark.checkpoint.dir``; a
    session without that setting, as in tests, gets one of its own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="taxaflow-checkpoint-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).resolve().parent
    base = str(Path(tempfile.mkdtemp(prefix="taxaflow-zip-")) / root.name)
    context.addPyFile(shutil.make_archive(base, "zip", root.parent, root.name))
    _shipped.add(context)


_shipped: set = set()
