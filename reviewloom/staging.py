"""Written stage tables: how plans are cut and how intermediate results survive lost executors.

A staged table is parquet in the folder the cluster shares
(``spark.checkpoint.dir``). Only a ``local[..]`` master, where driver and
executors are one machine, may fall back to a temporary folder. Stage folders
are deleted when the driver ends, or earlier by ``unstage``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "reviewloom.staging.fallback"
#: A plan is spread if its estimated bytes would make fewer splits of this size than there are cores.
SPLIT_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get(_FALLBACK, None)
    if not own:
        own = tempfile.mkdtemp(prefix="reviewloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set(_FALLBACK, own)
    return "file://" + own


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/reviewloom/{uuid.uuid4().hex}"
    fs, p = filesystem(spark, folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{folder}/{name}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps don't recompute it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_path = path
    return found


def unstage(*staged: DataFrame) -> None:
    """Deletes the folders of staged tables that nothing lazily evaluated reads any more; other frames are left alone."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path:
            fs, p = filesystem(df.sparkSession, path)
            fs.delete(p.getParent(), True)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Spreads a small input over all cores before costly per-row work.

    Judged by the optimiser's estimate of the plan's size, so nothing is executed for it. Larger inputs have enough splits
    and are left alone: at scale this adds no shuffle.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= want * SPLIT_BYTES else df.repartition(want)
