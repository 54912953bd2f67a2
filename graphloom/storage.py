"""Lineage cuts: tables in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only in local mode, where one machine runs all, a temporary
folder is used if that is unset; elsewhere it is an error, as each node would write to its own disk. The tables live as
long as the driver process, or until another one takes their place.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-shared-")
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table: a reliable end of the lineage.

    The table that ``instead_of`` was read from, itself made here, is deleted then: nothing else may read it any more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if (old := getattr(instead_of, "_scratch", None)) is not None:
        drop(spark, old)
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files come in fewer than half as many partitions as there are; else unchanged.

    For work that is heavy by the row. Filters and column choices still reach the scan through it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that have ended: they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            drop(spark, path)
        except Exception:  # the JVM may be gone already
            return
