"""Session helpers: intermediate results go where the cluster says."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _hadoop(spark: SparkSession, path: str):
    """File system and path object of a folder, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder in the warehouse if that is unset.

    The driver and all executors share both.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; gone when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        path = f"{shared_dir(spark)}/leadframe-work-{app}-{uuid.uuid4().hex[:8]}"
        files, where = _hadoop(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _folders[app] = path
    return _folders[app]


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables; results that still read them must be written before."""
    path = _folders.pop(spark.sparkContext.applicationId, None)
    if path:
        files, where = _hadoop(spark, path)
        files.delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and go on from the written table.

    Survives the loss of executors, computes the rows a single time, and gives
    the planner real sizes for its join decisions.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._leadframe_path = path
    return written


def discard(written: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that nothing will read any more."""
    files, where = _hadoop(written.sparkSession, written._leadframe_path)
    files.delete(where, True)
