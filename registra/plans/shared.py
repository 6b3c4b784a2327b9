"""Data that a plan writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all runs in this one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        if not _own_dir:
            _own_dir.append(Path(tempfile.mkdtemp(prefix="registra-")).as_uri())
        found = _own_dir[0]
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed by release() or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/registra/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    if path in _made:
        _made.remove(path)


def held() -> list[str]:
    """The scratch paths that are there now."""
    return list(_made)


def release(spark: SparkSession, before: list[str] | tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> None:
    """Remove the scratch paths made since held() gave `before`, but for those to keep. To be called when all that
    was to be read from results is read or written elsewhere."""
    for path in held():
        if path not in before and path not in keep:
            remove(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. The path is kept in .scratch_path."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out
