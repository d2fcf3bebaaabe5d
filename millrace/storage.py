"""The shared work folder: narrow intermediate tables are written there once instead of being computed again by each reader."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark itself reads it: without one it lies in the default file system, not on a worker's disk."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/(?!/)", "file:///", full)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one, in local mode alone."""
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return qualified(spark, found)
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a work folder that nothing will read again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Remove all work folders of this application, once the results that read them are stored elsewhere."""
    drop_dir(spark, run_dir(spark))


def cut(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, so a lost executor loses nothing.

    `spent` are earlier cuts that nothing but df reads: once df is written their files go.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    for s in spent:
        drop_dir(spark, s._cut_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out
