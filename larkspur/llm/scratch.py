"""Shared scratch space: tables that cut lineage and survive a lost executor.

Everything goes below ``spark.checkpoint.dir``, which the driver and all executors
share. Only where that setting is absent (tests, a laptop) is a temporary folder used.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """URI of the shared scratch folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="larkspur-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _LOCAL.append(f"file://{folder.name}")
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, no lineage."""
    path = new_path(df.sparkSession, name)
    release(df.sparkSession)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files behind tables that are written by now. It does
    so for what the driver's garbage collectors find unreachable."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
