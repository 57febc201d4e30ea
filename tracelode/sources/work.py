"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset a local master gets one of its own, others an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tracelode-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(frame: DataFrame, path: str | None = None) -> DataFrame:
    """The frame written once and reread, so that plans that use it several times don't compute it again.

    The shuffle files behind it are of no use then and go. ``path`` is a folder from ``folder``, whose rows so far are reread too.
    """
    spark, path = frame.sparkSession, path or folder(frame.sparkSession)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        frame.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that ``kept`` wrote to ``paths``, once nothing reads them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
