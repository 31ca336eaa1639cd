"""The Spark session that the library expects, and the folder that its executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "shoploom", **conf: str) -> SparkSession:
    """UTC, with adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a folder of our own in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="shoploom-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def tables_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_folder(spark)}/shoploom-{spark.sparkContext.applicationId}"


def new_table(spark: SparkSession) -> str:
    """The path of an intermediate table that is not there yet."""
    return f"{tables_folder(spark)}/{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> bool:
    """Deletes this application's intermediate tables; DataFrames that read them can't be used after it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
