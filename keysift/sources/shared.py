"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; with a local master one of this machine where none is set, as in tests."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} is not set: a folder is needed that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keysift-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: what follows needs neither its lineage nor any executor."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
