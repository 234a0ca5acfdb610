"""Tables between the steps of one operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only in local mode, where it is the only machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, and safe from the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table of kept_table() that no later plan reads."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["_kept_at"])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
