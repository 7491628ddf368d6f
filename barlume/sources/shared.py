"""The folder that driver and executors share, as the session names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset; it goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_barlume"
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    system = at.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    return at.toString()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read back: for plans that read it several times."""
    at = f"{fresh_folder(df.sparkSession, label)}/rows"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
