"""The folder that driver and executors share, as ``spark.checkpoint.dir`` names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "file:///tmp/folioflux-shared"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one where none is set, as in tests."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = _LOCAL_DEFAULT
    return set_dir.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
