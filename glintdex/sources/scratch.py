"""The folder that driver and executors share, and tables written there to settle what a plan gives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir in full, on the default file system if it names none; a temporary folder only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="glintdex-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder there, deleted when the driver's JVM ends."""
    name = f"{shared_folder(spark)}/glintdex-index-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df``, worked out once: written there and read again."""
    path = f"{scratch_folder(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
