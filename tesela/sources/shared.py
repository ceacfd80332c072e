"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tesela-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def written(df: DataFrame, partition: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of its own, which is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tesela-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.parquet(path)
