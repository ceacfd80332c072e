"""NDJSON loading in micro-batches by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_ndjson(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    """New files of a folder as a stream of rows; a bad line stops it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("mode", "FAILFAST").json(folder)


def append_to(stream: DataFrame, target: str, checkpoint: str):
    """Appends each micro-batch to Parquet once; ends when what is there has been loaded."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
