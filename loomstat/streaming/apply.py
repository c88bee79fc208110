"""Fitted transforms on streams: they are stateless joins with small parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_long(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder as a stream of long rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_transformed(stream: DataFrame, fitted, path: str, checkpoint: str):
    """Append the transformed rows of all files that are there, then stop; a restart goes on where it ended."""
    out = fitted.transform(stream)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
