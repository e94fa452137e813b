"""The engine's operators over streams: files that arrive, and events by windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of files as they arrive in a folder; every reader of ``sources.files`` takes this stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path).select("path", "content")


def arriving_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", time: str = "ts", *keys: str) -> DataFrame:
    """Counts and sums of ``value`` by window and keys; rows later than the watermark are dropped, as its semantics are."""
    grouped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
