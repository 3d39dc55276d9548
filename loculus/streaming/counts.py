"""Transcripts as a stream: counts by cell and gene, which are the part of the filters that can be kept up to date.

Ranks, medians and distance joins need all points of a cell and stay batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "cell string, gene string, x double, y double, seen timestamp"


def transcript_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_counts(stream: DataFrame) -> DataFrame:
    """(cell, gene, n), updated with each batch; the state is one row for each pair."""
    return stream.groupBy("cell", "gene").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by tumbling window of the time column; state older than the watermark is dropped."""
    return stream.withWatermark("seen", late).groupBy(F.window("seen", size).alias("w"), "cell", "gene").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cell", "gene", "n")


def write_counts(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to a folder; restarts from its checkpoint."""
    return counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
