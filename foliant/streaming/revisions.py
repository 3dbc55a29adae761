"""The revision log as a stream: batches are appended, the last revision of a field is at hand at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import workbench

SCHEMA = "doc_id long, field_id string, batch_id long, ord long, old_value string, new_value string, review_status string, saved_at timestamp"


def read(spark: SparkSession, path: str) -> DataFrame:
    """New revision files below a folder, as they come."""
    return workbench.sanitize(spark.readStream.schema(SCHEMA).json(path))


def append(stream: DataFrame, path: str, checkpoint: str):
    """Writes the stream to an append-only table; a restarted query goes on where it was."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def latest_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The last revision of each field among those that are not later than the watermark; its state is one row a field."""
    rest = F.struct("batch_id", "ord", "old_value", "new_value", "review_status", "saved_at")
    return stream.withWatermark("saved_at", delay).groupBy("doc_id", "field_id").agg(F.max_by(rest, F.struct("batch_id", "ord")).alias("r")).select("doc_id", "field_id", "r.*")


def counts_by_hour(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Revisions an hour and status, closed when the watermark passes."""
    return stream.withWatermark("saved_at", delay).groupBy(F.window("saved_at", "1 hour"), "review_status").agg(F.count("*").alias("revisions"))
