"""File streams of measurements: typed reading, late-data windows, running class counts, duplicate deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Watermarks want a timestamp with zone; one without is read in the session's zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def deliver_once(df: DataFrame, key: str, time: str, lateness: str = "4 weeks") -> DataFrame:
    """Drops rows delivered again under their key; state is kept for ``lateness``. The time comes out as a timestamp with zone."""
    return _timed(df, time).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_labels(df: DataFrame, time: str, key: str, label: str, width: str = "1 day", lateness: str = "4 weeks") -> DataFrame:
    """(start, key, n_rows, n_pos) in windows of event time; rows later than ``lateness`` are left out."""
    w = _timed(df, time).withWatermark(time, lateness).groupBy(F.window(time, width), F.col(key).alias("key"))
    return w.agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_pos")).select(F.col("window.start").alias("start"), "key", "n_rows", "n_pos")


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Appends to parquet with exactly-once bookkeeping, for all that is there now; returns the query."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
