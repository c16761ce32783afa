"""Layers as streams: tiles that arrive in a folder, filtered as they come, and counts of events by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_layer(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Polygon tiles (Parquet with a geom column) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def filter_stream(layer: DataFrame, unary: Callable[[Column], Column]) -> DataFrame:
    """Stateless filter, so every tile is handled once and nothing is kept."""
    return layer.where(unary(F.col("geom")))


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by tumbling window and key; later rows than the watermark are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
