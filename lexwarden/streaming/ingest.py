"""The canonical transform on a stream of raw records, with first-come deduplication and windowed counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwarden.functions.text import LANGUAGES
from lexwarden.operators.canonical import canonical_views


def raw_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Raw records from Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def canonical_stream(raw: DataFrame, delay: str = "3 days", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """Canonical rows as they come; of rows of one key within the watermark, the first to arrive stays."""
    timed = raw.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", delay)
    views = canonical_views(timed, languages, keep=("loaded_at",))
    return views.dropDuplicatesWithinWatermark(["source_split", "source_id", "view", "language"])


def windowed_counts(views: DataFrame, width: str = "1 day") -> DataFrame:
    """Rows by time window, language, view and label; late rows within the watermark still count."""
    keys = [F.window("loaded_at", width).alias("w"), "language", "view", "safety_label"]
    return views.groupBy(*keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "language", "view", "safety_label", "n")
