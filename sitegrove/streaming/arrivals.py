"""Structured Streaming: assets that arrive are extracted as in a batch; diagnostics are counted in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitegrove.extract.operator import extract


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in `folder`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def holding_updates(assets: DataFrame, delay: str = "14 days") -> DataFrame:
    """Of the arriving rows those that are no exact redelivery (same id and ingested_at) within the watermark."""
    stamped = assets.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", delay)
    return stamped.dropDuplicatesWithinWatermark(["id", "ingested_at"])


def arriving_relations(assets: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The relations in arriving assets: the batch extractor, stateless."""
    return extract(assets, types)


def diagnostics_per_window(diagnostics: DataFrame, width: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Counts of arriving diagnostics per event-time window, severity (lower case) and code; late rows beyond the delay are dropped."""
    stamped = diagnostics.withColumn("raised_at", F.col("raised_at").cast("timestamp")).withWatermark("raised_at", delay)
    counts = stamped.groupBy(F.window("raised_at", width).alias("w"), F.lower("severity").alias("severity"), "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "severity", "code", "n")


def to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to Parquet exactly once, with all that is there now."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls f(batch, number) for each micro-batch; f must be safe to repeat."""
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
