"""The point-in-time feed as a stream: counts per day and first visibility, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def day_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Events per day and type of event_time; what comes later than ``late`` is past the watermark."""
    stamped = stream.withColumn("at", F.col("event_time").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def released(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event once, with the day whose 15:00 is the first to see it; repeats within the watermark fall away."""
    once = stream.withColumn("at", F.col("available_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    day = F.to_date("available_at")
    return once.withColumn("due", F.when(F.col("available_at") <= rules.bar_cutoff(day), day).otherwise(F.date_add(day, 1))).drop("at")
