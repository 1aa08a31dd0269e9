"""Plate counts as readings arrive: the batch operators' counts kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_readings(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def plate_windows(readings: DataFrame, time: str, plate: str, value: str, lod: str, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Readings, values and detected values per plate and window of reading time; readings later than `late` behind the
    newest are left out, which bounds the state. Works on streams and on tables."""
    x = F.when(~F.isnan(F.col(value)), F.col(value))
    timed = readings.withColumn("__tg_t", F.col(time).cast("timestamp")).withWatermark("__tg_t", late)
    grouped = timed.groupBy(F.window("__tg_t", width).alias("w"), plate).agg(F.count("*").alias("readings"), F.count(x).alias("numbers"), F.count_if(x >= F.col(lod)).alias("detected"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), plate, "readings", "numbers", "detected")
