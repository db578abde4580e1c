"""Readers for the given parquet tables."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", epoch_us("ts").alias("t_us"))


def event_spans(spark: SparkSession, folder: str, stretch: int) -> DataFrame:
    """Events as intervals ``[ts, ts + value * stretch s]``."""
    e = events(spark, folder)
    return e.withColumn("start_us", F.col("t_us")).withColumn("end_us", F.col("t_us") + F.round(F.col("value") * F.lit(1e6) * F.lit(stretch)).cast("bigint"))
