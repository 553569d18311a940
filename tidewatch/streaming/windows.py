"""Watermarked windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame) -> DataFrame:
    """start_t, msg_type, events of each clock hour of a stream of (t, msg_type); an hour's state goes a minute after its end."""
    timed = stream.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", "60 seconds")
    counted = timed.groupBy(F.window("ts", "1 hour").alias("w"), "msg_type").agg(F.count("*").alias("events"))
    return counted.select(F.unix_micros("w.start").alias("start_t"), "msg_type", "events")


def station_counts(stream: DataFrame) -> DataFrame:
    """station, events, duplicates so far of a stream of judged rows (station, is_dup): the state is a row per station."""
    return stream.groupBy("station").agg(F.count_if(~F.col("is_dup")).alias("events"), F.count_if("is_dup").alias("duplicates"))


def latest(updates: DataFrame, *key: str) -> DataFrame:
    """Of rows told again and again as their counts grow, the last."""
    return updates.groupBy(*key).agg(*(F.max(c).alias(c) for c in updates.columns if c not in key))
