"""Station statistics and service totals as hash aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import POSITION_TYPES, source_kind

HOUR_US = 3_600_000_000


def station_stats(judged: DataFrame) -> DataFrame:
    """Per station: events, duplicates, positions, first and latest-arrived time, covered box. ``judged`` has is_dup."""
    kept = ~F.col("is_dup")
    pos = kept & F.col("msg_type").isin(*POSITION_TYPES)
    return judged.groupBy("station").agg(
        F.count_if(kept).alias("events"),
        F.count_if("is_dup").alias("duplicates"),
        F.count_if(pos).alias("positions"),
        F.min_by("t", "seq").alias("first_t"),
        F.max_by("t", "seq").alias("last_t"),
        F.min(F.when(pos, F.col("lat"))).alias("min_lat"),
        F.min(F.when(pos, F.col("lon"))).alias("min_lon"),
        F.max(F.when(pos, F.col("lat"))).alias("max_lat"),
        F.max(F.when(pos, F.col("lon"))).alias("max_lon"),
    )


def station_vessels(events: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """Vessels whose latest-arrived message at a station is at most ``window_us`` old."""
    last = events.groupBy("station", "mmsi").agg(F.max_by("t", "seq").alias("t"))
    return last.groupBy("station").agg(F.count_if(F.col("t") >= now_us - window_us).alias("vessels"))


def hour_ring(events: DataFrame, now_us: int, hours: int = 24) -> DataFrame:
    """Events of the current clock hour and those before it, ``hours`` in all."""
    hour, now = F.floor(F.col("t") / HOUR_US), now_us // HOUR_US
    return events.groupBy("station").agg(F.count_if((hour > now - hours) & (hour <= now)).alias("events_24h"))


def station_totals(events: DataFrame, now_us: int, active_us: int) -> DataFrame:
    last = events.groupBy("station", "source").agg(F.max_by("t", "seq").alias("t"))
    return last.groupBy(source_kind(F.col("source")).alias("kind")).agg(F.count("*").alias("stations"), F.count_if(now_us - F.col("t") < active_us).alias("active"))


def rate(events: DataFrame, window: str) -> DataFrame:
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    counted = events.groupBy(F.window(F.timestamp_micros("t"), window).alias("w")).agg(F.count("*").alias("events"))
    return counted.select(F.unix_micros("w.start").alias("start_t"), "events", F.round(F.col("events") / seconds, 9).alias("per_second"))
