"""The events table as a stream of decoded receptions.

The table stands in for a feed: its order is the arrival order, users are vessels and event
types are message types. Position, source and station follow from the numbers of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that stand for the table's event types and sources.
SOURCES = ("kystverket", "udp:ab", "http:st1", "v1:dev", "aishub")
TYPES = {"view": "PositionReport", "click": "StandardClassBPositionReport", "purchase": "ShipStaticData", "signup": "BaseStationReport", "error": "StaticDataReport"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    e = F.col("event_id")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (e % 5 + 1).cast("int"))
    return raw.select(
        e.alias("seq"),
        (200_000_000 + F.col("user_id")).alias("mmsi"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        source.alias("source"),
        F.concat(source, F.lit("/"), (e % 7).cast("string")).alias("station"),
        F.element_at(names, F.col("event_type")).alias("msg_type"),
        ((e * 37 % 18000) / 100.0 - 90).alias("lat"),
        ((e * 53 % 36000) / 100.0 - 180).alias("lon"),
        F.col("value").alias("sog"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("payload"),
        F.col("props"),
    )


def spread(df: DataFrame) -> DataFrame:
    """The table is one small file; dealt out as a feed of several files is, so that its sentences are made and read in parallel."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


#: The same for DuckDB, as a common table expression.
EVENTS_SQL = """ev AS (
  SELECT event_id AS seq, 200000000 + user_id AS mmsi, epoch_us(ts) AS t,
    ['kystverket','udp:ab','http:st1','v1:dev','aishub'][(event_id % 5 + 1)::INT] AS source,
    concat(['kystverket','udp:ab','http:st1','v1:dev','aishub'][(event_id % 5 + 1)::INT], '/', (event_id % 7)::VARCHAR) AS station,
    CASE event_type WHEN 'view' THEN 'PositionReport' WHEN 'click' THEN 'StandardClassBPositionReport' WHEN 'purchase' THEN 'ShipStaticData' WHEN 'signup' THEN 'BaseStationReport' WHEN 'error' THEN 'StaticDataReport' END AS msg_type,
    (event_id * 37 % 18000)::DOUBLE / 100.0::DOUBLE - 90 AS lat, (event_id * 53 % 36000)::DOUBLE / 100.0::DOUBLE - 180 AS lon, value AS sog,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat(user_id::VARCHAR, '|', event_type) AS payload, props
  FROM events)"""
