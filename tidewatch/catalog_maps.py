"""Queries of tiles, of the SQL surface and of sets in streams, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.functions import sql
from tidewatch.operators import tiles
from tidewatch.plans.adapt import events, spread
from tidewatch.plans.scratch import written
from tidewatch.sources import codec


@query(
    f""", p AS (SELECT mmsi, least(4095, floor((lon + 180) / 360 * 4096))::INT AS x, greatest(0, least(4095, floor((1 - ln(tan(f) + 1 / cos(f)) / pi()) / 2 * 4096)))::INT AS y FROM (SELECT mmsi, lon, radians(greatest(-{tiles.EDGE}, least({tiles.EDGE}, lat))) AS f FROM ev WHERE msg_type <> 'ShipStaticData')),
z AS (SELECT unnest(range(13))::INT AS zoom)
SELECT zoom, x // (1 << (12 - zoom)) AS x, y // (1 << (12 - zoom)) AS y, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM p, z GROUP BY ALL"""
)
def plan_heat_tiles(spark, d):
    """Tiles of all zooms from 0 to 12, from one count of the finest."""
    return tiles.pyramid(events(spark, d).where("msg_type <> 'ShipStaticData'")).select("zoom", "x", "y", "n", "vessels")


@query(
    """, h AS (SELECT seq, mmsi, round(lat * 600000) / 600000 AS la, round(lon * 600000) / 600000 AS lo FROM ev WHERE seq % 7 <> 0)
SELECT seq, mmsi, round(la, 6) AS lat, round(lo, 6) AS lon, round(6880.13 * asin(sqrt(least(1, pow(sin(radians(60 - la) / 2), 2) + cos(radians(la)) * cos(radians(60)) * pow(sin(radians(10 - lo) / 2), 2)))), 4) AS nm, mmsi AS sender FROM h WHERE la BETWEEN -60 AND 60 AND lo BETWEEN -100 AND 100"""
)
def plan_sql_text(spark, d):
    """Sentences decoded, checked and measured by a query in SQL text."""
    sql.register(spark)
    e = spread(events(spark, d)).withColumn("sog", F.least("sog", F.lit(102.2)))
    coded = codec.encoded(e, 1, {c: F.col(c) for c in ("mmsi", "lat", "lon", "sog")})
    line = F.element_at("nmea", 1)
    # every seventh line is damaged
    told = coded.select("seq", "payload", F.when(F.col("seq") % 7 == 0, F.concat(F.expr("left(nmea[0], 20)"), F.lit("x"), F.expr("substr(nmea[0], 22)"))).otherwise(line).alias("sentence"))
    # both the table function and the query read them
    written(told, "lines").createOrReplaceTempView("tidewatch_lines")
    return spark.sql("""
        SELECT d.seq, d.mmsi, round(d.lat, 6) AS lat, round(d.lon, 6) AS lon, round(geo_nm(d.lat, d.lon, 60D, 10D), 4) AS nm, ais_unsigned(ais_bits(l.payload, 0), 8, 30) AS sender
        FROM ais_decode(TABLE(SELECT seq, sentence FROM tidewatch_lines)) d JOIN tidewatch_lines l ON l.seq = d.seq
        WHERE geo_in_box(d.lat, d.lon, -60, -100, 60, 100) AND nmea_checksum(substr(l.sentence, 2, length(l.sentence) - 4)) = right(l.sentence, 2)""")
