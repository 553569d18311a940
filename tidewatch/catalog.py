"""Registry of the engine's queries with their DuckDB equivalents; names begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import folds, stations, subscribe, vessels
from tidewatch.plans.adapt import EVENTS_SQL, events, spread
from tidewatch.plans.scratch import new_path as _scratch
from tidewatch.sources import codec, formats
from tidewatch.streaming import dedupe as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MIN = 60_000_000
WINDOW = 30 * MIN
#: A fixed moment within the table's month stands for now.
NOW = 1_706_000_000_000_000
BOXES = [(-10.0, -20.0, 30.0, 40.0), (20.0, 100.0, 60.0, 170.0)]
_BOX_SQL = "((lat BETWEEN -10 AND 30 AND lon BETWEEN -20 AND 40) OR (lat BETWEEN 20 AND 60 AND lon BETWEEN 100 AND 170))"
_POS_SQL = "('PositionReport','StandardClassBPositionReport')"
_LICENSE_SQL = "CASE split_part({0}, ':', 1) WHEN 'kystverket' THEN 'nlod' WHEN 'digitraffic' THEN 'cc-by-4.0' WHEN 'aishub' THEN 'aishub' WHEN 'aisstream' THEN 'aisstream' ELSE 'feeder' END"


def query(sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    """Register a query under its name. ``base``: the SQL starts from the common table expression ``ev``."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{EVENTS_SQL}{sql.replace('RECURSIVE', '')}" if base else sql
        return f

    return add


@query(f" SELECT seq, mmsi, lat, lon FROM ev WHERE {_BOX_SQL}")
def flt1_bbox(spark, d):
    return events(spark, d).where(subscribe.any_box(BOXES)).select("seq", "mmsi", "lat", "lon")


@query(f" SELECT seq, mmsi, msg_type FROM ev WHERE msg_type IN ('PositionReport','ShipStaticData') AND mmsi IN (200000001,200000002,200000003,200000005,200000008) AND {_BOX_SQL}")
def flt2_match_all(spark, d):
    has = F.col("lat").isNotNull()
    return events(spark, d).where(subscribe.match_all(has, BOXES, [200000001, 200000002, 200000003, 200000005, 200000008], ["PositionReport", "ShipStaticData"])).select("seq", "mmsi", "msg_type")


@query(f" SELECT seq, mmsi FROM ev WHERE mmsi IN (200000001,200000007) OR (k % 3 = 0 AND {_BOX_SQL})")
def flt3_match_any(spark, d):
    return events(spark, d).where(subscribe.match_any(F.col("k") % 3 == 0, BOXES, [200000001, 200000007])).select("seq", "mmsi")


@query(f" SELECT msg_type, count(*) AS n FROM ev WHERE msg_type IN {_POS_SQL} GROUP BY 1")
def flt6_position_types(spark, d):
    return events(spark, d).where(F.col("msg_type").isin(*C.POSITION_TYPES)).groupBy("msg_type").agg(F.count("*").alias("n"))


@query(" SELECT source, count(*) AS n FROM ev WHERE split_part(source, ':', 1) IN ('udp','mmsi','http','v1') AND contains(source, ':') GROUP BY 1")
def flt7_feedable(spark, d):
    return events(spark, d).where(F.col("source").rlike(C.FEEDABLE)).groupBy("source").agg(F.count("*").alias("n"))


@query(" SELECT seq, CASE WHEN abs(lat * 1.1) > 90 OR abs(lon) > 180 THEN NULL ELSE round(lat * 1.1, 6) END AS lat FROM ev")
def flt10_valid_position(spark, d):
    lat = F.col("lat") * 1.1
    return events(spark, d).select("seq", F.when((F.abs(lat) <= 90) & (F.abs("lon") <= 180), F.round(lat, 6)).alias("lat"))


@query(" SELECT source, (%d - max(t)) AS age_us, (%d - max(t)) > 120000000 AS silent FROM ev WHERE t <= %d GROUP BY 1" % (NOW, NOW, NOW))
def flt15_silent_sources(spark, d):
    age = NOW - F.max("t")
    return events(spark, d).where(F.col("t") <= NOW).groupBy("source").agg(age.alias("age_us"), (age > 120_000_000).alias("silent"))


_DEDUPE_SQL = """, o AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY seq) AS rn FROM ev),
RECURSIVE f AS (SELECT payload, rn, seq, t AS last, false AS is_dup FROM o WHERE rn = 1
  UNION ALL SELECT o.payload, o.rn, o.seq, CASE WHEN abs(o.t - f.last) < %d THEN f.last ELSE o.t END, abs(o.t - f.last) < %d FROM f JOIN o ON o.payload = f.payload AND o.rn = f.rn + 1)""" % (WINDOW, WINDOW)


@query(_DEDUPE_SQL + " SELECT seq, is_dup FROM f")
def win1_dedupe(spark, d):
    return folds.dedupe(events(spark, d), ["payload"], WINDOW).select("seq", "is_dup")


@query(_DEDUPE_SQL + " SELECT seq, is_dup FROM f")
def str5_stream_dedupe(spark, d):
    base = _scratch(spark, "stream")
    events(spark, d).select("payload", "seq", "t").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("payload string, seq long, t long").parquet(f"{base}/in")
    return streams.run_to_end(streams.stream_dedupe(stream, WINDOW), base).select("seq", "is_dup")


@query(" SELECT seq, mmsi, last_value(CASE WHEN k % 4 = 0 THEN k END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM ev")
def win5_last_known(spark, d):
    return folds.last_known(events(spark, d), F.when(F.col("k") % 4 == 0, F.col("k")), "known").select("seq", "mmsi", "known")


@query(""" SELECT seq, CASE WHEN starts_with(source, 'udp:') THEN coalesce(last_value(CASE WHEN k % 5 = 0 THEN concat('mmsi:', mmsi::VARCHAR) END IGNORE NULLS)
  OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), source) ELSE source END AS label FROM ev""")
def win6_relabel(spark, d):
    return folds.relabel(events(spark, d), F.col("k") % 5 == 0).select("seq", "label")


@query(" SELECT seq, source FROM ev QUALIFY row_number() OVER (PARTITION BY source, t // 3600000000 ORDER BY seq) <= 2")
def win7_pacer(spark, d):
    return folds.pacer(events(spark, d), ["source"], stations.HOUR_US, 2).select("seq", "source")


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS rn FROM ev),
RECURSIVE f AS (SELECT mmsi, rn, seq, t AS start, 1 AS n FROM o WHERE rn = 1
  UNION ALL SELECT o.mmsi, o.rn, o.seq, CASE WHEN o.t - f.start > 21600000000 THEN o.t ELSE f.start END, CASE WHEN o.t - f.start > 21600000000 THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.mmsi = f.mmsi AND o.rn = f.rn + 1)
SELECT seq, n <= 1 AS allowed FROM f""")
def win8_limiter(spark, d):
    return folds.anchored_limit(events(spark, d), ["mmsi"], 360 * MIN, 1).select("seq", "allowed")


@query(" SELECT seq, k FROM (SELECT seq, k, lag(k) OVER (PARTITION BY mmsi ORDER BY seq) AS p FROM ev WHERE lat <> 0 AND lon <> 0) WHERE k IS DISTINCT FROM coalesce(p, -1)")
def win10_change(spark, d):
    rows = events(spark, d).select("seq", "mmsi", "lat", "lon", F.col("k").cast("string").alias("time"))
    return formats.snapshot_changes(rows).select("seq", F.col("time").cast("long").alias("k"))


@query(" SELECT seq, mmsi FROM (SELECT seq, mmsi, t - lag(t) OVER (PARTITION BY mmsi ORDER BY seq) AS gap FROM ev) WHERE gap > 86400000000")
def win12_quiet_gaps(spark, d):
    from pyspark.sql import Window

    gap = F.col("t") - F.lag("t").over(Window.partitionBy("mmsi").orderBy("seq"))
    return events(spark, d).withColumn("gap", gap).where(F.col("gap") > 86_400_000_000).select("seq", "mmsi")


#: A slow drift around a vessel's home, with late and jumping rows.
_MESSAGES_SQL = """, m AS (SELECT seq, mmsi, source, station, t - (seq * 7919 % 5) * 40000000000 AS t, (mmsi % 120 - 60)::DOUBLE + sog / 1000 AS lat, (mmsi % 300 - 150)::DOUBLE + CASE WHEN k % 10 = 0 THEN 20 ELSE sog / 1000 END AS lon, sog,
  CASE WHEN k % 6 = 0 THEN concat('V', k::VARCHAR) ELSE '' END AS name, msg_type <> 'ShipStaticData' AS pos, source LIKE 'udp:%' AS low, row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS rn FROM ev)"""


def _messages(spark, d):
    return events(spark, d).select(
        "seq", "mmsi", "source", "station",
        (F.col("t") - (F.col("seq") * 7919 % 5) * 40_000_000_000).alias("t"),
        ((F.col("mmsi") % 120 - 60).cast("double") + F.col("sog") / 1000).alias("lat"),
        ((F.col("mmsi") % 300 - 150).cast("double") + F.when(F.col("k") % 10 == 0, 20.0).otherwise(F.col("sog") / 1000)).alias("lon"),
        "sog", F.when(F.col("k") % 6 == 0, F.concat(F.lit("V"), F.col("k").cast("string"))).otherwise("").alias("name"), (F.col("msg_type") != "ShipStaticData").alias("pos"),
    )


@query(
    _MESSAGES_SQL
    + """, RECURSIVE f AS (
  SELECT mmsi, rn, t AS seen, pos AS has_pos, CASE WHEN pos THEN lat END AS lat, CASE WHEN pos THEN lon END AS lon, CASE WHEN pos THEN t END AS pos_at, CASE WHEN pos THEN sog END AS sog, nullif(name, '') AS name, station, CASE WHEN pos AND NOT low THEN t END AS trusted_at, 1 AS n, 0 AS n_stale, 0 AS n_jump FROM m WHERE rn = 1
  UNION ALL SELECT j.mmsi, j.rn, CASE WHEN jump OR stale THEN seen ELSE t END, has_pos OR (pos AND NOT stale AND NOT jump), CASE WHEN moves THEN xlat ELSE lat END, CASE WHEN moves THEN xlon ELSE lon END, CASE WHEN moves THEN t ELSE pos_at END, CASE WHEN moves THEN xsog ELSE sog END,
    CASE WHEN jump OR xname = '' THEN name ELSE xname END, CASE WHEN jump OR stale THEN station ELSE xstation END, CASE WHEN moves AND NOT low THEN t ELSE trusted_at END, n + CASE WHEN jump THEN 0 ELSE 1 END, n_stale + CASE WHEN stale AND NOT jump THEN 1 ELSE 0 END, n_jump + CASE WHEN jump THEN 1 ELSE 0 END
  FROM (SELECT *, pos AND NOT stale AND NOT jump AS moves FROM (SELECT *, low AND pos AND NOT stale AND has_pos AND t - pos_at >= 1000000 AND
      6880.13::DOUBLE * asin(sqrt(least(1, pow(sin(radians(xlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(xlat)) * pow(sin(radians(xlon - lon) / 2), 2)))) / ((t - pos_at) / 3.6e9) > 120 AS jump
    FROM (SELECT f.*, m.t, m.pos, m.low, m.lat AS xlat, m.lon AS xlon, m.sog AS xsog, m.name AS xname, m.station AS xstation, f.has_pos AND m.t < f.seen - 1000000 AS stale, m.rn AS rn2 FROM f JOIN m ON m.mmsi = f.mmsi AND m.rn = f.rn + 1) q) j0) j1, LATERAL (SELECT j1.rn2 AS rn, j1.mmsi AS mmsi) j)
SELECT mmsi, seen, has_pos, round(lat, 6) AS lat, round(lon, 6) AS lon, sog, name, station, trusted_at, n::BIGINT AS n, n_stale::BIGINT AS n_stale, n_jump::BIGINT AS n_jump FROM f QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY rn DESC) = 1"""
)
def win3_vessel_fold(spark, d):
    folded = vessels.vessel_fold(_messages(spark, d))
    return folded.select("mmsi", "seen", "has_pos", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "sog", "name", "station", "trusted_at", "n", "n_stale", "n_jump")


@query(
    _DEDUPE_SQL
    + f""", j AS (SELECT ev.*, is_dup, NOT is_dup AND msg_type IN {_POS_SQL} AS p FROM ev JOIN f USING (seq))
SELECT station, count(*) FILTER (NOT is_dup) AS events, count(*) FILTER (is_dup) AS duplicates, count(*) FILTER (p) AS positions, arg_min(t, seq) AS first_t, arg_max(t, seq) AS last_t,
  min(lat) FILTER (p) AS min_lat, min(lon) FILTER (p) AS min_lon, max(lat) FILTER (p) AS max_lat, max(lon) FILTER (p) AS max_lon FROM j GROUP BY 1"""
)
def agg1_station_stats(spark, d):
    return stations.station_stats(folds.dedupe(events(spark, d), ["payload"], WINDOW))


@query(f" SELECT station, count(*) FILTER (t >= {NOW - 3 * 86400_000_000}) AS vessels FROM (SELECT station, mmsi, arg_max(t, seq) AS t FROM ev GROUP BY ALL) GROUP BY 1")
def agg3_station_vessels(spark, d):
    return stations.station_vessels(events(spark, d), NOW, 3 * 86_400_000_000)


@query(f" SELECT station, count(*) FILTER (t // 3600000000 > {NOW // stations.HOUR_US - 24} AND t // 3600000000 <= {NOW // stations.HOUR_US}) AS events_24h FROM ev GROUP BY 1")
def agg5_hour_ring(spark, d):
    return stations.hour_ring(events(spark, d), NOW)


@query(f" SELECT split_part(source, ':', 1) AS kind, count(*) AS stations, count(*) FILTER ({NOW} - t < 3600000000) AS active FROM (SELECT station, source, arg_max(t, seq) AS t FROM ev GROUP BY ALL) GROUP BY 1")
def agg6_station_totals(spark, d):
    return stations.station_totals(events(spark, d), NOW, stations.HOUR_US)


@query(" SELECT msg_type, count(DISTINCT mmsi) AS vessels, count(*) FILTER (lat BETWEEN -60 AND 60) AS mid_latitudes FROM ev GROUP BY 1")
def agg7_vessel_totals(spark, d):
    return events(spark, d).groupBy("msg_type").agg(F.countDistinct("mmsi").alias("vessels"), F.count_if(F.col("lat").between(-60, 60)).alias("mid_latitudes"))


@query(" SELECT t // 3600000000 * 3600000000 AS start_t, count(*) AS events, round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM ev GROUP BY 1")
def agg8_rate(spark, d):
    return stations.rate(events(spark, d), "1 hour")


@query(f" SELECT source, count(*) AS events, {NOW} - max(t) AS age_us FROM ev GROUP BY 1")
def agg9_sources(spark, d):
    return events(spark, d).groupBy("source").agg(F.count("*").alias("events"), (NOW - F.max("t")).alias("age_us"))


#: Subscriptions around a place that follows from the customer's number.
_SUBS_SQL = ", subs AS (SELECT c_custkey AS sub, (c_custkey * 7 % 160 - 80)::DOUBLE AS min_lat, (c_custkey * 13 % 340 - 170)::DOUBLE AS min_lon, (c_custkey * 7 % 160 - 80)::DOUBLE + 4 AS max_lat, (c_custkey * 13 % 340 - 170)::DOUBLE + 6 AS max_lon FROM customer)"


def _subs(spark, d):
    key = F.col("c_custkey")
    lat, lon = (key * 7 % 160 - 80).cast("double"), (key * 13 % 340 - 170).cast("double")
    return spark.read.parquet(f"{d}/customer.parquet").select(key.alias("sub"), lat.alias("min_lat"), lon.alias("min_lon"), (lat + 4).alias("max_lat"), (lon + 6).alias("max_lon"))


@query(_SUBS_SQL + " SELECT sub, count(*) AS n, min(seq) AS first_seq, count(DISTINCT mmsi) AS vessels FROM ev JOIN subs ON lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon GROUP BY 1")
def join2_fan_out(spark, d):
    return subscribe.fan_out_totals(events(spark, d), _subs(spark, d))


@query(""", s AS (SELECT station, count(*) AS events FROM ev GROUP BY 1), v AS (SELECT mmsi, arg_max(station, seq) AS station FROM ev GROUP BY 1)
SELECT s.station, s.events, count(v.mmsi) AS vessels, min(v.mmsi) AS least_mmsi FROM s LEFT JOIN v USING (station) GROUP BY ALL""")
def join3_station_detail(spark, d):
    e = events(spark, d)
    current = e.groupBy("mmsi").agg(F.max_by("station", "seq").alias("station"))
    at = current.groupBy("station").agg(F.count("*").alias("vessels"), F.min("mmsi").alias("least_mmsi"))
    return e.groupBy("station").agg(F.count("*").alias("events")).join(at, "station", "left").select("station", "events", F.coalesce("vessels", F.lit(0)).alias("vessels"), "least_mmsi")


@query(f" SELECT {_LICENSE_SQL.format('source')} AS license, count(*) AS n FROM ev GROUP BY 1")
def join4_license(spark, d):
    return events(spark, d).groupBy(C.license_of(F.col("source")).alias("license")).agg(F.count("*").alias("n"))


@query(" SELECT n.seq FROM ev n WHERE n.source = 'aishub' AND NOT EXISTS (SELECT 1 FROM ev l WHERE l.source <> 'aishub' AND l.mmsi = n.mmsi AND n.t - l.t BETWEEN 0 AND 21599999999)")
def join5_quiet_targets(spark, d):
    e = events(spark, d)
    return subscribe.quiet_targets(e.where("source = 'aishub'"), e.where("source != 'aishub'"), 360 * MIN).select("seq")


@query(_SUBS_SQL + ", claims AS (SELECT s_suppkey AS claim, (s_suppkey * 7 % 100 - 60)::DOUBLE AS a, (s_suppkey * 13 % 200 - 120)::DOUBLE AS b FROM supplier) SELECT sub, count(*) AS claims FROM subs JOIN claims ON min_lat >= a AND max_lat <= a + 20 AND min_lon >= b AND max_lon <= b + 40 GROUP BY 1")
def join7_claim_boxes(spark, d):
    key = F.col("s_suppkey")
    claims = spark.read.parquet(f"{d}/supplier.parquet").select(key.alias("claim"), (key * 7 % 100 - 60).cast("double").alias("a"), (key * 13 % 200 - 120).cast("double").alias("b"))
    boxes = claims.select("claim", F.col("a").alias("min_lat"), F.col("b").alias("min_lon"), (F.col("a") + 20).alias("max_lat"), (F.col("b") + 40).alias("max_lon"))
    return subscribe.claims_around(_subs(spark, d), boxes)


@query(" SELECT feed, count(*) AS n, min(seq) AS first_seq FROM (SELECT 'a' AS feed, seq FROM ev WHERE source = 'kystverket' UNION ALL SELECT 'b' AS feed, seq FROM ev WHERE source <> 'kystverket') GROUP BY 1")
def set1_union(spark, d):
    e = events(spark, d)
    both = e.where("source = 'kystverket'").select(F.lit("a").alias("feed"), "seq", "lat").unionByName(e.where("source != 'kystverket'").select(F.lit("b").alias("feed"), "seq"), allowMissingColumns=True)
    return both.groupBy("feed").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(" SELECT seq, substr(sha256(unhex(concat(replace(replace(replace(lpad(bin(mmsi), 30, '0'), '1', 'x'), '0', '00'), 'x', '01'), CASE WHEN seq % 2 = 0 THEN '41' ELSE '42' END))), 1, 32) AS id FROM ev")
def fn4_event_id(spark, d):
    return events(spark, d).select("seq", C.event_id(C.binary(F.col("mmsi"), 30), F.when(F.col("seq") % 2 == 0, "41").otherwise("42")).alias("id"))


@query(" SELECT seq, lpad(upper(hex(list_reduce(list_transform(string_split(payload, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a, b)))), 2, '0') AS sum FROM ev")
def fn7_checksum(spark, d):
    return events(spark, d).select("seq", C.checksum(F.col("payload")).alias("sum"))


@query(" SELECT seq, right(translate(concat(station, ',', payload), ',\\*:', '____'), 15) AS safe FROM ev")
def fn8_tag_safe(spark, d):
    return events(spark, d).select("seq", C.tag_safe(F.concat("station", F.lit(","), "payload")).alias("safe"))


@query(" SELECT seq, ((seq * 733) >> 16) & 15 AS eta_month, ((seq * 733) >> 11) & 31 AS eta_day, ((seq * 733) >> 6) & 31 AS eta_hour, (seq * 733) & 63 AS eta_minute FROM ev")
def fn9_eta(spark, d):
    return events(spark, d).select("seq", *(c.alias(n) for n, c in C.eta_fields(F.col("seq") * 733).items()))


@query(" SELECT seq, round(6880.13::DOUBLE * asin(sqrt(least(1, pow(sin(radians(60 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(60)) * pow(sin(radians(10 - lon) / 2), 2)))), 6) AS nm FROM ev")
def fn10_distance(spark, d):
    return events(spark, d).select("seq", F.round(C.distance_nm(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(10.0)), 6).alias("nm"))


@query(" SELECT seq, round(greatest(-90, lat - 1), 6) AS a, round(greatest(-180, lon - 60 / (60 * greatest(0.05, cos(radians(lat))))), 6) AS b, round(least(90, lat + 1), 6) AS c, round(least(180, lon + 60 / (60 * greatest(0.05, cos(radians(lat))))), 6) AS d FROM ev")
def fn11_box_around(spark, d):
    box = C.box_around(F.col("lat"), F.col("lon"), 60.0)
    return events(spark, d).select("seq", *(F.round(c, 6).alias(n) for n, c in zip("abcd", box, strict=True)))


@query(" SELECT seq, floor(sog * 1.9438444924574 + 0.5)::BIGINT AS knots, round(sign(sog - 100) * 4.733 * sqrt(abs(sog - 100)), 6) AS rot, CASE WHEN k = 30 THEN 'fishing' WHEN k IN (36, 37) THEN 'pleasure' WHEN k IN (31, 32, 52) THEN 'tug' WHEN k // 10 = 4 THEN 'fast' WHEN k // 10 = 6 THEN 'passenger' WHEN k // 10 = 7 THEN 'cargo' WHEN k // 10 = 8 THEN 'tanker' ELSE 'other' END AS class, CASE WHEN k * 10 < 180 THEN 1.0::DOUBLE WHEN k * 10 < 600 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS opacity FROM ev")
def fn16_units_and_classes(spark, d):
    return events(spark, d).select("seq", C.round_half_up(F.col("sog") * 1.9438444924574).alias("knots"), F.round(C.rot_indicated(F.col("sog") - 100), 6).alias("rot"), C.ship_class(F.col("k")).alias("class"), C.age_opacity(F.col("k") * 10).alias("opacity"))


@query(""", x AS (SELECT seq, t, CASE seq % 4 WHEN 0 THEN t // 1000000 WHEN 1 THEN t // 1000 WHEN 2 THEN t ELSE 0 END AS tag, t - (seq % 60) * 1000000 AS src FROM ev),
y AS (SELECT *, CASE WHEN tag <= 0 THEN NULL WHEN tag < 1000000000000 THEN tag * 1000000 WHEN tag < 1000000000000000 THEN tag * 1000 ELSE tag END AS tag_t FROM x)
SELECT seq, tag_t, coalesce(CASE WHEN abs(tag_t - t) <= 30000000 THEN tag_t END, CASE WHEN abs(src - t) <= 30000000 THEN src END, t) AS event_t FROM y""")
def time2_canonical(spark, d):
    t, kind = F.col("t"), F.col("seq") % 4
    tag = F.when(kind == 0, F.floor(t / 1_000_000)).when(kind == 1, F.floor(t / 1000)).when(kind == 2, t).otherwise(0)
    tagged = events(spark, d).select("seq", "t", C.tag_time_us(tag).alias("tag_t"), (t - (F.col("seq") % 60) * 1_000_000).alias("src"))
    return tagged.select("seq", "tag_t", C.canonical_time_us(t, F.col("tag_t"), F.col("src")).alias("event_t"))


@query(""" SELECT seq, 1::BIGINT AS type, mmsi, right(replace(station, ':', '_'), 15) AS tag_s, t // 1000 * 1000 AS tag_t, CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS channel,
  round(round(least(sog, 102.2) * 10) / 10, 6) AS sog, round(round(lon * 600000) / 600000, 6) AS lon, round(round(lat * 600000) / 600000, 6) AS lat FROM ev""")
def par9_encode_decode(spark, d):
    out = formats.decode_positions(formats.parse(_replayed(spark, d)))
    return out.select("seq", "type", "mmsi", "tag_s", "tag_t", "channel", *(F.round(c, 6).alias(c) for c in ("sog", "lon", "lat")))


@query(" SELECT seq, concat('!AIVDM,', payload, '*4A') AS line FROM ev")
def par2_trailing_fields(spark, d):
    line = F.concat(F.lit("!AIVDM,"), "payload", F.lit("*4A"), F.when(F.col("seq") % 2 == 0, ",b003660465").otherwise(""))
    return events(spark, d).select("seq", C.without_trailing_fields(line).alias("line"))


@query(" SELECT seq, 'http:st1' AS source, epoch_us(strptime(strftime(make_timestamp(t), '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S')) AS source_t, concat('!', n, payload) AS line FROM ev, (SELECT unnest(['1','2']) AS n)")
def src3_http_envelopes(spark, d):
    msg = F.struct(F.array(F.concat(F.lit("!1"), "payload"), F.concat(F.lit("!2"), "payload")).alias("nmea"), F.date_format(F.timestamp_micros("t"), "yyyyMMddHHmmss").alias("rxtime"))
    return formats.http_envelopes(events(spark, d).select("seq", F.to_json(F.struct(F.array(msg).alias("msgs"))).alias("body")), "st1")


@query(f" SELECT {_LICENSE_SQL.format('source')} AS license, replace(source, ':', '/') AS feed, strftime(make_timestamp(t), '%Y-%m-%d') AS day, hour(make_timestamp(t))::INT AS hour, count(*) AS n, min(seq) AS first_seq FROM ev GROUP BY ALL")
def snk1_archive(spark, d):
    path = _scratch(spark, "archive")
    formats.write_archive(events(spark, d).select("seq", F.col("t").alias("recv_t"), "source", "station", F.col("payload").alias("body")), path)
    kept = formats.read_archive(spark, path)
    return kept.groupBy("license", F.col("feed"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("hour").cast("int").alias("hour")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(" SELECT seq, concat('{\"mmsi\":', mmsi, ',\"seq\":', seq, ',\"type\":\"', msg_type, '\"', CASE WHEN k % 2 = 0 THEN concat(',\"k\":', k) ELSE '' END, '}') AS event FROM ev")
def snk5_event_json(spark, d):
    return events(spark, d).select("seq", F.to_json(F.struct("mmsi", "seq", F.col("msg_type").alias("type"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("k"))).alias("event"))


_XOR_SQL = "lpad(upper(hex(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a, b)))), 2, '0')"


@query(", b AS (SELECT seq, payload, concat('s:', right(replace(station, ':', '_'), 15), ',c:', t // 1000000) AS tag FROM ev) SELECT seq, concat('\\', tag, '*', " + _XOR_SQL.format("tag") + ", '\\', payload) AS line FROM b")
def snk6_tagged_text(spark, d):
    tag = C.tag_block([("s", C.tag_safe(F.col("station"))), ("c", F.floor(F.col("t") / 1_000_000).cast("string"))])
    return events(spark, d).select("seq", F.concat(tag, "payload").alias("line"))


@query(" SELECT seq, substr(sha256(unhex(concat('%s', sha256(unhex(concat('%s', hex(station))))))), 1, 12) AS id FROM ev" % tuple(bytes(b ^ p for b in b"salt".ljust(64, b"\0")).hex() for p in (0x5C, 0x36)))
def fn14_station_hash(spark, d):
    return events(spark, d).select("seq", F.substring(C.hmac_sha256(b"salt", F.col("station")), 1, 12).alias("id"))


@query(" SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE t // 1000 * 1000 END AS t FROM ev")
def time4_written_time(spark, d):
    text = F.concat(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +0000 UTC"))
    return events(spark, d).select("seq", C.go_time_us(F.when(F.col("seq") % 9 == 0, "soon").otherwise(text)).alias("t"))


@query(" SELECT seq, mmsi, p AS part, CASE WHEN p = 0 THEN concat('V', k, ' ', upper(msg_type)) [1:20] END AS name, CASE WHEN p = 1 THEN k % 100 END AS ship_type FROM ev, (SELECT unnest([0, 1]::BIGINT[]) AS p)")
def par9_static_reports(spark, d):
    e = events(spark, d)
    name = F.concat(F.lit("V"), F.col("k").cast("string"), F.lit(" "), "msg_type")
    told = codec.encoded(e, 24, {"mmsi": F.col("mmsi"), "name": name}, part=0).unionByName(codec.encoded(e, 24, {"mmsi": F.col("mmsi"), "ship_type": F.col("k") % 100}, part=1))
    return codec.decoded(told.select("seq", "payload", "fill"), ["part", "name", "ship_type"]).select("seq", "mmsi", "part", "name", "ship_type")


@query(" SELECT seq, mmsi, round(round(lat * 600000) / 600000, 6) AS lat, round(round(lon * 600000) / 600000, 6) AS lon, round(round(sog * 10) / 10, 6) AS sog FROM ev WHERE t // 3600000000 % 24 <> 0")
def src10_snapshots(spark, d):
    row = F.struct(F.col("mmsi").alias("MMSI"), F.col("seq").alias("SEQ"), F.round(F.col("lat") * 600000).cast("long").alias("LATITUDE"), F.round(F.col("lon") * 600000).cast("long").alias("LONGITUDE"), F.round(F.col("sog") * 10).cast("long").alias("SOG"))
    hour = F.floor(F.col("t") / stations.HOUR_US)
    error = F.when(hour % 24 == 0, "true").otherwise("false")
    polls = events(spark, d).groupBy(hour.alias("h"), error.alias("e"), (F.col("seq") % 64).alias("s")).agg(F.collect_list(row).alias("rows"))
    rows = formats.snapshot_rows(polls.select(F.concat(F.lit('[{"ERROR":'), "e", F.lit("},"), F.to_json("rows"), F.lit("]")).alias("body")))
    return rows.select("seq", "mmsi", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "sog")))


@query(_SUBS_SQL + """ SELECT sub, CASE WHEN sub % 10 = 0 THEN 'no box' WHEN abs(max_lat + sub % 40) > 90 OR abs(min_lon) > 180 OR abs(max_lon) > 180 THEN 'corner out of range' WHEN sub % 7 = 0 THEN 'bad mmsi' WHEN sub % 6 = 0 THEN 'duplicate type' END AS error FROM subs""")
def flt14_subscription_errors(spark, d):
    sub = F.col("sub")
    mmsis = F.array(F.when(sub % 7 == 0, "12345").otherwise("200000001"))
    types = F.when(sub % 6 == 0, F.array(F.lit("PositionReport"), F.lit("PositionReport"))).otherwise(F.array(F.lit("PositionReport")))
    asked = _subs(spark, d).withColumns({"min_lat": F.when(sub % 10 != 0, F.col("min_lat")), "max_lat": F.col("max_lat") + sub % 40, "mmsis": mmsis, "types": types})
    return asked.select("sub", subscribe.subscription_error().alias("error"))


@query(", s AS (SELECT station, count(*) AS n FROM ev WHERE t > %d AND t <= %d GROUP BY 1), c AS (SELECT s_suppkey AS claim, unnest([concat('v1:dev/', s_suppkey %% 7), concat('http:st1/', s_suppkey %% 5)]) AS station FROM supplier) SELECT claim, coalesce(sum(n), 0)::BIGINT AS contributed FROM c LEFT JOIN s USING (station) GROUP BY 1" % (NOW - 86_400_000_000, NOW))
def agg11_contributed(spark, d):
    key = F.col("s_suppkey")
    ids = F.array(F.concat(F.lit("v1:dev/"), (key % 7).cast("string")), F.concat(F.lit("http:st1/"), (key % 5).cast("string")))
    claims = spark.read.parquet(f"{d}/supplier.parquet").select(key.alias("claim"), F.explode(ids).alias("station"))
    recent = events(spark, d).where((F.col("t") > NOW - 86_400_000_000) & (F.col("t") <= NOW)).groupBy("station").agg(F.count("*").alias("n"))
    return claims.join(recent, "station", "left").groupBy("claim").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("contributed"))


_WIDE = [(-90.0, -170.0, 90.0, 170.0)]


@query(" SELECT mmsi, lat, lon, t FROM (SELECT mmsi, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon, max(t) AS t FROM ev GROUP BY 1) WHERE lon BETWEEN -170 AND 170")
def flt5_vessels_in_box(spark, d):
    last = events(spark, d).groupBy("mmsi").agg(F.max_by("lat", "seq").alias("lat"), F.max_by("lon", "seq").alias("lon"), F.max("t").alias("t"))
    return last.where(subscribe.any_box(_WIDE))


@query(" SELECT mmsi, count(*) AS n, CASE WHEN count(*) FILTER (t > %d AND t <= %d) >= 2 THEN 'feeder' ELSE 'personal' END AS tier FROM ev GROUP BY 1" % (NOW - 86_400_000_000, NOW))
def pol4_effective_tier(spark, d):
    recent = F.count_if((F.col("t") > NOW - 86_400_000_000) & (F.col("t") <= NOW))
    return events(spark, d).groupBy("mmsi").agg(F.count("*").alias("n"), F.when(recent >= 2, "feeder").otherwise("personal").alias("tier"))


@query(_SUBS_SQL + " SELECT c_mktsegment AS segment, round(sum((max_lat - min_lat) * (max_lon - min_lon)), 6) AS area, count(*) FILTER (24 <= 20 + sub % 10) AS allowed FROM subs JOIN customer ON c_custkey = sub GROUP BY 1")
def pol5_area(spark, d):
    named = _subs(spark, d).join(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sub"), F.col("c_mktsegment").alias("segment")), "sub")
    area = (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))
    return named.groupBy("segment").agg(F.round(F.sum(area), 6).alias("area"), F.count_if(area <= 20 + F.col("sub") % 10).alias("allowed"))


@query(" SELECT floor(lat / 10)::BIGINT AS cy, floor(lon / 10)::BIGINT AS cx, count(*) AS n FROM ev GROUP BY ALL")
def plan_heat_cells(spark, d):
    return events(spark, d).groupBy(F.floor(F.col("lat") / 10).alias("cy"), F.floor(F.col("lon") / 10).alias("cx")).agg(F.count("*").alias("n"))


@query(" SELECT mmsi, seq, t, lat, lon, row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS step FROM ev WHERE t BETWEEN %d AND %d" % (NOW - 5 * 86_400_000_000, NOW))
def plan_tracks(spark, d):
    from pyspark.sql import Window

    part = events(spark, d).where(F.col("t").between(NOW - 5 * 86_400_000_000, NOW))
    return part.select("mmsi", "seq", "t", "lat", "lon", F.row_number().over(Window.partitionBy("mmsi").orderBy("seq")).cast("long").alias("step"))


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """The events as sentences, archived and read back."""
    path = _scratch(spark, "sentences")
    formats.write_archive(formats.sentences(spread(events(spark, d))), path)
    return formats.read_archive(spark, path).select("seq", "source", "station", "recv_t", "body")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences decoded, de-duplicated and folded: the vessels last seen in one of the boxes."""
    told = formats.decode_positions(formats.parse(_replayed(spark, sf_dir)))
    rows = told.select("seq", "mmsi", F.col("tag_t").alias("t"), "lat", "lon", "sog", F.col("tag_s").alias("source"), F.col("tag_s").alias("station"), F.lit("").alias("name"), F.lit(True).alias("pos"), F.concat_ws("|", F.col("mmsi").cast("string"), F.col("sog").cast("string"), "channel").alias("payload"))
    kept = folds.dedupe(rows, ["payload"], 10_000_000).where("not is_dup")
    return vessels.vessel_fold(kept).where(subscribe.any_box([(-90.0, -30.0, -50.0, 30.0), (50.0, -60.0, 90.0, 0.0)])).select("mmsi", "seen", "lat", "lon", "sog", "station", "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# They register their queries with the decorator above.
from tidewatch import catalog_feeds, catalog_maps, catalog_messages, catalog_outcomes, catalog_rules, catalog_streams  # noqa: E402, F401
