"""Queries of filters, ordered folds, streams, joins and policy, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.catalog import _BOX_SQL, _DEDUPE_SQL, _MESSAGES_SQL, _POS_SQL, BOXES, MIN, NOW, WINDOW, _messages, _scratch, _subs, _SUBS_SQL, query
from tidewatch.functions import columns as C
from tidewatch.operators import addresses, folds, policy, stations, subscribe, vessels
from tidewatch.plans.adapt import events
from tidewatch.sources import positions
from tidewatch.streaming import dedupe as streams
from tidewatch.streaming import windows

_HOME = (-60.0, -150.0, 60.0, 150.0)

#: Every step of the vessels' fold, with what it stamps on the message.
_STEPS_SQL = (
    _MESSAGES_SQL.replace("AS name, msg_type", "AS name, k % 9 = 0 AS dup, k, msg_type")
    + """, RECURSIVE f AS (
  SELECT mmsi, rn, seq, t AS seen, pos AND NOT dup AS has_pos, CASE WHEN pos AND NOT dup THEN lat END AS lat, CASE WHEN pos AND NOT dup THEN lon END AS lon, CASE WHEN pos AND NOT dup THEN t END AS pos_at, CASE WHEN NOT dup THEN nullif(name, '') END AS name, CASE WHEN pos AND NOT low AND NOT dup THEN t END AS trusted_at,
    CASE WHEN dup THEN 0 ELSE 1 END AS n, dup, false AS jump, false AS stale, low, t, CASE WHEN pos AND NOT dup THEN lat END AS e_lat FROM m WHERE rn = 1
  UNION ALL SELECT mmsi, rn2, xseq, CASE WHEN jump OR stale OR xdup THEN seen ELSE xt END, has_pos OR moves, CASE WHEN moves THEN xlat ELSE lat END, CASE WHEN moves THEN xlon ELSE lon END, CASE WHEN moves THEN xt ELSE pos_at END, CASE WHEN jump OR xdup OR xname = '' THEN name ELSE xname END,
    CASE WHEN moves AND NOT xlow THEN xt WHEN xdup AND heard AND NOT xlow AND n > 0 AND (trusted_at IS NULL OR xt > trusted_at) THEN xt ELSE trusted_at END, n + CASE WHEN xdup OR jump THEN 0 ELSE 1 END, xdup, jump, stale, xlow, xt, CASE WHEN moves OR (stale AND xpos AND NOT xdup) THEN xlat ELSE lat END
  FROM (SELECT *, xpos AND NOT xdup AND NOT stale AND NOT jump AS moves FROM (SELECT * EXCLUDE (jump, stale), xstale AS stale, NOT xdup AND xlow AND xpos AND NOT xstale AND has_pos AND xt - pos_at >= 1000000 AND
      6880.13::DOUBLE * asin(sqrt(least(1, pow(sin(radians(xlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(xlat)) * pow(sin(radians(xlon - lon) / 2), 2)))) / ((xt - pos_at) / 3.6e9) > 120 AS jump
    FROM (SELECT f.*, m.seq AS xseq, m.t AS xt, m.pos AS xpos, m.low AS xlow, m.dup AS xdup, m.pos AND m.msg_type IN ('PositionReport','StandardClassBPositionReport') AS heard, m.lat AS xlat, m.lon AS xlon, m.name AS xname, f.has_pos AND m.t < f.seen - 1000000 AND NOT m.dup AS xstale, m.rn AS rn2 FROM f JOIN m ON m.mmsi = f.mmsi AND m.rn = f.rn + 1) q) j0) j1)"""
).replace("row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS rn FROM ev)", "row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS rn, msg_type FROM ev)")


def _stamped(spark, d):
    e = events(spark, d)
    more = _messages(spark, d).join(e.select("seq", "msg_type", (F.col("k") % 9 == 0).alias("is_dup")), "seq")
    return more


@query(_STEPS_SQL + " SELECT seq, jump, CASE WHEN jump THEN false ELSE stale END AS stale, CASE WHEN jump THEN false ELSE NOT low OR coalesce(t - trusted_at < 3600000000, false) END AS corroborated, CASE WHEN NOT jump THEN name END AS name, round(CASE WHEN NOT jump THEN e_lat END, 6) AS lat FROM f WHERE NOT dup")
def win5_stamped_events(spark, d):
    """JOIN1, FLT8, WIN4, WIN13: what the fold stamps on each message, dropped copies of trusted sources counted for trust."""
    return vessels.vessel_stamps(_stamped(spark, d)).where("not is_dup").select("seq", "jump", "stale", "corroborated", F.col("v_name").alias("name"), F.round("v_lat", 6).alias("lat"))


@query(_STEPS_SQL + " SELECT mmsi, trusted_at, n FROM f QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY rn DESC) = 1")
def win4_trusted_at(spark, d):
    return vessels.vessel_fold(_stamped(spark, d)).select("mmsi", "trusted_at", "n")


@query(f" SELECT seq FROM ev WHERE (split_part(source, ':', 1) <> 'udp' OR k % 3 = 0) AND k % 4 <> 0 AND {_BOX_SQL}")
def flt4_text_feed(spark, d):
    low = F.col("source").rlike(C.LOW_TRUST)
    return subscribe.match_text_feed(events(spark, d), low, F.col("k") % 3 == 0, F.col("k") % 4 != 0, BOXES).select("seq")


@query(" SELECT seq, concat('p', user_id % 20) AS key FROM (SELECT seq, mmsi - 200000000 AS user_id, t, source FROM ev) p WHERE source <> 'aishub' AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.source = 'aishub' AND (r.mmsi - 200000000) % 20 = p.user_id % 20 AND p.t - r.t BETWEEN 0 AND 299999999)")
def flt13_not_looped(spark, d):
    rows = events(spark, d).select("seq", "t", "source", F.concat(F.lit("p"), ((F.col("mmsi") - 200_000_000) % 20).cast("string")).alias("key"))
    return subscribe.not_looped(rows.where("source != 'aishub'"), rows.where("source = 'aishub'").select("key", "t"), 5 * MIN).select("seq", "key")


@query(" SELECT mmsi, lat, lon FROM (SELECT mmsi, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM ev GROUP BY 1) WHERE mmsi IN (200000001, 200000009) OR (lat BETWEEN -60 AND 60 AND lon BETWEEN -150 AND 150)")
def flt5_vessels_asked_for(spark, d):
    last = events(spark, d).groupBy("mmsi").agg(F.max_by("lat", "seq").alias("lat"), F.max_by("lon", "seq").alias("lon")).withColumn("has_pos", F.lit(True))
    asked = subscribe.vessel_filter("-60,-150,60,150", "200000001, x, 200000009")
    nothing = subscribe.vessel_filter("0,0,0,0", None)
    return last.where(asked & ~nothing).select("mmsi", "lat", "lon")


@query(" SELECT count(*) AS n, count(*) FILTER (lat BETWEEN -60 AND 60 AND lon BETWEEN -150 AND 150) AS in_view FROM (SELECT mmsi, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon, max(t) AS t FROM ev GROUP BY 1) WHERE t >= %d" % (NOW - 3 * 1440 * MIN))
def agg13_in_view(spark, d):
    last = events(spark, d).groupBy("mmsi").agg(F.max_by("lat", "seq").alias("lat"), F.max_by("lon", "seq").alias("lon"), F.max("t").alias("t"))
    return last.where(F.col("t") >= NOW - 3 * 1440 * MIN).agg(F.count("*").alias("n"), F.count_if(C.in_box(F.col("lat"), F.col("lon"), _HOME)).alias("in_view"))


@query(" SELECT (t + i * 3600000000) // 21600000000 * 21600000000 + 0 AS x, 0 AS targets FROM ev, (SELECT unnest([0]) AS i) WHERE false UNION ALL SELECT w, count(DISTINCT mmsi) FROM (SELECT mmsi, unnest(range(t // 3600000000 - 5, t // 3600000000 + 1)) * 3600000000 AS w FROM ev) GROUP BY 1")
def agg14_targets(spark, d):
    """STR3: vessels heard in each window of six hours that begins at an hour."""
    w = F.window(F.timestamp_micros("t"), "6 hours", "1 hour")
    return events(spark, d).groupBy(F.unix_micros(w["start"]).alias("x")).agg(F.countDistinct("mmsi").alias("targets"))


@query(" SELECT source, count(*) AS events, min(t) AS first_t, max(t) AS last_t FROM ev GROUP BY 1")
def agg15_sources_seen(spark, d):
    """A row per source: their names are without bound."""
    return events(spark, d).groupBy("source").agg(F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


_KINDS_SQL = "CASE WHEN mmsi % 10 = 7 AND msg_type = 'BaseStationReport' THEN 'base' WHEN mmsi % 10 = 8 AND msg_type = 'BaseStationReport' THEN 'aton' WHEN mmsi % 10 = 9 AND msg_type = 'BaseStationReport' THEN 'sar' END"


@query(f" SELECT kind, count(*) AS vessels, count(*) FILTER (has) AS with_position, count(*) FILTER (seen >= {NOW}) AS alive FROM (SELECT mmsi, coalesce(max({_KINDS_SQL}), 'vessel') AS kind, bool_or(msg_type <> 'ShipStaticData' AND k % 5 = 0) AS has, max(t) AS seen FROM ev GROUP BY 1) GROUP BY 1")
def agg7_vessels_by_kind(spark, d):
    """Base stations, marks, aircraft and vessels, by what each of them last said it is; with their last positions."""
    last = F.col("mmsi") % 10
    base = F.col("msg_type") == "BaseStationReport"
    kind = F.when(base & (last == 8), "AidsToNavigationReport").when(base & (last == 9), "StandardSearchAndRescueAircraftReport").when(base & (last == 7), "BaseStationReport").otherwise(F.when(base, "StaticDataReport").otherwise(F.col("msg_type")))
    rows = events(spark, d).select("seq", "mmsi", "t", "lat", "lon", "sog", F.lit("kystverket").alias("source"), "station", F.lit("").alias("name"), ((F.col("msg_type") != "ShipStaticData") & (F.col("k") % 5 == 0)).alias("pos"), kind.alias("msg_type"))
    state = vessels.vessel_fold(rows)
    return state.groupBy("kind").agg(F.count("*").alias("vessels"), F.count_if("has_pos").alias("with_position"), F.count_if(F.col("seen") >= NOW).alias("alive"))


@query(""", o AS (SELECT source, seq, k % 3 = 0 AS frees, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM ev),
RECURSIVE f AS (SELECT source, rn, seq, CASE WHEN frees THEN 0 ELSE 1 END AS n, NOT frees AS granted FROM o WHERE rn = 1
  UNION ALL SELECT o.source, o.rn, o.seq, CASE WHEN frees THEN greatest(f.n - 1, 0) WHEN f.n < 8 THEN f.n + 1 ELSE f.n END, NOT frees AND f.n < 8 FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
SELECT seq, granted FROM f""")
def win9_slots(spark, d):
    """At most eight streams of an address at a time; a refused one takes no slot."""
    return folds.slots(events(spark, d), ["source"], F.col("k") % 3 == 0, 8).select("seq", "granted")


@query(""", o AS (SELECT source, seq, lat, lon, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM (SELECT source, seq, lat / 60 AS lat, lon / 60 AS lon FROM ev)),
RECURSIVE f AS (SELECT source, rn, seq, lat, lon, true AS moved FROM o WHERE rn = 1
  UNION ALL SELECT source, rn2, xseq, CASE WHEN m THEN xlat ELSE lat END, CASE WHEN m THEN xlon ELSE lon END, m FROM (SELECT f.source, f.lat, f.lon, o.lat AS xlat, o.lon AS xlon, o.seq AS xseq, o.rn AS rn2,
    6880.13::DOUBLE * asin(sqrt(least(1, pow(sin(radians(o.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - f.lon) / 2), 2)))) > 60 AS m FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1))
SELECT seq, moved FROM f""")
def win11_resubscribe(spark, d):
    """A new box when the boat is more than a quarter of its radius from the centre of the last."""
    e = events(spark, d).withColumns({"lat": F.col("lat") / 60, "lon": F.col("lon") / 60})
    return folds.moved(e, ["source"], 240.0).select("seq", "moved")


@query(", c AS (SELECT c_custkey AS sub, concat('10.', c_custkey % 4, '.', c_custkey % 250, '.7') AS ip, CASE c_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['10.1.0.0/16', '10.2.3.7'] ELSE ['10.0.0.0/9', 'junk'] END AS cidrs FROM customer) SELECT sub, sub % 3 = 0 OR (sub % 3 = 1 AND (sub % 4 = 1 OR ip = '10.2.3.7')) OR sub % 3 = 2 AS allowed FROM c")
def join8_addresses(spark, d):
    key = F.col("c_custkey")
    ip = F.concat(F.lit("10."), (key % 4).cast("string"), F.lit("."), (key % 250).cast("string"), F.lit(".7"))
    none = F.array().cast("array<string>")
    cidrs = F.when(key % 3 == 0, none).when(key % 3 == 1, F.array(F.lit("10.1.0.0/16"), F.lit("10.2.3.7"))).otherwise(F.array(F.lit("10.0.0.0/9"), F.lit("junk")))
    asked = spark.read.parquet(f"{d}/customer.parquet").select(key.alias("sub"), ip.alias("ip"), cidrs.alias("cidrs"))
    return asked.select("sub", policy.allowed_address(F.col("cidrs"), F.col("ip")).alias("allowed"))


# Addresses of both families by turns, and blocks of several lengths around them; the shorter hold the longer.
_IP_SQL = "CASE sub % 3 WHEN 0 THEN concat('10.', sub % 4, '.', sub % 250, '.7') WHEN 1 THEN concat('2001:db8:', sub % 4, '::', lower(hex(sub % 4000))) ELSE concat('::ffff:10.', sub % 4, '.', sub % 250, '.7') END"


@query(f""", c AS (SELECT c_custkey AS sub FROM customer), b AS (SELECT sub, CASE WHEN sub % 5 = 0 THEN NULL WHEN sub % 3 = 1 THEN CASE WHEN sub % 4 = 1 THEN '2001:db8:1::/48' WHEN sub % 2 = 0 THEN '2001:DB8::/32' END
  ELSE CASE WHEN sub % 4 = 1 AND sub % 250 < 128 THEN '10.1.0.0/17' WHEN sub % 4 = 1 THEN '10.1.0.0/16' WHEN sub % 2 = 0 THEN '10.0.0.0/8' END END AS cidr FROM c)
SELECT sub AS id, {_IP_SQL} AS ip, cidr FROM b WHERE cidr IS NOT NULL""")
def join8_longest_prefix(spark, d):
    """The longest block of a token that holds its sender's address; tokens without a fitting block have no row."""
    key = F.col("c_custkey")
    asked = spark.read.parquet(f"{d}/customer.parquet").select(key.alias("id"))
    ip = F.when(F.col("id") % 3 == 1, F.concat(F.lit("2001:db8:"), (F.col("id") % 4).cast("string"), F.lit("::"), F.lower(F.hex(F.col("id") % 4000)))).otherwise(F.concat(F.when(F.col("id") % 3 == 2, "::ffff:").otherwise(""), F.lit("10."), (F.col("id") % 4).cast("string"), F.lit("."), (F.col("id") % 250).cast("string"), F.lit(".7")))
    even = ["10.0.0.0/8", "2001:DB8::/32", "::/0", "junk", "10.0.0.0/33"]
    odd = ["10.1.0.0/16", "10.1.0.0/17", "2001:db8:1::/48", "2001:db8:1::/129", "fe80::/10"]
    given = F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, [x for x in even if x != "::/0"]))).otherwise(F.array(*map(F.lit, odd)))
    table = asked.where("id % 5 <> 0").select("id", F.explode(given).alias("cidr"))
    return addresses.longest_match(asked.select("id", ip.alias("ip")), table)



@query(" SELECT concat('dev/', c_custkey) AS sub FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 <> 0 AND (c_custkey % 3 <> 0) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND n_regionkey < 3", base=False)
def join9_valid_tokens(spark, d):
    """POL7: tokens of a known key, not expired, not revoked, with a proper subject."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    key = F.col("c_custkey")
    sub = F.concat(F.when(key % 5 == 0, "not allowed ").otherwise("dev/"), key.cast("string"))
    tokens = read("customer").select(sub.alias("sub"), F.col("c_nationkey").alias("kid"), F.when(key % 3 == 0, 99).when(key % 3 == 1, 0).otherwise(100).alias("exp"))
    keys = read("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("kid"))
    revoked = read("supplier").select(F.concat(F.lit("dev/"), F.col("s_suppkey").cast("string")).alias("sub"))
    return policy.valid_tokens(tokens, keys, revoked, 100).select("sub")


_ROLE_SQL = "['admin','feeder','peer','personal','partner','anonymous','nobody'][(c_custkey % 7 + 1)::INT]"


def _claims(spark, d):
    key = F.col("c_custkey")
    roles = F.array(*map(F.lit, ("admin", "feeder", "peer", "personal", "partner", "anonymous", "nobody")))
    return spark.read.parquet(f"{d}/customer.parquet").select(key.alias("sub"), F.element_at(roles, (key % 7 + 1).cast("int")).alias("role"), (key * 17 % 2000).alias("contributed"))


@query(f" SELECT sub, a AS action, role = 'admin' OR (a = 'publish' AND role IN ('feeder','peer','personal')) OR (a = 'subscribe' AND role IN ('peer','personal','partner','anonymous')) AS allowed FROM (SELECT c_custkey AS sub, {_ROLE_SQL} AS role FROM customer), (SELECT unnest(['publish','subscribe']) AS a)", base=False)
def pol1_actions(spark, d):
    asked = _claims(spark, d).withColumn("action", F.explode(F.array(F.lit("publish"), F.lit("subscribe"))))
    return policy.may(asked).select("sub", "action", "allowed")


@query(f""" SELECT sub, earned, role IN ('feeder','peer','partner','admin') OR earned AS raw, CASE tier WHEN 'personal' THEN 2 WHEN 'anonymous' THEN 2 WHEN 'feeder' THEN 5 END::INT AS conns, CASE tier WHEN 'personal' THEN 50 WHEN 'anonymous' THEN 20 WHEN 'feeder' THEN 200 END::INT AS rate,
  coalesce(CASE tier WHEN 'personal' THEN 50 WHEN 'anonymous' THEN 10 WHEN 'feeder' THEN 200 END >= sub % 100, true) AS allows_mmsis
  FROM (SELECT *, CASE WHEN earned THEN 'feeder' ELSE role END AS tier FROM (SELECT c_custkey AS sub, {_ROLE_SQL} AS role, {_ROLE_SQL} = 'personal' AND c_custkey * 17 % 2000 >= 1000 AS earned FROM customer))""", base=False)
def pol3_limits(spark, d):
    """POL2, POL3, POL6: limits of a token's tier, earned ones included."""
    limited = policy.limits(_claims(spark, d))
    mmsis = F.coalesce("mmsis", F.lit(0))
    return limited.select("sub", "earned", policy.may_raw(F.col("role"), F.col("earned")).alias("raw"), "conns", "rate", policy.allows_mmsis(mmsis, F.col("sub") % 100).alias("allows_mmsis"))


@query(_SUBS_SQL + " SELECT sub, CASE sub % 4 WHEN 0 THEN true WHEN 1 THEN sub % 2 = 0 WHEN 2 THEN 24 <= 20 + sub % 10 ELSE true END AS allowed FROM subs")
def pol5_area_rules(spark, d):
    key = F.col("sub")
    cap = F.when(key % 4 == 0, 0.0).when(key % 4 == 1, -1.0).when(key % 4 == 2, (20 + key % 10).cast("double")).otherwise(1000.0)
    area = (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))
    return _subs(spark, d).select("sub", policy.allows_area(cap, F.when(key % 2 == 0, 0).otherwise(1), area).alias("allowed"))


@query(" SELECT seq, CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS whole, CASE WHEN k % 4 = 1 THEN NULL ELSE sog END AS real, CASE WHEN seq % 2 = 0 THEN payload END AS apikey FROM ev")
def fn3_tolerant_parsing(spark, d):
    """FN21: keys of any case."""
    k = F.col("k")
    whole = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("x"))).otherwise(F.concat(k.cast("string"), F.lit(" ")))
    real = F.when(k % 4 == 1, "1.2.3").otherwise(F.col("sog").cast("string"))
    body = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(F.col("payload").alias("APIKey")))).otherwise(F.to_json(F.struct(F.col("payload").alias("Other"))))
    return events(spark, d).select("seq", F.trim(whole).try_cast("long").alias("whole"), real.try_cast("double").alias("real"), F.try_element_at(C.lower_keys(body), F.lit("apikey")).alias("apikey"))


@query(" SELECT seq, ['Under way using engine','At anchor','Not under command','Restricted manoeuvrability','Constrained by draught','Moored','Aground','Fishing','Under way sailing','HSC','WIG',NULL,NULL,NULL,'AIS-SART',NULL][(k % 16 + 1)::INT] AS status, CASE WHEN k * 10 % 520 < 511 THEN (k * 10 % 520)::DOUBLE WHEN sog < 360 THEN sog END AS heading FROM ev")
def fn20_labels(spark, d):
    k = F.col("k")
    return events(spark, d).select("seq", C.nav_label(k % 16).alias("status"), C.heading_or_course(k * 10 % 520, F.col("sog")).alias("heading"))


@query(" SELECT source, t // 1000000 * 1000000 AS second, count(*) AS events FROM ev GROUP BY ALL")
def str2_seconds(spark, d):
    w = F.window(F.timestamp_micros("t"), "1 second")
    return events(spark, d).groupBy("source", F.unix_micros(w["start"]).alias("second")).agg(F.count("*").alias("events"))


@query(" SELECT mmsi, count(*) AS sessions, max(n) AS longest FROM (SELECT mmsi, s, count(*) AS n FROM (SELECT mmsi, sum(g) OVER (PARTITION BY mmsi ORDER BY t, seq) AS s FROM (SELECT mmsi, t, seq, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi ORDER BY t, seq) < 43200000000 THEN 0 ELSE 1 END AS g FROM ev)) GROUP BY ALL) GROUP BY 1")
def str4_sessions(spark, d):
    """Runs of a vessel's messages with gaps under twelve hours."""
    one = events(spark, d).groupBy("mmsi", F.session_window(F.timestamp_micros("t"), "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return one.groupBy("mmsi").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _stream(spark, d, *columns):
    base = _scratch(spark, "stream")
    events(spark, d).select(*columns).write.parquet(f"{base}/in")
    return spark.readStream.schema(events(spark, d).select(*columns).schema).parquet(f"{base}/in"), base


@query(" SELECT t // 3600000000 * 3600000000 AS start_t, msg_type, count(*) AS events FROM ev GROUP BY ALL")
def str1_hourly_stream(spark, d):
    """Counts of each hour as a stream, with a watermark that lets finished hours go."""
    stream, base = _stream(spark, d, "t", "msg_type")
    return windows.latest(streams.run_to_end(windows.hourly_counts(stream), base, "update"), "start_t", "msg_type")


@query(" SELECT station, count(*) FILTER (k % 5 <> 0) AS events, count(*) FILTER (k % 5 = 0) AS duplicates FROM ev GROUP BY 1")
def str5_stream_stations(spark, d):
    base = _scratch(spark, "stream")
    rows = events(spark, d).select("station", (F.col("k") % 5 == 0).alias("is_dup"))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    return windows.latest(streams.run_to_end(windows.station_counts(stream), base, "update"), "station")


@query(_SUBS_SQL + " SELECT sub, min_lat, min_lon, max_lat, max_lon, CASE WHEN sub % 60 > 50 + sub % 20 THEN 'too many mmsi' END AS error FROM subs")
def flt14_normalised(spark, d):
    """Corners in any order; a claim of more than 50 vessels."""
    subs, swap = _subs(spark, d), F.col("sub") % 2 == 0
    given = subs.select("sub", *(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("min_lat", "max_lat"), ("min_lon", "max_lon"), ("max_lat", "min_lat"), ("max_lon", "min_lon"))))
    asked = subscribe.normalised(given).withColumns({"mmsis": F.array_repeat(F.lit("200000001"), (F.col("sub") % 60).cast("int")), "types": F.array(F.lit("PositionReport"))})
    return asked.select("sub", "min_lat", "min_lon", "max_lat", "max_lon", subscribe.subscription_error(50 + F.col("sub") % 20).alias("error"))


@query(_MESSAGES_SQL + " SELECT mmsi, count(*) AS n FROM m GROUP BY 1")
def str5_stream_vessels(spark, d):
    """STR6: the vessels' fold as a stream; its state is kept per vessel, and late messages are folded, not dropped."""
    base = _scratch(spark, "stream")
    rows = vessels.prepared(_messages(spark, d))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    told = streams.run_to_end(streams.stream_vessels(stream), base, "update")
    return told.groupBy("mmsi").agg((F.max("n") + F.max("n_jump")).alias("n"))


@query(_DEDUPE_SQL + " SELECT station, count(*) FILTER (NOT is_dup) AS events, count(*) FILTER (is_dup) AS duplicates FROM ev JOIN f USING (seq) GROUP BY 1")
def agg2_station_duplicates(spark, d):
    """Copies are put down to the station that lost."""
    judged = folds.dedupe(events(spark, d).select("seq", "t", "payload", "station"), ["payload"], WINDOW)
    return judged.groupBy("station").agg(F.count_if(~F.col("is_dup")).alias("events"), F.count_if("is_dup").alias("duplicates"))


@query(" SELECT mmsi, seq, lat, lon FROM ev QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY seq DESC) = 1")
def plan_last_known(spark, d):
    last = events(spark, d).groupBy("mmsi").agg(F.max_by(F.struct("seq", "lat", "lon"), "seq").alias("x"))
    return last.select("mmsi", "x.seq", "x.lat", "x.lon")


@query(f" SELECT seq, mmsi, t, lat, lon FROM ev WHERE {_BOX_SQL} AND t BETWEEN {NOW - 5 * 1440 * MIN} AND {NOW}")
def plan_history(spark, d):
    """From the table clustered by place and time: only the boxes' folders are read."""
    path = _scratch(spark, "positions")
    positions.write(events(spark, d).select("seq", "mmsi", "t", "lat", "lon"), path)
    return positions.read(spark, path, BOXES, NOW - 5 * 1440 * MIN, NOW).select("seq", "mmsi", "t", "lat", "lon")
