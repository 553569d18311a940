"""Queries of the feed adapters, the parsing rules and the renderers, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.catalog import _LICENSE_SQL, _XOR_SQL, MIN, NOW, _scratch, query
from tidewatch.functions import columns as C
from tidewatch.operators import folds, stations, vessels
from tidewatch.plans import chain
from tidewatch.plans.adapt import events, spread
from tidewatch.plans.scratch import written
from tidewatch.sources import codec, feeds, formats, render

_HMAC_SQL = "substr(sha256(unhex(concat('%s', sha256(unhex(concat('%s', hex({0}))))))), 1, 12)" % tuple(bytes(b ^ p for b in b"salt".ljust(64, b"\0")).hex() for p in (0x5C, 0x36))
#: A position as a type 1 message holds it.
_HELD_SQL = "round(round(lon * 600000) / 600000, 6) AS lon, round(round(lat * 600000) / 600000, 6) AS lat"
_held = lambda *names: [F.round(c, 6).alias(c) for c in names]


@query(f" SELECT seq, concat('udp:', {_HMAC_SQL.format('concat(chr(49), mmsi)')}) AS source, line FROM (SELECT seq, mmsi, unnest([payload, station]) AS line FROM ev)")
def src2_datagrams(spark, d):
    body = F.concat("payload", F.lit("\n"), "station", F.lit(" \r\n\n"))
    return feeds.datagrams(events(spark, d).select("seq", F.concat(F.lit("1"), "mmsi").alias("ip"), body.alias("body")), b"salt")


@query(" SELECT seq, 'http:st1' AS source, CASE WHEN seq % 2 = 0 THEN t // 1000000 * 1000000 END AS source_t, concat('!', n, payload) AS line FROM ev, (SELECT unnest(['1','2']) AS n)")
def src4_http_bodies(spark, d):
    lines = F.array(F.concat(F.lit("!1"), "payload"), F.concat(F.lit("!2"), "payload"))
    told = F.to_json(F.struct(F.array(F.struct(lines.alias("nmea"), F.date_format(F.timestamp_micros("t"), "yyyyMMddHHmmss").alias("rxtime"))).alias("msgs")))
    body = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" "), told)).otherwise(F.concat_ws("\n", lines))
    return feeds.http_bodies(events(spark, d).select("seq", F.lit("st1").alias("sub"), body.alias("body")))


@query(" SELECT CASE WHEN length(repeat(payload, (k % 9 + 1)::INT)) > 64 THEN 413 ELSE 202 END AS status, count(*) AS n FROM ev GROUP BY 1")
def src5_size_limit(spark, d):
    body = F.expr("repeat(payload, int(k % 9 + 1))")
    return events(spark, d).groupBy(feeds.status(body, 64).alias("status")).agg(F.count("*").alias("n"))


def _frames(spark, d):
    e = events(spark, d)
    many = F.transform(F.sequence(F.lit(1), (F.col("k") % 5 + 1).cast("int")), lambda i: F.concat("payload", F.lit("/"), i.cast("string")))
    kind = F.when(F.col("seq") % 7 == 0, "subscribe").otherwise("publish")
    return e.select("seq", F.to_json(F.struct(kind.alias("type"), many.alias("nmea"), (F.col("k") % 2 == 0).alias("replay"))).alias("body"))


@query(" SELECT seq, k % 2 = 0 AS buffered, i AS pos, concat(payload, '/', i + 1) AS line FROM ev, (SELECT unnest([0, 1, 2]) AS i) WHERE seq % 7 <> 0 AND i <= k % 5")
def src6_publish_frames(spark, d):
    """LIM2: the first three sentences of a frame."""
    return feeds.frames(_frames(spark, d), 3).select("seq", "buffered", F.posexplode("accepted").alias("pos", "line"))


@query(" SELECT seq, concat('{\"type\":\"ack\",\"n\":', least(3, k % 5 + 1), '}') AS ack FROM ev WHERE seq % 7 <> 0")
def snk13_acknowledgements(spark, d):
    return feeds.frames(_frames(spark, d), 3).select("seq", feeds.acknowledgement(F.col("accepted")).alias("ack"))


def _topics(spark, d, kind):
    e = events(spark, d)
    mmsi = F.when(F.col("seq") % 11 == 0, "x").otherwise(F.col("mmsi").cast("string"))
    told = F.floor((F.col("t") + (F.col("seq") % 3) * 20_000_000) / 1_000_000)
    if kind == "location":
        body = F.to_json(F.struct(told.alias("time"), F.least("sog", F.lit(102.2)).alias("sog"), F.lit(1.5).alias("cog"), (F.col("k") % 9).alias("navStat"), F.lit(0).alias("rot"), F.lit(True).alias("posAcc"), F.lit(False).alias("raim"), (F.col("k") % 360).alias("heading"), "lon", "lat"))
    else:
        body = F.to_json(F.struct((told * 1000).alias("timestamp"), F.lit("PORT").alias("destination"), F.concat(F.lit("V"), F.col("k").cast("string")).alias("name"), (F.col("k") % 200).alias("draught"), (F.col("seq") * 733 % 1_000_000).alias("eta"), F.lit(1).alias("posType"), F.lit(9).alias("refA"), F.lit(8).alias("refB"), F.lit(7).alias("refC"), F.lit(6).alias("refD"), F.lit("CS").alias("callSign"), (F.col("seq") + 5).alias("imo"), (F.col("k") % 100).alias("type")))
    body = F.when(F.col("seq") % 13 == 0, "{broken").otherwise(body)
    return feeds.topics(e.select("seq", F.col("t").alias("recv_t"), F.concat(F.lit("vessels-v2/"), mmsi, F.lit(f"/{kind}")).alias("topic"), body.alias("body")))


_TOLD_SQL = "CASE WHEN abs((t + seq % 3 * 20000000) // 1000000 * 1000000 - t) <= 30000000 THEN (t + seq % 3 * 20000000) // 1000000 * 1000000 ELSE t END AS t"


@query(f" SELECT seq, mmsi, {_TOLD_SQL}, {_HELD_SQL}, round(round(least(sog, 102.2) * 10) / 10, 6) AS sog, k % 9 AS nav_status, k % 360 AS heading FROM ev WHERE seq % 11 <> 0 AND seq % 13 <> 0")
def src7_locations(spark, d):
    """TIME3 and PAR10: a time near the receipt counts; the fields are encoded and decoded again."""
    told = feeds.locations(_topics(spark, d, "location"))
    rows = told.withColumns({"source": F.lit("digitraffic"), "station": F.lit("digitraffic")})
    made = chain.synthesized(rows, 1, {c: F.col(c) for c in ("mmsi", "lat", "lon", "sog", "cog", "heading", "nav_status", "rot", "accuracy", "raim", "second")})
    return made.select("seq", "mmsi", "t", *_held("lon", "lat", "sog"), "nav_status", "heading")


@query(f""" SELECT seq, mmsi, {_TOLD_SQL}, concat('V', k) AS name, 'CS' AS callsign, seq + 5 AS imo, k % 100 AS ship_type, round(k % 200 / 10.0::DOUBLE, 6) AS draught, ((seq * 733 % 1000000) >> 16) & 15 AS eta_month, ((seq * 733 % 1000000) >> 11) & 31 AS eta_day,
  ((seq * 733 % 1000000) >> 6) & 31 AS eta_hour, (seq * 733 % 1000000) & 63 AS eta_minute FROM ev WHERE seq % 11 <> 0 AND seq % 13 <> 0""")
def src8_metadata(spark, d):
    told = feeds.metadata(_topics(spark, d, "metadata"))
    coded = codec.encoded(told, 5, {c: F.col(c) for c in ("mmsi", "name", "callsign", "imo", "ship_type", "destination", "draught", "to_bow", "to_stern", "to_port", "to_starboard", "fix", "eta_month", "eta_day", "eta_hour", "eta_minute")})
    kept = codec.decoded(coded.select("seq", "t", "payload", "fill"))
    return kept.select("seq", "mmsi", "t", "name", "callsign", "imo", "ship_type", *_held("draught"), "eta_month", "eta_day", "eta_hour", "eta_minute")


@query(" SELECT seq, msg_type, mmsi, CASE WHEN seq % 9 = 0 THEN t + 1 ELSE t // 1000 * 1000 END AS t, lat, lon FROM (SELECT *, msg_type AS x FROM ev) WHERE k % 10 <> 0 ")
def src9_envelopes(spark, d):
    e = events(spark, d)
    kind = F.when(F.col("k") % 10 == 0, "UnknownMessage").otherwise(F.col("msg_type"))
    written = F.concat(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +0000 UTC"))
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.when(F.col("seq") % 9 == 0, "soon").otherwise(written).alias("time_utc"))
    fields = F.struct(F.col("mmsi").alias("UserID"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"))
    body = F.to_json(F.struct(kind.alias("MessageType"), meta.alias("MetaData"), F.create_map(kind, fields).alias("Message")))
    return feeds.envelopes(e.select("seq", (F.col("t") + 1).alias("recv_t"), body.alias("body"))).select("seq", "msg_type", "mmsi", "t", "lat", "lon")


@query(" SELECT seq, mmsi, CASE WHEN k % 3 = 0 THEN t ELSE k * 1000000 + 1000000 END AS t, concat('V', k) AS name, seq AS imo, k % 100 AS ship_type, round(k % 250 / 10.0::DOUBLE, 6) AS draught, ((seq * 733 % 1000000) >> 16) & 15 AS eta_month, round((k * 7 % 3600) / 10.0::DOUBLE, 6) AS cog, k % 16 AS nav_status FROM ev")
def src10_snapshot_fields(spark, d):
    k = F.col("k")
    row = F.struct(F.col("mmsi").alias("MMSI"), F.col("seq").alias("SEQ"), F.when(k % 3 == 0, "n/a").otherwise((k + 1).cast("string")).alias("TIME"), F.concat(F.lit("V"), k.cast("string")).alias("NAME"), F.col("seq").alias("IMO"), (k % 100).alias("TYPE"), (k % 250).alias("DRAUGHT"), (F.col("seq") * 733 % 1_000_000).alias("ETA"), (k * 7 % 3600).alias("COG"), (k % 16).alias("NAVSTAT"))
    body = F.concat(F.lit('[{"ERROR":false},'), F.to_json(F.array(row)), F.lit("]"))
    rows = formats.snapshot_rows(events(spark, d).select(F.col("t").alias("recv_t"), body.alias("body")))
    return rows.select("seq", "mmsi", "t", "name", "imo", F.col("ship_type").cast("long").alias("ship_type"), *_held("draught"), "eta_month", *_held("cog"), F.col("nav_status").cast("long").alias("nav_status"))


@query(" SELECT source, seq, k FROM (SELECT source, seq, k, lag(k) OVER (PARTITION BY source ORDER BY seq) AS p, row_number() OVER (PARTITION BY source ORDER BY seq) AS r FROM (SELECT source, seq, k % 3 AS k FROM ev)) WHERE r = 1 OR k <> p")
def src11_same_body(spark, d):
    polls = events(spark, d).select("source", "seq", (F.col("k") % 3).cast("string").alias("body"))
    return feeds.unlike_last(polls).select("source", "seq", F.col("body").cast("long").alias("k"))


@query(" SELECT seq, hour * 3600000000 + 2700000000 * (row_number() OVER (PARTITION BY hour ORDER BY seq) - 1) // count(*) OVER (PARTITION BY hour) AS emit_t FROM (SELECT seq, t // 3600000000 AS hour FROM ev)")
def src12_paced(spark, d):
    rows = events(spark, d).select("seq", F.floor(F.col("t") / stations.HOUR_US).alias("hour"))
    return feeds.paced(rows, "hour", F.col("hour") * stations.HOUR_US, 45 * MIN).select("seq", "emit_t")


@query(" SELECT seq, k % 3 = 1 AS own, concat('!AIVD', CASE WHEN k % 3 = 1 THEN 'O' ELSE 'M' END, ',', payload) AS line FROM ev WHERE k % 3 <> 0")
def src16_bus_sentences(spark, d):
    """PAR13."""
    k = F.col("k") % 3
    line = F.concat(F.when(k == 0, "$GPGGA,").when(k == 1, "\\c:1*52\\!AIVDO,").otherwise("!AIVDM,"), "payload")
    return feeds.bus_sentences(events(spark, d).select("seq", line.alias("line"))).select("seq", "own", "line")


@query(""" SELECT seq, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 18 ELSE 5 END::INT AS type, mmsi, round(sog * 1.9438444924574, 6) AS sog, floor(degrees(k / 20.0::DOUBLE) + 0.5)::BIGINT AS cog, CASE WHEN seq % 3 <> 0 THEN (k + 30 - k)::BIGINT END AS to_stern,
  round(sign(k - 40) * 4.733 * sqrt(abs(degrees((k - 40) / 1000.0::DOUBLE) * 60)), 6) AS rot FROM ev WHERE k % 4 <> 3 AND mmsi % 50 <> 0""")
def src17_bus_messages(spark, d):
    """FN16, FN17, FN18."""
    k = F.col("k")
    rows = events(spark, d).select(
        "seq", F.when(k % 4 == 0, 129038).when(k % 4 == 1, 129039).when(k % 4 == 2, 129794).otherwise(127250).alias("pgn"), F.when(F.col("mmsi") % 50 != 0, F.col("mmsi")).otherwise(0).alias("mmsi"), "sog", (k / 20.0).alias("cog"),
        F.lit(None).cast("double").alias("heading"), ((k - 40) / 1000.0).alias("rot"), k.alias("bow"), F.when(F.col("seq") % 3 != 0, k + 30).alias("length"), k.alias("starboard"), k.alias("beam"),
    )
    return feeds.bus_messages(rows).select("seq", "type", "mmsi", F.round("sog", 6).alias("sog"), "cog", F.round("rot", 6).alias("rot"), "to_stern")


@query(" SELECT seq, CASE WHEN seq % 3 = 0 THEN concat('\\s:x*2A\\', payload) ELSE concat('\\', tag, '*', " + _XOR_SQL.format("tag") + ", '\\', payload) END AS line FROM (SELECT seq, payload, concat(CASE WHEN k % 2 = 0 THEN concat('s:st', k, ',') ELSE '' END, 'c:', t // 1000) AS tag FROM ev)")
def par14_tagged(spark, d):
    line = F.concat(F.when(F.col("seq") % 3 == 0, "\\s:x*2A\\").otherwise(""), "payload")
    station = F.when(F.col("k") % 2 == 0, F.concat(F.lit("st"), F.col("k").cast("string")))
    return events(spark, d).select("seq", feeds.tagged(line, station, F.floor(F.col("t") / 1000)).alias("line"))


@query(" SELECT seq, CASE WHEN k % 4 = 0 OR k % 4 = 1 OR k <= 0 THEN t ELSE k * 1000000 END AS t FROM ev")
def time5_row_time(spark, d):
    told = F.when(F.col("k") % 4 == 0, "n/a").when(F.col("k") % 4 == 1, "-5").otherwise(F.col("k").cast("string"))
    return events(spark, d).select("seq", feeds.row_time(told, F.col("t")).alias("t"))


@query(" SELECT seq, mmsi FROM (SELECT seq, mmsi, f, lag(f) OVER (PARTITION BY mmsi ORDER BY seq) AS p, row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS r FROM (SELECT seq, mmsi, concat_ws('|', CASE WHEN k % 6 = 0 THEN 'V' ELSE '' END, 'CS', CASE WHEN k % 2 = 0 THEN '0' ELSE '7' END, (k % 3)::VARCHAR, '') AS f, k FROM ev) WHERE k % 6 = 0 OR k % 2 = 1) WHERE r = 1 OR f <> p")
def flt11_static_changes(spark, d):
    """FN13: a vessel's static fields, when they differ from the last ones told."""
    k = F.col("k")
    rows = events(spark, d).select("seq", "mmsi", F.when(k % 6 == 0, "V").otherwise("").alias("name"), F.lit("CS").alias("callsign"), F.when(k % 2 == 0, 0).otherwise(7).alias("imo"), (k % 3).alias("ship_type"), F.lit(None).cast("string").alias("destination"))
    return feeds.static_changes(rows).select("seq", "mmsi")


def _lines(spark, d):
    """Events as TAG-prefixed sentences of several kinds, some of them broken, some buffered."""
    e = spread(events(spark, d)).withColumn("sog", F.least("sog", F.lit(102.2)))
    coded = codec.encoded(e, 1, {c: F.col(c) for c in ("mmsi", "lat", "lon", "sog")}, F.when(F.col("seq") % 2 == 0, "C").otherwise("B"))
    tag = C.tag_block([("s", F.when(F.col("seq") % 5 != 0, C.tag_safe(F.col("station")))), ("c", F.floor((F.col("t") - (F.col("seq") % 4) * 40_000_000) / 1_000_000).cast("string"))])
    line = F.element_at("nmea", 1)
    body = F.when(F.col("seq") % 17 == 0, F.concat(F.lit("x"), line)).when(F.col("seq") % 19 == 0, "$GPGLL,1*4D").otherwise(F.concat(tag, line))
    return coded.select("seq", "source", F.col("source").alias("station"), F.col("t").alias("recv_t"), (F.col("k") % 2 == 0).alias("buffered"), body.alias("body"))


_OUTCOME_SQL = "CASE WHEN seq % 17 = 0 THEN 'parse_err' WHEN seq % 19 = 0 THEN 'ignored' WHEN k % 2 = 0 AND t - (t - seq % 4 * 40000000) // 1000000 * 1000000 > 60000000 THEN 'replayed' ELSE 'ok' END"


@query(f" SELECT {_OUTCOME_SQL} AS outcome, CASE WHEN seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 5 <> 0 THEN concat(source, '/', right(replace(station, ':', '_'), 15)) ELSE source END AS station, count(*) AS n FROM ev GROUP BY ALL")
def par5_line_outcomes(spark, d):
    """PAR1, PAR3 to PAR6, STR7: what becomes of each line, and the station that it is put down to."""
    return chain.judged_lines(_lines(spark, d)).groupBy("outcome", "station").agg(F.count("*").alias("n"))


@query(f""" SELECT seq, mmsi, CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS channel, 'PositionReport' AS msg_type, {_HELD_SQL}, round(round(least(sog, 102.2) * 10) / 10, 6) AS sog,
  CASE WHEN abs((t - seq % 4 * 40000000) // 1000000 * 1000000 - t) <= 30000000 THEN (t - seq % 4 * 40000000) // 1000000 * 1000000 ELSE t END AS t FROM ev WHERE {_OUTCOME_SQL} = 'ok'""")
def par9_messages(spark, d):
    """PAR7 to PAR9, PAR11, PAR12: lines to messages with their canonical time."""
    told = chain.messages(chain.judged_lines(_lines(spark, d)))
    return told.select("seq", "mmsi", "channel", "msg_type", *_held("lon", "lat", "sog"), "t")


def _type_query(number, name):
    """A query for each layout: the events told as messages of that type, split into sentences, put together and decoded."""
    own = {n for n, *_ in codec.LAYOUTS[number]} | ({n for n, *_ in codec._STATIC[1]} if number == 24 else set())
    scale = {27: 600}.get(number, 600000)
    sql = {
        "lat": f"round(round(lat * {scale}) / {scale}, 6)", "lon": f"round(round(lon * {scale}) / {scale}, 6)", "name": "concat('V ', k)", "ship_type": "k % 100", "aid_type": "k % 30", "callsign": "concat('C', k % 1000)", "imo": "seq", "heading": "seq % 360",
        "altitude": "seq % 4000", "to_bow": "seq % 500", "year": "2000 + seq % 50", "nav_status": "seq % 15", "second": "seq % 60",
    }
    shown = [n for n in sql if n in own]

    def values(name):
        if name in ("lat", "lon"):
            return F.col(name)
        return F.expr(sql[name])

    def run(spark, d):
        e = spread(events(spark, d)).select("seq", "source", "station", "t", "mmsi", *(values(n).alias(f"_{n}") for n in shown))
        made = codec.encoded(e, number, {"mmsi": F.col("mmsi")} | {n: F.col(f"_{n}") for n in shown}, F.lit("B"), part=1)
        lines = made.select((F.col("seq") * 4).alias("n"), "source", F.concat("source", F.lit("/"), (F.col("seq") % 97).cast("string")).alias("station"), F.col("t").alias("recv_t"), F.posexplode("nmea").alias("i", "body"))
        parsed = formats.parse(lines.select((F.col("n") + F.col("i")).alias("seq"), "source", "station", "recv_t", "body"))
        # sentences are read three times: those alone, fragments, and the count of all
        told = codec.decoded(formats.assemble(written(parsed.where("ok"), "lines")), shown).where(F.col("type") == number)
        return told.select(F.floor(F.col("seq") / 4).alias("seq"), "type", "mmsi", *(F.round(n, 6).alias(n) if n in ("lat", "lon") else F.col(n) for n in shown))

    run.__name__ = name
    query(f" SELECT seq, {number}::BIGINT AS type, mmsi" + "".join(f", {sql[n]} AS {n}" for n in shown) + " FROM ev")(run)


for _number, _name in ((4, "base_stations"), (5, "ship_static"), (9, "rescue_aircraft"), (18, "class_b"), (19, "extended_class_b"), (21, "aids"), (24, "static_part_b"), (27, "long_range")):
    _type_query(_number, f"par9_type{_number}_{_name}")


_NUM_SQL = "CASE WHEN {0} = floor({0}) THEN ({0})::BIGINT::VARCHAR ELSE ({0})::VARCHAR END"


def _positions(spark, d):
    """Events as decoded position reports with the columns that the renderers read."""
    fixed = {"comm_state": 0, "type": 1, "nav_status": 0, "accuracy": 0, "raim": 1, "rot": -128, "repeat": 0, "manoeuvre": 0, "heading": 511}
    e = events(spark, d).select("*", F.lit(36.7).alias("cog"), (F.col("seq") % 60).alias("second"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    return e.withColumns({"v_name": F.concat(F.lit('V"'), F.col("k").cast("string")), "v_lat": F.col("lat"), "v_lon": F.col("lon"), "v_has_pos": F.col("k") % 2 == 0, "id": F.sha2("payload", 256), "channel": F.lit("A"), "synthesized": F.col("k") % 3 == 0, "nmea": F.array("payload")})


_MESSAGE_SQL = "concat('{\"Cog\":36.7,\"CommunicationState\":0,\"Latitude\":', %s, ',\"Longitude\":', %s, ',\"MessageID\":1,\"NavigationalStatus\":0,\"PositionAccuracy\":false,\"Raim\":true,\"RateOfTurn\":-128,\"RepeatIndicator\":0,\"Sog\":', %s, ',\"Spare\":0,\"SpecialManoeuvreIndicator\":0,\"Timestamp\":', seq %% 60, ',\"TrueHeading\":511,\"UserID\":', mmsi, ',\"Valid\":true}')" % tuple(_NUM_SQL.format(c) for c in ("lat", "lon", "sog"))
_ISO_SQL = "concat(strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S'), CASE WHEN {0} % 1000000 = 0 THEN '' ELSE concat('.', rtrim(lpad(({0} % 1000000)::VARCHAR, 6, '0'), '0')) END, 'Z')"


@query(" SELECT seq, concat('{\"Message\":{\"PositionReport\":', " + _MESSAGE_SQL + ", '},\"MessageType\":\"PositionReport\",\"MetaData\":{\"MMSI\":', mmsi, ',\"MMSI_String\":', mmsi, ',\"ShipName\":\"V\\\"', k, '\",\"latitude\":', " + _NUM_SQL.format("lat") + ", ',\"longitude\":', " + _NUM_SQL.format("lon") + ", ',\"time_utc\":\"', replace(replace(" + _ISO_SQL.format("t") + ", 'T', ' '), 'Z', ''), ' +0000 UTC\"}}') AS envelope FROM ev")
def snk4_envelopes(spark, d):
    """ORD3: keys in byte order."""
    return _positions(spark, d).select("seq", render.envelope().alias("envelope"))


@query(" SELECT seq, concat('{\"type\":\"event\",\"id\":\"', sha256(payload), '\",\"time\":\"', " + _ISO_SQL.format("t") + ", '\",\"source\":\"', source, '\",\"station\":\"', station, '\",\"channel\":\"', CASE WHEN k % 3 = 0 THEN '' ELSE 'A' END, '\",\"nmea\":[\"', payload, '\"],\"mmsi\":', mmsi, ',\"msg_type\":\"', msg_type, '\"', CASE WHEN k % 2 = 0 THEN concat(',\"lat\":', " + _NUM_SQL.format("lat") + ", ',\"lon\":', " + _NUM_SQL.format("lon") + ") ELSE '' END, ',\"message\":', " + _MESSAGE_SQL + ", ',\"synthesized\":', k % 3 = 0, '}') AS event FROM ev")
def snk5_events(spark, d):
    return _positions(spark, d).select("seq", render.event(render.message("PositionReport")).alias("event"))


@query(" SELECT seq, concat(b, payload, chr(13), chr(10), b, '!x', chr(13), chr(10)) AS text FROM (SELECT seq, payload, concat('\\', tag, '*', " + _XOR_SQL.format("tag") + ", '\\') AS b FROM (SELECT seq, payload, concat('s:', right(replace(station, ':', '_'), 15), ',c:', t // 1000000, ',t:', " + _LICENSE_SQL.format("source") + ") AS tag FROM ev))")
def snk6_texts(spark, d):
    lines = F.array(F.concat(F.lit("\\s:old*00\\"), "payload"), F.lit("!x"))
    return events(spark, d).select("seq", render.tagged_text(F.col("station"), F.col("t"), C.license_of(F.col("source")), lines).alias("text"))


_LAST_SQL = ", v AS (SELECT mmsi, max(seq) AS seq FROM ev GROUP BY 1), w AS (SELECT ev.*, concat('{\"geometry\":{\"coordinates\":[', " + _NUM_SQL.format("lon") + ", ',', " + _NUM_SQL.format("lat") + ", '],\"type\":\"Point\"},\"id\":', mmsi, ',\"properties\":{\"cog\":36.7,\"kind\":\"vessel\",\"mmsi\":', mmsi, ',\"msg_type\":\"', msg_type, '\"', CASE WHEN k % 2 = 0 THEN concat(',\"name\":\"V', k, '\"') ELSE '' END, ',\"seen\":\"', strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%SZ'), '\"', CASE WHEN sog < 102.3 THEN concat(',\"sog\":', " + _NUM_SQL.format("sog") + ") ELSE '' END, ',\"source\":\"', source, '\",\"station\":\"', station, '\"', CASE WHEN k % 10 <> 0 THEN concat(',\"type\":', k % 10) ELSE '' END, '},\"type\":\"Feature\"}') AS feature FROM ev JOIN v USING (mmsi, seq))"


def _states(spark, d):
    """Vessels as the state that their last event leaves."""
    e = events(spark, d)
    last = e.groupBy("mmsi").agg(F.max_by(F.struct("seq", "lat", "lon", "sog", "k", "t", "msg_type", "source", "station"), "seq").alias("x")).select("mmsi", "x.*")
    return last.select("*", F.lit(36.7).alias("cog"), F.lit(511).alias("heading"), F.lit("vessel").alias("kind"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("V"), F.col("k").cast("string"))).alias("name"), F.lit(15).alias("nav_status"), F.col("t").alias("seen"), (F.col("k") % 10).alias("ship_type"), (F.col("k") % 4 != 0).alias("has_pos"))


@query(_LAST_SQL + " SELECT mmsi, feature FROM w")
def snk7_features(spark, d):
    return _states(spark, d).select("mmsi", render.feature().alias("feature"))


@query(_LAST_SQL + ", s AS (SELECT station, count(*) AS n FROM ev GROUP BY 1), f AS (SELECT station, string_agg(feature, ',' ORDER BY feature) AS fs FROM w WHERE k % 4 <> 0 GROUP BY 1) SELECT s.station, concat('{\"features\":[', coalesce(fs, ''), '],\"type\":\"FeatureCollection\"}') AS vessels FROM s LEFT JOIN f USING (station)")
def snk9_station_vessels(spark, d):
    stations_ = events(spark, d).groupBy("station").agg(F.count("*").alias("n"))
    here = _states(spark, d).where("has_pos").groupBy("station").agg(F.array_sort(F.collect_list(render.feature())).alias("f"))
    return stations_.join(here, "station", "left").select("station", render.collection(F.coalesce("f", F.array().cast("array<string>"))).alias("vessels"))


def _station_rows(spark, d):
    judged = events(spark, d).withColumn("is_dup", F.col("k") % 5 == 0)
    counted = stations.station_stats(judged).join(judged.where("not is_dup").groupBy("station").agg(F.countDistinct("mmsi").alias("vessels")), "station", "left")
    return counted.withColumns({"source": F.substring_index("station", "/", 1), "vessels": F.coalesce("vessels", F.lit(0))})


_STATION_SQL = """, s AS (SELECT station, split_part(station, '/', 1) AS source, count(*) FILTER (k % 5 <> 0) AS e, count(*) FILTER (k % 5 = 0) AS du, count(DISTINCT mmsi) FILTER (k % 5 <> 0) AS v, count(*) FILTER (k % 5 <> 0 AND msg_type IN ('PositionReport','StandardClassBPositionReport')) AS p, arg_min(t, seq) AS a, arg_max(t, seq) AS z,
  min(lat) FILTER (k % 5 <> 0 AND msg_type IN ('PositionReport','StandardClassBPositionReport')) AS b1, min(lon) FILTER (k % 5 <> 0 AND msg_type IN ('PositionReport','StandardClassBPositionReport')) AS b2, max(lat) FILTER (k % 5 <> 0 AND msg_type IN ('PositionReport','StandardClassBPositionReport')) AS b3, max(lon) FILTER (k % 5 <> 0 AND msg_type IN ('PositionReport','StandardClassBPositionReport')) AS b4 FROM ev GROUP BY 1)"""


@query(_STATION_SQL + " SELECT station, concat('{\"station\":\"', station, '\",\"source\":\"', source, '\",\"events\":', e, ',\"duplicates\":', du, ',\"vessels\":', v, ',\"positions\":', p, ',\"first_seen\":\"', " + _ISO_SQL.format("a") + ", '\",\"last_seen\":\"', " + _ISO_SQL.format("z") + f", '\",\"last_age_s\":', ({NOW} - z) // 1000000, ',\"bbox\":', CASE WHEN p > 0 THEN concat('[', " + ", ',', ".join(_NUM_SQL.format(f"b{i}") for i in range(1, 5)) + ", ']') ELSE 'null' END, '}') AS line FROM s ORDER BY station")
def snk8_station_lines(spark, d):
    """ORD1: by station."""
    return _station_rows(spark, d).select("station", render.station_row(NOW).alias("line")).orderBy("station")


@query(f"""{_STATION_SQL} SELECT concat('{{"stations":{{"total":', (SELECT count(*) FROM s), ',"active":', (SELECT count(*) FROM s WHERE {NOW} - z < 300000000), ',"by_source":{{', (SELECT string_agg(concat('"', kind, '":', n), ',' ORDER BY kind) FROM (SELECT split_part(source, ':', 1) AS kind, count(*) AS n FROM s GROUP BY 1)), '}}}},"vessels":{{"total":', (SELECT count(DISTINCT mmsi) FROM ev),
  '}},"events":{{"total":', (SELECT count(*) FROM ev WHERE k % 5 <> 0), ',"duplicates":', (SELECT count(*) FROM ev WHERE k % 5 = 0), '}}}}') AS stats""")
def snk10_stats(spark, d):
    """One line of totals; only counts by kind of source meet in it."""
    rows = _station_rows(spark, d)
    kinds = rows.groupBy(C.source_kind(F.col("source")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(NOW - F.col("last_t") < 5 * MIN).alias("active"))
    total = kinds.agg(F.sum("n").alias("n"), F.sum("active").alias("active"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    e = events(spark, d).agg(F.countDistinct("mmsi").alias("vessels"), F.count_if(F.col("k") % 5 != 0).alias("events"), F.count_if(F.col("k") % 5 == 0).alias("duplicates"))
    by = F.concat(F.lit("{"), F.array_join(F.transform("kinds", lambda x: F.concat(render.text(x["kind"]), F.lit(":"), x["n"].cast("string"))), ","), F.lit("}"))
    text = lambda c: F.col(c).cast("string")
    one = total.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one")
    return one.select(render.record(("stations", render.record(("total", F.col("n").cast("string")), ("active", text("active")), ("by_source", by))), ("vessels", render.record(("total", text("vessels")))), ("events", render.record(("total", text("events")), ("duplicates", text("duplicates"))))).alias("stats"))


@query(""" SELECT station, count(*) AS events FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS r FROM ev) WHERE seq % 2 = 0 AND split_part(source, ':', 1) IN ('http', 'v1') GROUP BY 1""")
def snk12_upstream(spark, d):
    """FLT7, FLT8: what may be fed on: of a feeding source, not synthesized, and borne out."""
    e = events(spark, d).withColumn("synthesized", F.col("seq") % 2 == 1)
    low = F.col("source").rlike(C.LOW_TRUST)
    fed = e.where(F.col("source").rlike(C.FEEDABLE) & ~F.col("synthesized") & vessels.corroborated(low, F.col("t"), F.lit(None).cast("long")))
    return fed.groupBy("station").agg(F.count("*").alias("events"))


@query(""" SELECT seq, concat('{"$source":"net","timestamp":"', strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%SZ'), '","mmsi":', mmsi, '}') AS delta FROM ev n WHERE source <> 'udp:ab' AND mmsi <> 200000001 AND NOT (msg_type IN ('PositionReport','StandardClassBPositionReport') AND k % 7 = 0)
  AND NOT EXISTS (SELECT 1 FROM ev l WHERE l.source = 'udp:ab' AND l.mmsi = n.mmsi AND n.t - l.t BETWEEN 0 AND 3599999999)""")
def snk14_deltas(spark, d):
    """FLT12, JOIN5: what is shown on board: not the own source or vessel, no rejected position, and no target that the own receiver has just heard."""
    from tidewatch.operators import subscribe

    e = events(spark, d)
    shown = subscribe.shown_on_board(e.withColumn("lat", F.when(F.col("k") % 7 != 0, F.col("lat"))), "udp:ab", 200_000_001)
    fresh = subscribe.quiet_targets(shown, e.where("source = 'udp:ab'"), 60 * MIN)
    return fresh.select("seq", render.record(("$source", F.lit('"net"')), ("timestamp", render.text(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))), ("mmsi", C.json_number(F.col("mmsi")))).alias("delta"))
