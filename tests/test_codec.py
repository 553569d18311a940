"""Messages against the values that public sample sentences are annotated with, and the codec against itself on random values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import codec, formats

# Fixed values of the protocol's public samples.
GOLDEN = "!AIVDM,1,1,,A,13HOI:0P0000VOHLCnHQKwvL05Ip,0*23"


def parsed(spark, lines, **more):
    rows = [(i, "udp:a", "udp:a", 1_418_169_601_000_000, x) for i, x in enumerate(lines)]
    return formats.parse(spark.createDataFrame(rows, "seq long, source string, station string, recv_t long, body string"))


def test_position_report(spark):
    (r,) = codec.decoded(parsed(spark, [GOLDEN]), ids=True).collect()
    want = {"type": 1, "repeat": 0, "mmsi": 227006760, "nav_status": 0, "rot": -128, "sog": 0.0, "accuracy": 0, "lon": 0.13138, "lat": 49.47557666666667, "cog": 36.7, "heading": 511, "second": 14, "manoeuvre": 0, "raim": 0, "comm_state": 22136, "id": "e5b8515ec5096227cdc97b0c71a470fd"}
    assert {k: r[k] for k in want} == want and r.name is None


def test_event_id(spark):
    (r,) = codec.decoded(parsed(spark, ["!AIVDM,1,1,,A,H42O55lti4hhhilD3nink000?050,0*40"]), ids=True).collect()
    assert (r.id, r.mmsi, r.callsign, r.ship_type, r.part) == ("381c250991f87733bb5080209c16904d", 271041815, "TC6163", 60, 1)


def test_parse_outcomes(spark):
    lines = [
        GOLDEN, "  " + GOLDEN + "\r", GOLDEN[:-2] + "24", "", "   ", "$GPGGA,1*4E", "junk", "\\c:12x,s:here,s:there*65\\" + GOLDEN, "\\s:2573010,c:1787234980*03\\!BSVDM,1,1,,B,13noH:00000H@P@RSPEakGK@0D33,0*43", "\\s:1*00\\" + GOLDEN,
        "!AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A,b003660465", "!AIVDM,x,1,,A,1,0*6A", "!AIVDO,1,1,,A,13HOI:0P0000VOHLCnHQKwvL05Ip,0*21", "AIVDM,2,2,1,B,00000000000,2*26",
    ]
    got = {r.seq: r for r in parsed(spark, lines).collect()}
    assert {i: r.outcome for i, r in got.items()} == {0: "ok", 1: "ok", 2: "parse_err", 5: "parse_err", 6: "parse_err", 7: "parse_err", 8: "ok", 9: "parse_err", 10: "ok", 11: "parse_err", 12: "ok", 13: "parse_err"}
    assert (got[8].tag_s, got[8].tag_t, got[8].talker, got[8].channel, got[8].fill) == ("2573010", 1_787_234_980_000_000, "BS", "B", 0)
    assert (got[12].kind, got[7].tag_s, got[7].tag_t) == ("VDO", "here", None)


def test_two_part_static_report(spark):
    lines = ["!AIVDM,2,1,1,A,55?MbV02;H;s<HtKR20EHE:0@T4@Dn2222222216L961O5Gf0NSQEp6ClRp8,0*1C", "!AIVDM,2,2,1,A,88888888880,2*25", "!AIVDM,2,2,7,A,88888888880,2*23"]
    parts = parsed(spark, lines)
    assert [r.outcome for r in parts.collect()] == ["ok"] * 3
    (r,) = codec.decoded(formats.assemble(parts)).collect()
    want = {"type": 5, "mmsi": 351759000, "imo": 9134270, "callsign": "3FOF8", "name": "EVER DIADEM", "ship_type": 70, "to_bow": 225, "to_stern": 70, "to_port": 1, "to_starboard": 31, "draught": 12.2, "destination": "NEW YORK", "eta_month": 5, "eta_day": 15, "eta_hour": 14, "eta_minute": 0, "dte": 0}
    assert {k: r[k] for k in want} == want and r.nmea == lines[:2] and r.seq == 1


@pytest.mark.parametrize("number", [1, 4, 5, 9, 18, 19, 21, 27])
def test_round_trip(spark, number):
    """What a message holds comes back, quantised; what isn't given is not available."""
    rows = spark.range(300).select(F.col("id").alias("seq"), (F.col("id") * 7919 % 999_999_999).alias("mmsi"), (F.col("id") * 37 % 180 - 90).cast("double").alias("lat"), (F.col("id") * 53 % 360 - 180).cast("double").alias("lon"), F.concat(F.lit("ship "), F.col("id").cast("string")).alias("name"))
    own = {n for n, *_ in codec.LAYOUTS[number]}
    made = codec.encoded(rows, number, {c: F.col(c) for c in ("mmsi", "lat", "lon", "name") if c in own or c == "mmsi"}, F.lit("B"))
    body = made.select("seq", F.lit("s").alias("source"), F.lit("s").alias("station"), F.lit(0).cast("long").alias("recv_t"), F.posexplode("nmea").alias("k", "body")).withColumn("seq", F.col("seq") * 4 + F.col("k"))
    told = codec.decoded(formats.assemble(formats.parse(body)))
    got = {r.mmsi: r for r in told.collect()}
    assert len(got) == 300
    for r in rows.collect():
        g = got[r.mmsi]
        assert g.type == number and g.channel == "B"
        if "lat" in own:
            assert (g.lat, g.lon) == (pytest.approx(r.lat, abs=1e-6), pytest.approx(r.lon, abs=1e-6))
        if "name" in own:
            assert g.name == r.name.upper()
        if "heading" in own:
            assert g.heading == 511


def test_odd_payloads(spark):
    rows = [(0, None), (1, ""), (2, "1"), (3, "~~~~~~~~~~~~"), (4, "1" * 400), (5, "13HOI"), (6, "x" * 28), (7, "13HOI:0P0000VOHLCnHQKwvL05Ié")]
    got = {r.seq: r.type for r in codec.decoded(spark.createDataFrame(rows, "seq long, payload string")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: 1, 5: None, 6: None, 7: None}


def test_id_is_of_bits_and_channel(spark):
    (r,) = codec.decoded(spark.createDataFrame([("13HOI:0P0000VOHLCnHQKwvL05Ip", None)], "payload string, channel string"), ids=True).collect()
    bits = "".join(f"{(lambda v: v - 8 * (v > 40))(ord(c) - 48):06b}" for c in "13HOI:0P0000VOHLCnHQKwvL05Ip")
    assert r.id == hashlib.sha256(bytes(map(int, bits)) + b"\0").hexdigest()[:32]
