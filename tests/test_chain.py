"""The chain from lines to events on public sample sentences, with the outcomes that their tests state."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import vessels
from tidewatch.plans import chain

# Fixed values of the protocol's public samples.
POSITION = "!AIVDM,1,1,,A,13HOI:0P0000VOHLCnHQKwvL05Ip,0*23"
OWN = "!AIVDO,1,1,,A,13HOI:0P0000VOHLCnHQKwvL05Ip,0*21"
OTHER = "!AIVDM,1,1,,A,15NJ5cPP00o?8pHG8CpSWwvP2<1h,0*6E"
TAGGED = "\\s:2573010,c:1787234980*03\\!BSVDM,1,1,,B,13noH:00000H@P@RSPEakGK@0D33,0*43"
S = 1_000_000
NOW = 1_787_234_990 * S


def receptions(spark, rows):
    """Rows of (source, seconds from now, body, buffered)."""
    full = [(i, s, s, NOW + int(t * S), b, buf) for i, (s, t, b, buf) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, source string, station string, recv_t long, body string, buffered boolean")


def told(spark, rows):
    return {r.seq: r for r in chain.events(chain.messages(chain.judged_lines(receptions(spark, rows)))).collect()}


def test_sender_is_named_by_its_own_ship(spark):
    got = told(spark, [("udp:ab", 0, OTHER, False), ("udp:ab", 0, OWN, False), ("udp:ab", 0, TAGGED, False)])
    assert [got[i].source for i in range(3)] == ["udp:ab", "mmsi:227006760", "mmsi:227006760"]
    assert got[2].station == "mmsi:227006760" and got[2].channel == "B" and got[2].t == 1_787_234_980 * S


def test_same_message_of_two_stations(spark):
    got = told(spark, [("s1", 0, POSITION, False), ("s2", 0, POSITION, False), ("s1", 11, POSITION, False)])
    assert [got[i].is_dup for i in range(3)] == [False, True, False]
    assert got[0].id == "e5b8515ec5096227cdc97b0c71a470fd" and got[0].v_has_pos and got[0].v_lat == got[0].lat


def test_buffered_lines_of_long_ago_are_not_told(spark):
    rows = [("v1:a", 100, TAGGED, True), ("v1:a", 100, TAGGED, False), ("v1:a", 50, TAGGED, True)]
    assert sorted(r.outcome for r in chain.judged_lines(receptions(spark, rows)).collect()) == ["ok", "ok", "replayed"]


def test_trust(spark):
    """A sender of low trust is borne out by a trusted source, also by its dropped copy; an impossible jump is told of no one."""
    lines = receptions(spark, [("udp:ab", 0, POSITION, False), ("kystverket", 1, POSITION, False), ("udp:ab", 2, OTHER, False)])
    base = chain.messages(chain.judged_lines(lines))
    more = spark.createDataFrame([(10, "udp:ab", "udp:ab", NOW + 2 * S, 0.0, 0.0), (11, "udp:ab", "udp:ab", NOW + 600 * S, 49.5, 0.2)], "seq long, source string, station string, t long, la double, lo double")
    far = chain.synthesized(more, 1, {"mmsi": F.lit(227006760), "lat": F.col("la"), "lon": F.col("lo")})
    got = {r.seq: r for r in chain.events(base.unionByName(far, allowMissingColumns=True)).collect()}
    assert not got[0].corroborated and got[1].is_dup and got[10].jump and not got[2].jump
    assert got[11].corroborated and not got[11].jump and got[11].synthesized and got[11].channel is None


def test_late_position(spark):
    """Late by 90 s: the vessel keeps its place and takes the name; the event itself is told where it was."""
    rows = [(0, 50.0, ""), (-90, 49.0, "SLOW BOAT"), (-0.5, 51.0, "")]
    df = spark.createDataFrame([(i, 7, int(t * S) + NOW, la, 1.0, 3.0, "kystverket", "k", n, True, "PositionReport") for i, (t, la, n) in enumerate(rows)], "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string")
    stamps = {r.seq: r for r in vessels.vessel_stamps(df).collect()}
    assert [(stamps[i].v_lat, stamps[i].stale) for i in range(3)] == [(50.0, False), (49.0, True), (51.0, False)] and stamps[1].v_name == "SLOW BOAT"
    (state,) = vessels.vessel_fold(df).collect()
    assert (state.lat, state.name, state.n, state.n_stale, state.kind) == (51.0, "SLOW BOAT", 3, 1, "vessel")


@pytest.mark.parametrize("kind", ["BaseStationReport", "PositionReport"])
def test_state_keeps_what_a_message_lacks(spark, kind):
    df = spark.createDataFrame(
        [(0, 7, NOW, 50.0, 1.0, 9.0, 90.0, 80, 1, "A", 70, "k", "k", True, "PositionReport"), (1, 7, NOW + S, 51.0, 1.0, None, None, None, None, "", 0, "k", "k", True, kind), (2, 7, NOW + 2 * S, 99.0, 1.0, 1.0, None, None, 5, "B", 0, "k", "k", True, "PositionReport")],
        "seq long, mmsi long, t long, lat double, lon double, sog double, cog double, heading long, nav_status long, name string, ship_type long, source string, station string, pos boolean, msg_type string",
    )
    (s,) = vessels.vessel_fold(df).collect()
    assert (s.lat, s.cog, s.heading, s.nav_status, s.name, s.ship_type, s.seen, s.pos_at) == (51.0, 360.0, 511, 5, "B", 70, NOW + 2 * S, NOW + S)
    assert s.kind == ("base" if kind == "BaseStationReport" else "vessel")


def test_outcomes(spark):
    lines = chain.judged_lines(receptions(spark, [("udp:ab", 0, POSITION, False), ("kystverket", 1, POSITION, False), ("kystverket", 2, OTHER, False), ("udp:ab", 3, "junk", False), ("v1:a", 100, TAGGED, True), ("udp:ab", 4, "$GPGLL,1*4D", False), ("kystverket", 5, "!AIVDM,1,1,,A,w,0*51", False)]))
    messages = chain.messages(lines)
    judged = chain.events(messages)
    assert {r.outcome: r.n for r in chain.outcomes(lines, messages, judged).collect()} == {"parse_err": 1, "ignored": 1, "replayed": 1, "duplicate": 1, "uncorroborated": 1, "event": 1, "decode_fail": 1}


def test_golden_envelope(spark):
    """The rendered envelope of a position, byte by byte."""
    from tidewatch.sources import codec, formats, render

    df = spark.createDataFrame([(0, "test", "test", 1_698_014_856_940_343, POSITION)], "seq long, source string, station string, recv_t long, body string")
    told = codec.decoded(formats.parse(df)).withColumns({"t": F.col("recv_t"), "v_name": F.lit(""), "v_lat": F.col("lat"), "v_lon": F.col("lon")})
    want = (
        '{"Message":{"PositionReport":{"Cog":36.7,"CommunicationState":22136,"Latitude":49.47557666666667,"Longitude":0.13138,"MessageID":1,"NavigationalStatus":0,"PositionAccuracy":false,"Raim":false,"RateOfTurn":-128,"RepeatIndicator":0,"Sog":0,"Spare":0,'
        '"SpecialManoeuvreIndicator":0,"Timestamp":14,"TrueHeading":511,"UserID":227006760,"Valid":true}},"MessageType":"PositionReport","MetaData":{"MMSI":227006760,"MMSI_String":227006760,"ShipName":"","latitude":49.47557666666667,"longitude":0.13138,"time_utc":"2023-10-22 22:47:36.940343 +0000 UTC"}}'
    )
    assert told.select(render.envelope().alias("x")).first().x == want


def test_feature_leaves_out_what_is_not_known(spark):
    import json

    from tidewatch.sources import render

    df = spark.createDataFrame([(0, 7, NOW, 49.5, 0.0005, 102.3, "kystverket", "k/1", 'A"B', True, "PositionReport", 36.7)], "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string, cog double")
    made = json.loads(vessels.vessel_fold(df).select(render.feature().alias("x")).first().x)
    assert made == {"type": "Feature", "id": 7, "geometry": {"type": "Point", "coordinates": [0.0005, 49.5]}, "properties": {"mmsi": 7, "kind": "vessel", "seen": "2026-08-20T14:09:50Z", "source": "kystverket", "station": "k/1", "msg_type": "PositionReport", "name": 'A"B', "cog": 36.7}}
