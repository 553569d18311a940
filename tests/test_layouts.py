"""Messages of the surveyed layouts, with the values that the reference's sample file gives for them."""

import pytest

from tidewatch.sources import formats

CASES = [
    (4, "403OviQuMGCqWrRO9>E6fE700@GO", {"mmsi": 3669702, "year": 2007}),
    (5, "55?MbV02;H;s<HtKR20EHE:0@T4@Dn2222222216L961O5Gf0NSQEp6ClRp888888888880", {"mmsi": 351759000, "imo": 9134270, "ais_version": 0}),
    (9, "91b77=h3h00nHt0Q3r@@07000<0b", {"mmsi": 111265591, "altitude": 15, "sog": 0.0, "lon": 7128960 / 600000, "lat": 34667073 / 600000, "cog": 0.0, "second": 28}),
    (18, "B52K>;h00Fc>jpUlNV@ikwpUoP06", {"mmsi": 338087471, "sog": 0.1, "lon": -74.0721316666, "lat": 40.68454, "cog": 79.6, "heading": 511, "second": 49}),
    (19, "C5N3SRgPEnJGEBT>NhWAwwo862PaLELTBJ:V00000000S0D:R220", {"mmsi": 367059850, "sog": 8.7, "lon": -88.8103916667, "lat": 29.543695, "cog": 335.9, "name": "CAPT.J.RIMES", "ship_type": 70, "to_bow": 5, "to_stern": 21, "to_port": 4, "to_starboard": 4}),
    (21, "E1mg=5J1T4W0h97aRh6ba84<h2d;W:Te=eLvH50```q:D44QDlp0C1DU00", {"mmsi": 123456789, "aid_type": 20, "name": "CHINA ROSE MURPHY EXPRESS ALERT", "lon": -122.698591667, "lat": 47.9206183333, "to_bow": 5, "to_starboard": 5, "fix": 1}),
    (24, "H42O55i18tMET00000000000000", {"mmsi": 271041815, "part": 0, "name": "PROGUY", "ship_type": None}),
    (24, "H42O55lti4hhhilD3nink000?050", {"mmsi": 271041815, "part": 1, "ship_type": 60, "callsign": "TC6163", "to_stern": 15, "to_starboard": 5, "name": None}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, "s", 0, "A", p, True) for i, (_, p, _) in enumerate(CASES)] + [(99, "s", 0, "A", "K", True), (100, "s", 0, "A", "KCQ9r=hrFUnH7P00", True)]
    return spark.createDataFrame(rows, "seq long, tag_s string, tag_t long, channel string, payload string, ok boolean")


@pytest.mark.parametrize("i", range(len(CASES)))
def test_layout(parsed, i):
    number, _, want = CASES[i]
    (got,) = formats.decode(parsed, number).where(f"seq = {i}").collect()
    for name, value in want.items():
        assert got[name] == (pytest.approx(value, abs=1e-6) if isinstance(value, float) else value), name


def test_long_range_and_short(parsed):
    got = {r.seq: r for r in formats.decode(parsed, 27).collect()}
    assert set(got) == {100} and -90 <= got[100].lat <= 90 and -180 <= got[100].lon <= 180


def test_positions_are_of_types_1_to_3(parsed):
    assert formats.decode_positions(parsed).count() == 0


def test_what_a_message_cannot_hold(spark):
    """Out of range and missing values, by type: not available, or the nearest number that fits."""
    from pyspark.sql import functions as F

    from tidewatch.sources import codec

    rows = spark.createDataFrame([(0, None, None, None, None, None), (1, 91.5, -180.5, 150.0, 400.0, 600), (2, 90.0, 180.0, 102.2, 359.97, 359), (3, -90.0, -180.0, -1.0, 0.0, 0), (4, 10.0, 20.0, 102.3, 360.0, 511)], "seq int, lat double, lon double, sog double, cog double, heading int")
    given = {"mmsi": F.lit(227006760), **{c: F.col(f"__{c}") for c in ("lat", "lon", "sog", "cog")}}
    named = rows.select("seq", *(F.col(c).alias(f"__{c}") for c in ("lat", "lon", "sog", "cog", "heading")))
    near = lambda told: {r.seq: tuple(round(x, 4) if x is not None else None for x in (r.lat, r.lon, r.sog, r.cog)) for r in told.collect()}
    a = codec.decoded(codec.encoded(named, 1, given | {"heading": F.col("__heading")}).select("seq", "payload", "fill"))
    assert near(a) == {0: (91.0, 181.0, 102.3, 360.0), 1: (91.0, 181.0, 102.2, 360.0), 2: (90.0, 180.0, 102.2, 0.0), 3: (-90.0, -180.0, 0.0, 0.0), 4: (10.0, 20.0, 102.3, 360.0)}
    assert {r.seq: r.heading for r in a.collect()} == {0: 511, 1: 511, 2: 359, 3: 0, 4: 511}
    far = codec.decoded(codec.encoded(named, 27, given).select("seq", "payload", "fill"))
    assert near(far) == {0: (91.0, 181.0, 63.0, 511.0), 1: (91.0, 181.0, 62.0, 511.0), 2: (90.0, 180.0, 62.0, 0.0), 3: (-90.0, -180.0, 0.0, 0.0), 4: (10.0, 20.0, 62.0, 511.0)}
    fast = codec.decoded(codec.encoded(named, 9, {**given, "altitude": F.lit(5000)}).select("seq", "payload", "fill"))
    assert {r.seq: (r.sog, r.altitude) for r in fast.collect()}[1] == (150.0, 4095)
