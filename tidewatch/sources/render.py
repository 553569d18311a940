"""Renderings of events, vessels and stations as text, one row each; built from columns, so that nothing is collected.

Numbers are printed as JSON writers do (no fraction if whole), and keys stand in byte order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators.vessels import NO_COG, NO_HEADING, NO_SOG, NO_STATUS

# Keys of the rendered messages, with the fields that they show.
MESSAGES = {
    "PositionReport": (
        ("Cog", "cog", "number"), ("CommunicationState", "comm_state", "number"), ("Latitude", "lat", "number"), ("Longitude", "lon", "number"), ("MessageID", "type", "number"), ("NavigationalStatus", "nav_status", "number"),
        ("PositionAccuracy", "accuracy", "flag"), ("Raim", "raim", "flag"), ("RateOfTurn", "rot", "number"), ("RepeatIndicator", "repeat", "number"), ("Sog", "sog", "number"), ("Spare", None, "0"),
        ("SpecialManoeuvreIndicator", "manoeuvre", "number"), ("Timestamp", "second", "number"), ("TrueHeading", "heading", "number"), ("UserID", "mmsi", "number"), ("Valid", None, "true"),
    ),
}


def text(value: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("x")))
    return F.substring(whole, 6, 1 << 30).substr(F.lit(1), F.length(whole) - 6)


def record(*fields: tuple[str, Column]) -> Column:
    """A JSON object of rendered values in the order given; those that are null are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields)), F.lit("}"))


def flag(value: Column) -> Column:
    return F.when(value.cast("boolean"), "true").otherwise("false")


def iso_time(t: Column) -> Column:
    """Microseconds as an RFC 3339 time in UTC, without a fraction of zero."""
    at = F.timestamp_micros(t)
    fraction = F.regexp_replace(F.date_format(at, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def written_time(t: Column) -> Column:
    """The same as ``2024-01-02 03:04:05.678 +0000 UTC``."""
    return F.concat(F.regexp_replace(F.translate(iso_time(t), "TZ", " "), r"\s+$", ""), F.lit(" +0000 UTC"))


def message(name: str, prefix: str = "") -> Column:
    """The fields of a message of a type by their keys."""
    kinds = {"number": lambda c: C.json_number(F.col(prefix + c)), "flag": lambda c: flag(F.col(prefix + c))}
    return record(*((k, kinds[kind](c) if c else F.lit(kind)) for k, c, kind in MESSAGES[name]))


def envelope_of(name: Column, body: Column) -> Column:
    meta = record(("MMSI", C.json_number(F.col("mmsi"))), ("MMSI_String", C.json_number(F.col("mmsi"))), ("ShipName", text(F.col("v_name"))), ("latitude", C.json_number(F.coalesce("v_lat", F.lit(0.0)))), ("longitude", C.json_number(F.coalesce("v_lon", F.lit(0.0)))), ("time_utc", text(written_time(F.col("t")))))
    inner = F.concat(F.lit("{"), text(name), F.lit(":"), body, F.lit("}"))
    return record(("Message", inner), ("MessageType", text(name)), ("MetaData", meta))


def envelope(name: str = "PositionReport") -> Column:
    """The envelope of an event with the columns of a decoded message and v_name, v_lat, v_lon."""
    return envelope_of(F.lit(name), message(name))


def body_envelope() -> Column:
    """The same of a message of any type: msg_type, and body as VARIANT, whose keys are written in byte order."""
    return envelope_of(F.col("msg_type"), F.to_json("body"))


def event(body: Column) -> Column:
    """The frame of an event: 13 fields, without a position if the vessel has none; ``body`` is its rendered message."""
    has = F.coalesce(F.col("v_has_pos"), F.lit(False))
    lines = F.concat(F.lit("["), F.array_join(F.transform("nmea", text), ","), F.lit("]"))
    return record(
        ("type", F.lit('"event"')), ("id", text(F.col("id"))), ("time", text(iso_time(F.col("t")))), ("source", text(F.col("source"))), ("station", text(F.col("station"))), ("channel", text(F.when(~F.col("synthesized"), F.col("channel")))), ("nmea", lines),
        ("mmsi", C.json_number(F.col("mmsi"))), ("msg_type", text(F.col("msg_type"))), ("lat", F.when(has, C.json_number(F.col("v_lat")))), ("lon", F.when(has, C.json_number(F.col("v_lon")))), ("message", body), ("synthesized", flag(F.col("synthesized"))),
    )


def tagged_text(station: Column, t: Column, license_: Column, lines: Column) -> Column:
    """Sentences with our TAG block for theirs, each ended by CR LF."""
    tag = C.tag_block([("s", C.tag_safe(station)), ("c", F.floor(t / 1_000_000).cast("string")), ("t", license_)])
    return F.array_join(F.transform(lines, lambda x: F.concat(tag, F.regexp_replace(x, r"^\\[^\\]*\\", ""), F.lit("\r\n"))), "")


def feature() -> Column:
    """A vessel's state as a GeoJSON feature; what isn't known is left out."""
    known = lambda c, least: F.when(F.col(c) < least, C.json_number(F.col(c)))
    properties = record(
        ("cog", known("cog", NO_COG)), ("heading", known("heading", NO_HEADING)), ("kind", text(F.col("kind"))), ("mmsi", C.json_number(F.col("mmsi"))), ("msg_type", text(F.col("msg_type"))), ("name", F.when(F.col("name") != "", text(F.col("name")))),
        ("nav_status", F.when(F.col("nav_status") != NO_STATUS, C.json_number(F.col("nav_status")))), ("seen", text(F.date_format(F.timestamp_micros("seen"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))), ("sog", known("sog", NO_SOG)), ("source", text(F.col("source"))), ("station", text(F.col("station"))), ("type", F.when(F.col("ship_type") != 0, C.json_number(F.col("ship_type")))),
    )
    point = F.concat(F.lit('{"coordinates":['), C.json_number(F.col("lon")), F.lit(","), C.json_number(F.col("lat")), F.lit('],"type":"Point"}'))
    return record(("geometry", point), ("id", C.json_number(F.col("mmsi"))), ("properties", properties), ("type", F.lit('"Feature"')))


def collection(features: Column) -> Column:
    return F.concat(F.lit('{"features":['), F.array_join(features, ","), F.lit('],"type":"FeatureCollection"}'))


def station_row(now_us: int) -> Column:
    """A station's statistics; the box is null until a position was heard."""
    box = F.when(F.col("positions") > 0, F.concat(F.lit("["), F.concat_ws(",", *(C.json_number(F.col(c)) for c in ("min_lat", "min_lon", "max_lat", "max_lon"))), F.lit("]"))).otherwise("null")
    count = lambda c: C.json_number(F.col(c))
    return record(
        ("station", text(F.col("station"))), ("source", text(F.col("source"))), ("events", count("events")), ("duplicates", count("duplicates")), ("vessels", count("vessels")), ("positions", count("positions")),
        ("first_seen", text(iso_time(F.col("first_t")))), ("last_seen", text(iso_time(F.col("last_t")))), ("last_age_s", ((F.lit(now_us) - F.col("last_t")) / 1_000_000).cast("long").cast("string")), ("bbox", box),
    )


def station_details(stations: DataFrame, vessels: DataFrame, now_us: int) -> DataFrame:
    """station, detail: its row and the vessels with a position that it updated last."""
    here = vessels.where("has_pos").groupBy("station").agg(F.array_sort(F.collect_list(feature())).alias("__f"))
    full = stations.join(here, "station", "left").withColumn("__f", F.coalesce("__f", F.array().cast("array<string>")))
    return full.select("station", record(("station", station_row(now_us)), ("vessels", collection(F.col("__f")))).alias("detail"))
