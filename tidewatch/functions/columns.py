"""Column builders: scalar rules of the stream, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the protocol and of the service's rules.
EARTH_NM = 3440.065
KNOTS = 1.9438444924574
SKEW_US = 30_000_000
REPLAY_US = 60_000_000
LOW_TRUST = "^(udp|mmsi):"
FEEDABLE = "^(udp|mmsi|http|v1):"
POSITION_TYPES = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport", "LongRangeAisBroadcastMessage", "StandardSearchAndRescueAircraftReport")
LICENSES = {"kystverket": "nlod", "digitraffic": "cc-by-4.0", "aishub": "aishub", "aisstream": "aisstream"}
NAV_STATUS = dict(enumerate(("Under way using engine", "At anchor", "Not under command", "Restricted manoeuvrability", "Constrained by draught", "Moored", "Aground", "Fishing", "Under way sailing", "HSC", "WIG"))) | {14: "AIS-SART"}
SIX_BIT_TEXT = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&'()*+,-./0123456789:;<=>?"


def source_kind(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def license_of(source: Column) -> Column:
    tags = F.create_map(*(F.lit(x) for kv in LICENSES.items() for x in kv))
    return F.coalesce(F.element_at(tags, source), F.element_at(tags, source_kind(source)), F.lit("feeder"))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive at both ends; boxes don't wrap around the antimeridian."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lon1, lon2), 2)
    return 2 * EARTH_NM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box_around(lat: Column, lon: Column, radius_nm: float) -> list[Column]:
    dlat = F.lit(radius_nm / 60.0)
    dlon = F.lit(radius_nm) / (60 * F.greatest(F.lit(0.05), F.cos(F.radians(lat))))
    return [F.greatest(F.lit(-90.0), lat - dlat), F.greatest(F.lit(-180.0), lon - dlon), F.least(F.lit(90.0), lat + dlat), F.least(F.lit(180.0), lon + dlon)]


def checksum(body: Column) -> Column:
    """Exclusive or of all characters, as two hexadecimal digits."""
    codes = F.transform(F.split(body, ""), F.ascii)
    return F.lpad(F.hex(F.aggregate(codes, F.lit(0), lambda a, x: a.bitwiseXOR(x)).cast("long")), 2, "0")


def refined_station(source: Column, station: Column, tag: Column) -> Column:
    """The station that the TAG block names, under its source."""
    return F.when(F.coalesce(tag, F.lit("")) != "", F.concat(source, F.lit("/"), tag)).otherwise(station)


def channel(parsed: Column) -> Column:
    """A or B; anything but B and 2 counts as A."""
    return F.when(parsed.isin("B", "2"), "B").otherwise("A")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tag_safe(text: Column) -> Column:
    """Field text of a TAG block: separators become _, the last 15 characters count."""
    return F.right(F.translate(text, ",\\*:", "____"), F.lit(15))


def tag_time_us(value: Column) -> Column:
    """Seconds, milliseconds or microseconds, told apart by size; null if not positive."""
    return F.when(value <= 0, None).when(value < 10**12, value * 1_000_000).when(value < 10**15, value * 1000).otherwise(value)


def canonical_time_us(recv: Column, tag: Column, source: Column) -> Column:
    near = lambda t: F.when(F.abs(t - recv) <= SKEW_US, t)
    return F.coalesce(near(tag), near(source), recv)


def eta_fields(packed: Column) -> dict[str, Column]:
    part = lambda shift, mask: F.shiftright(packed, shift).bitwiseAND(F.lit(mask).cast("long"))
    return {"eta_month": part(16, 0xF), "eta_day": part(11, 0x1F), "eta_hour": part(6, 0x1F), "eta_minute": part(0, 0x3F)}


def event_id(bits: Column, channel: Column) -> Column:
    """First 16 bytes, in hexadecimal, of the SHA-256 of one byte per bit and the channel byte."""
    digits = F.replace(F.replace(F.replace(bits, F.lit("1"), F.lit("x")), F.lit("0"), F.lit("00")), F.lit("x"), F.lit("01"))
    return F.substring(F.sha2(F.unhex(F.concat(digits, channel)), 256), 1, 32)


def binary(value: Column, width: int) -> Column:
    """``width`` bits of an integer, in two's complement."""
    return F.lpad(F.bin(value.cast("long").bitwiseAND(F.lit((1 << width) - 1).cast("long"))), width, "0")


def tag_block(fields: list[tuple[str, Column]]) -> Column:
    """A TAG block with its checksum, between backslashes."""
    body = F.concat_ws(",", *(F.concat(F.lit(f"{k}:"), v) for k, v in fields))
    return F.concat(F.lit("\\"), body, F.lit("*"), checksum(body), F.lit("\\"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, composed of two plain hashes with the padded key."""
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    within = F.sha2(F.unhex(F.concat(F.lit(inner), F.hex(message))), 256)
    return F.sha2(F.unhex(F.concat(F.lit(outer), within)), 256)


def go_time_us(text: Column) -> Column:
    """Microseconds of a time such as ``2024-01-02 03:04:05.678 +0000 UTC``; null if it can't be read."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS] Z")))


def sentence(payload: Column, channel: Column) -> Column:
    body = F.concat(F.lit("AIVDM,1,1,,"), channel, F.lit(","), payload, F.lit(",0"))
    return F.concat(F.lit("!"), body, F.lit("*"), checksum(body))


def without_trailing_fields(line: Column) -> Column:
    return F.regexp_replace(line, r"^(.*[!$][^!$*]*\*[^!$]{2}),[^!$]*$", "$1")


def rot_indicated(per_minute: Column) -> Column:
    return F.signum(per_minute) * 4.733 * F.sqrt(F.abs(per_minute))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def ship_class(code: Column) -> Column:
    tens = F.floor(code / 10)
    return F.when(code == 30, "fishing").when(code.isin(36, 37), "pleasure").when(code.isin(31, 32, 52), "tug").when(tens == 4, "fast").when(tens == 6, "passenger").when(tens == 7, "cargo").when(tens == 8, "tanker").otherwise("other")


def age_opacity(age_s: Column) -> Column:
    return F.when(age_s < 180, 1.0).when(age_s < 600, 0.6).otherwise(0.3)


def fingerprint(*fields: str) -> Column:
    """Static fields as one text; a missing one is empty."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields))


def dimensions(bow: Column, length: Column, starboard: Column, beam: Column) -> dict[str, Column]:
    """Distances of the antenna to the four sides; null where one of the two that it follows from is."""
    return {"to_bow": bow, "to_stern": length - bow, "to_port": beam - starboard, "to_starboard": starboard}


def json_number(value: Column) -> Column:
    """A number as JSON writers print it: no fraction if it is whole, no exponent."""
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(F.abs(value) >= 0.001, F.regexp_replace(value.cast("string"), r"\.0$", "")).when(value == 0, "0").otherwise(plain)


def lower_keys(body: Column) -> Column:
    """A JSON object as a map with keys in lower case."""
    return F.transform_keys(F.from_json(body, "map<string,string>"), lambda k, _: F.lower(k))


def nav_label(status: Column) -> Column:
    """Label of a navigational status; null for one that is reserved."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in NAV_STATUS.items() for x in kv)), status.cast("int"))


def heading_or_course(heading: Column, cog: Column) -> Column:
    return F.coalesce(F.when(heading < 511, heading.cast("double")), F.when(cog < 360, cog))
