"""The engine's functions under names that SQL text can use.

Scalar functions are SQL functions, so their bodies become part of the plan. ``ais_decode`` is a table
function over a whole table of sentences, read an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from tidewatch.functions.columns import EARTH_NM

_SCALARS = {
    "nmea_checksum(body STRING) RETURNS STRING": "lpad(hex(aggregate(transform(split(body, ''), c -> ascii(c)), 0, (a, c) -> a ^ c)), 2, '0')",
    "ais_bits(payload STRING, fill INT) RETURNS STRING": (
        "left(array_join(transform(split(payload, ''), c -> lpad(bin(ascii(c) - 48 - CASE WHEN ascii(c) > 88 THEN 8 ELSE 0 END), 6, '0')), ''), greatest(6 * length(payload) - fill, 0))"
    ),
    "ais_unsigned(bits STRING, first INT, width INT) RETURNS BIGINT": "CAST(conv(substr(bits, first + 1, width), 2, 10) AS BIGINT)",
    "geo_nm(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        f"2 * {EARTH_NM} * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
    ),
    "geo_in_box(lat DOUBLE, lon DOUBLE, min_lat DOUBLE, min_lon DOUBLE, max_lat DOUBLE, max_lon DOUBLE) RETURNS BOOLEAN": "lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon",
}
_OUT = "seq BIGINT, msg_type STRING, mmsi BIGINT, lat DOUBLE, lon DOUBLE, body STRING"


class Decode:
    """Whole messages of a table of (seq, sentence), sentences of one fragment; others, and what can't be decoded, give no row."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        from tidewatch.sources import bodies, codec

        seq, lines = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string())
        found = pc.extract_regex(pc.fill_null(lines, ""), r"^[!$](?P<told>[A-Z0-9]{2}VD[MO],1,1,[0-9]?,[^,*]*,(?P<payload>[^,*]*),(?P<fill>[0-5]))\*(?P<sum>[0-9A-Fa-f]{2})$")
        told = pc.fill_null(found.field("told"), "").to_pylist()
        same = np.array([a == (b or "").upper() for a, b in zip(codec.xor_sums(told), pc.fill_null(found.field("sum"), "").to_pylist(), strict=True)], bool)
        rows = pa.array(np.flatnonzero(np.asarray(found.is_valid()) & same))
        payload, fill = found.field("payload").take(rows), np.array(found.field("fill").take(rows).to_pylist(), dtype=np.int64)
        names, texts = bodies._decode(payload, fill)
        # the decoder of typed columns tells what is read most
        flat = codec._decode(payload, fill, [None] * len(rows), ["mmsi", "lon", "lat"], False)
        table = pa.table([seq.take(rows), pa.array(names, pa.string()), flat[0], flat[2], flat[1], pa.array(texts, pa.string())], names=[c.split()[0] for c in _OUT.split(", ")])
        yield table.filter(pc.is_valid(table.column("msg_type")))


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session, for as long as it lasts."""
    for head, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("ais_decode", arrow_udtf(Decode, returnType=_OUT))
