"""Queries of whole messages of all types, in and out, with their DuckDB equivalents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.plans.adapt import events, spread
from tidewatch.plans.scratch import written
from tidewatch.sources import bodies, codec, feeds, formats, render

_TYPES = list(bodies.BODIES)
_SWITCHES = {"StaticDataReport": (0, 1), "SingleSlotBinaryMessage": (0, 1, 2, 3), "MultiSlotBinaryMessage": (0, 1, 2, 3)}


def _layouts():
    """(type's number in the list, switch or None, its fields) of every layout."""
    for k, name in enumerate(_TYPES):
        for switch in _SWITCHES.get(name, (None,)):
            own = switch if name == "StaticDataReport" or switch is None else (switch >> 1, switch & 1)
            tail = (("CommunicationStateIsItdma", 0, 1, "b"), ("CommunicationState", 0, 19, "u")) if name == "MultiSlotBinaryMessage" else ()
            yield k, switch, bodies.fields(name, codec.NAMES[name][0], own) + tail


def _value(seq: int, j: int, width: int, kind):
    """The ``j``-th field of the message of a row."""
    n = seq * (j + 3) % (1 << width) if kind not in ("t", "x", "d") else 0
    if kind in ("t", "x"):
        return f"T{seq % 100}"
    if kind == "d":
        return "10" * (seq % 5 + 1)
    if kind == "b":
        return n == 1
    if kind == "u":
        return n
    if kind == "s":
        return n - (1 << width - 1)
    return (n - (1 << width - 1)) / kind if kind > 0 else n / -kind


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layouts = {(k, s): f for k, s, f in _layouts()}
    for batch in batches:
        out = []
        for seq, mmsi in zip(batch.column("seq").to_pylist(), batch.column("mmsi").to_pylist(), strict=True):
            k, lot = seq % len(_TYPES), seq // len(_TYPES)
            switch = lot % 2 if _TYPES[k] == "StaticDataReport" else lot % 2 * 2 + lot // 2 % 2 if _TYPES[k] in _SWITCHES else None
            body: dict = {"Valid": True}
            for j, (path, _, width, kind) in enumerate(layouts[k, switch]):
                bodies._put(body, path, _value(seq, j, width, kind))
            body |= {"MessageID": codec.NAMES[_TYPES[k]][0], "UserID": mmsi}
            if switch is not None:
                body |= {"PartNumber": switch} if _TYPES[k] == "StaticDataReport" else {"DestinationIDValid": switch > 1, "ApplicationIDValid": switch % 2 == 1}
            out.append(json.dumps({"Message": {_TYPES[k]: body}, "MessageType": _TYPES[k] if seq % 29 else "UnknownMessage"}))
        yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("t"), pa.array(out, pa.string())], names=["seq", "t", "body"])


def _envelopes(spark, d):
    """Envelopes of all types by turns; some are of a type that isn't carried."""
    made = spread(events(spark, d).select("seq", "mmsi", "t")).mapInArrow(_told, "seq long, t long, body string")
    # the sender's own time, which counts if it is near
    sent = F.date_format(F.timestamp_micros(F.col("t") - (F.col("seq") % 2) * 40_000_000), "yyyy-MM-dd HH:mm:ss")
    meta = F.concat(F.lit(', "MetaData": {"time_utc": "'), sent, F.lit(' +0000 UTC"}}'))
    return made.select("seq", F.col("t").alias("recv_t"), F.concat(F.expr("left(body, length(body) - 1)"), meta).alias("body"))


def _sql() -> str:
    rows = []
    for k, switch, own in _layouts():
        for j, (path, _, width, kind) in enumerate(own):
            if path in ("MessageID", "UserID", "PartNumber", "DestinationIDValid", "ApplicationIDValid"):
                continue
            shape, scale = (kind, 1) if isinstance(kind, str) else ("n", -kind) if kind < 0 else ("p", kind)
            rows.append(f"({k},{-1 if switch is None else switch},'{path}',{j + 3},'{shape}',{scale},{1 << width if shape not in ('t', 'x', 'd') else 2})")
        rows.append(f"({k},{-1 if switch is None else switch},'MessageID',0,'i',{codec.NAMES[_TYPES[k]][0]},2)")
    return f""", f(k, switch, path, j, shape, scale, m) AS (VALUES {",".join(rows)}),
x AS (SELECT seq, t, seq % {len(_TYPES)} AS k, seq // {len(_TYPES)} AS lot FROM ev WHERE seq % 29 <> 0),
y AS (SELECT seq, path, shape, scale, m, seq * j % m AS n FROM x JOIN f ON f.k = x.k AND f.switch = CASE WHEN x.k = {_TYPES.index("StaticDataReport")} THEN lot % 2 WHEN x.k IN ({_TYPES.index("SingleSlotBinaryMessage")}, {_TYPES.index("MultiSlotBinaryMessage")}) THEN lot % 2 * 2 + lot // 2 % 2 ELSE -1 END)
SELECT seq, path, CASE shape WHEN 'u' THEN n::DOUBLE WHEN 's' THEN (n - m // 2)::DOUBLE WHEN 'n' THEN round(n / scale, 6) WHEN 'p' THEN round((n - m // 2) / scale, 6) WHEN 'i' THEN scale::DOUBLE END AS number,
CASE shape WHEN 'b' THEN CASE WHEN n = 1 THEN 'true' ELSE 'false' END WHEN 't' THEN concat('T', seq % 100) WHEN 'x' THEN concat('T', seq % 100) WHEN 'd' THEN repeat('10', (seq % 5 + 1)::INT) END AS told FROM y"""


def _spelled(rows):
    """seq, path, number, told of every field of a table of bodies: an object's fields are rows, at most three deep, so a row costs what its own body holds."""
    known = {p for _, _, own in _layouts() for p, *_ in own} - {"UserID", "PartNumber", "DestinationIDValid", "ApplicationIDValid"}
    texts = {p for _, _, own in _layouts() for p, *_, kind in own if kind in ("t", "x", "d")}
    tvf, told = rows.sparkSession.tvf, rows.select("seq", F.lit("").alias("path"), F.col("body").alias("v"))
    for depth in range(3):
        # what is no object stays as it is
        inner = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")) if depth else F.col("v")
        deeper = told.lateralJoin((tvf.variant_explode_outer if depth else tvf.variant_explode)(inner.outer()))
        told = deeper.select("seq", F.concat("path", F.coalesce(F.concat(F.lit("." if depth else ""), "key"), F.lit(""))).alias("path"), F.coalesce("value", "v").alias("v"))
    told = told.where(F.col("path").isin(*known)).select("seq", "path", F.col("v").try_cast("string").alias("v")).where("v is not null and not startswith(v, '{')")
    number = F.when(~F.col("path").isin(*texts), F.col("v").try_cast("double"))
    return told.select("seq", "path", F.round(number, 6).alias("number"), F.when(number.isNull(), F.col("v")).alias("told"))


@query(_sql())
def src9_whole_envelopes(spark, d):
    """SNK4, PAR9, PAR10: bodies of all 23 types from envelopes to sentences, reassembled and decoded, field by field."""
    told = bodies.encoded(feeds.whole_envelopes(_envelopes(spark, d)))
    lines = told.select("seq", F.posexplode("nmea").alias("p", "body")).select((F.col("seq") * 32 + F.col("p")).alias("seq"), F.lit("s").alias("source"), F.lit("s").alias("station"), "body")
    whole = bodies.decoded(formats.assemble(written(formats.parse(lines).where("ok"), "lines")))
    return _spelled(whole.select(F.floor(F.col("seq") / 32).alias("seq"), "body"))


@query(f" SELECT seq, {_TYPES}[(seq % {len(_TYPES)} + 1)::INT] AS msg_type, mmsi, CASE WHEN seq % 2 = 0 THEN t // 1000000 * 1000000 ELSE t END AS t FROM ev WHERE seq % 29 <> 0")
def src9_envelope_heads(spark, d):
    """TIME4: type, sender and time of whole envelopes; types that aren't carried are left out."""
    return feeds.whole_envelopes(_envelopes(spark, d)).select("seq", "msg_type", "mmsi", "t")


@query(_sql())
def snk4_whole_envelopes(spark, d):
    """SNK5: events of all types rendered as envelopes, and read as such again."""
    told = feeds.whole_envelopes(_envelopes(spark, d)).withColumns({"v_name": F.lit(""), "v_lat": F.lit(None).cast("double"), "v_lon": F.lit(None).cast("double")})
    again = told.select("seq", F.col("t").alias("recv_t"), render.body_envelope().alias("body"))
    return _spelled(feeds.whole_envelopes(again))
