"""The whole chain: receptions parsed, reassembled, decoded, timed, labelled, de-duplicated and folded into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import folds, vessels
from tidewatch.plans.scratch import written
from tidewatch.sources import codec, formats

DEDUPE_US = 10_000_000
_FIELDS = ["nav_status", "rot", "sog", "lon", "lat", "cog", "heading", "second", "name", "callsign", "ship_type", "imo", "draught", "destination", "part", "aid_type"]
_WITH_POSITION = [n for n, fields in codec.LAYOUTS.items() if n not in (11, 17) and any(f[0] == "lat" for f in fields)]


def replayed(buffered: Column, recv: Column, tag: Column) -> Column:
    """A buffered sentence whose TAG time is more than a minute old is for the archive alone."""
    return F.coalesce(buffered & (recv - tag > C.REPLAY_US), F.lit(False))


def judged_lines(receptions: DataFrame) -> DataFrame:
    """Parsed receptions with ``outcome`` replayed added, and ``station`` refined by the TAG block."""
    parsed = formats.parse(receptions)
    buffered = F.col("buffered") if "buffered" in receptions.columns else F.lit(False)
    old = (F.col("outcome") == "ok") & replayed(buffered, F.col("recv_t"), F.col("tag_t"))
    return parsed.withColumns({"outcome": F.when(old, "replayed").otherwise(F.col("outcome")), "station": C.refined_station(F.col("source"), F.col("station"), F.col("tag_s"))})


def messages(lines: DataFrame, kept: bool = False) -> DataFrame:
    """Decoded messages of judged lines: seq, id, t, source, station, channel, nmea, type, msg_type, mmsi, fields, pos, own, synthesized.

    ``type`` is null where a whole message can't be decoded. ``kept``: the lines are written already, as for a caller that reads them too.
    """
    # both are read twice: lines by their number of fragments, messages for their sender's own ship
    fine = lines.where("outcome = 'ok'")
    whole = formats.assemble(fine if kept else written(fine, "lines")).withColumn("channel", C.channel(F.col("channel")))
    told = codec.decoded(whole, _FIELDS, ids=True)
    source_t = F.col("source_t") if "source_t" in told.columns else F.lit(None).cast("long")
    # a long-range report has its own marks of what is not available
    far = F.col("type") == 27
    told = told.withColumns({"cog": F.when(far & (F.col("cog") == 511), vessels.NO_COG).otherwise(F.col("cog")), "sog": F.when(far & (F.col("sog") == 63), vessels.NO_SOG).otherwise(F.col("sog"))})
    told = told.withColumns({
        "t": C.canonical_time_us(F.col("recv_t"), F.col("tag_t"), source_t), "msg_type": codec.type_name(F.col("type")), "own": F.col("kind") == "VDO", "synthesized": F.lit(False),
        "pos": F.coalesce(F.col("type").isin(*_WITH_POSITION) & (F.abs("lat") <= 90) & (F.abs("lon") <= 180), F.lit(False)),
        "ship_type": F.coalesce("ship_type", "aid_type"),
    })
    told = folds.relabel(written(told, "messages"), F.col("own") & (F.col("mmsi") != 0))
    renamed = F.col("label") != F.col("source")
    return told.withColumns({"station": F.when(renamed, F.col("label")).otherwise(F.col("station")), "source": F.col("label")}).drop("label", "kind", "talker", "total", "seqid", "fill", "ok", "outcome", "tag_s", "tag_t", "recv_t", "source_t", "buffered", "body")


def synthesized(rows: DataFrame, number: int, fields: dict[str, Column]) -> DataFrame:
    """Messages of a feed that tells fields and no sentences: encoded, and decoded again, so they are what a receiver would have told.

    ``rows``: seq, source, station, t. Their channel is null, and their id is of a zero byte for it.
    """
    coded = codec.encoded(rows.select("seq", "source", "station", "t", *(c.alias(f"__{n}") for n, c in fields.items())), number, {n: F.col(f"__{n}") for n in fields})
    told = codec.decoded(coded.select("seq", "source", "station", "t", "nmea", "payload", "fill", F.lit(None).cast("string").alias("channel")), _FIELDS, ids=True)
    pos = F.coalesce(F.lit(number in _WITH_POSITION) & (F.abs("lat") <= 90) & (F.abs("lon") <= 180), F.lit(False))
    return told.withColumns({"msg_type": codec.type_name(F.col("type")), "own": F.lit(False), "synthesized": F.lit(True), "pos": pos}).drop("fill")


def events(told: DataFrame, window_us: int = DEDUPE_US) -> DataFrame:
    """Messages with is_dup, and what the vessel's fold stamps on those that aren't: jump, stale, corroborated, v_name, v_has_pos, v_lat, v_lon."""
    return vessels.vessel_stamps(folds.dedupe(told.where("type is not null"), ["id"], window_us))


def judged_rows(lines: DataFrame, told: DataFrame, judged: DataFrame) -> DataFrame:
    """seq, source, t, outcome of every line or whole message; fragments of messages that aren't whole have none.

    ``lines``: from ``judged_lines``; ``told``: from ``messages``; ``judged``: from ``events``.
    """
    bad = lines.where("outcome != 'ok'").select("seq", "source", F.col("recv_t").alias("t"), "outcome")
    failed = told.where("type is null").select("seq", "source", "t", F.lit("decode_fail").alias("outcome"))
    low = F.col("source").rlike(C.LOW_TRUST)
    way = F.when(F.col("is_dup"), "duplicate").when(F.col("jump"), "implausible").when(low & ~F.col("corroborated"), "uncorroborated").otherwise("event")
    return bad.unionByName(failed).unionByName(judged.select("seq", "source", "t", way.alias("outcome")))


def outcomes(lines: DataFrame, told: DataFrame, judged: DataFrame) -> DataFrame:
    """How many lines or messages ended in which way."""
    return judged_rows(lines, told, judged).groupBy("outcome").agg(F.count("*").alias("n"))
