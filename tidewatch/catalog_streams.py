"""Queries of reassembly, of streams and their state, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import _DEDUPE_SQL, MIN, NOW, _scratch, query
from tidewatch.operators import busy, folds, fragments, vessels
from tidewatch.plans.adapt import events
from tidewatch.streaming import dedupe as streams
from tidewatch.streaming import fragments as fragment_stream
from tidewatch.streaming import vessels as vessel_stream

# How the fragments of a message of two arrive, by turns: as sent, the first or second lost, either doubled, reversed, after a stray.
_FATES = [[1, 2], [2], [1], [1, 1, 2], [1, 2, 2], [2, 1], [2, 1, 2]]
_FRAGMENTS_SQL = f""", p AS (SELECT seq, station, payload, CASE WHEN seq // 35 % 40 = 0 THEN 9 ELSE seq // 35 % 3 END AS seqid, {_FATES}[seq // 3 % 7 + 1] AS nums FROM ev),
q AS (SELECT seq, station, seqid, payload, unnest(nums) AS num, unnest(range(len(nums))) AS i FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY seq, i) AS n FROM q),
s AS (SELECT *, lag(num) OVER w AS last_num, lag(n) OVER w AS opened, lag(payload) OVER w AS before FROM r WINDOW w AS (PARTITION BY station, seqid ORDER BY n))
SELECT seq * 4 + i AS seq, station, concat(substr(before, 1, len(before) // 2), substr(payload, len(payload) // 2 + 1)) AS payload FROM s WHERE num = 2 AND last_num = 1 AND n - opened <= 32"""


def _fragments(spark, d):
    """Parsed sentences of messages of two fragments; sequence ids come again soon, one of them after more sentences than are remembered."""
    half, lot = F.floor(F.length("payload") / 2).cast("int"), F.floor(F.col("seq") / 35)
    fates = F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in _FATES)), (F.floor(F.col("seq") / 3) % 7 + 1).cast("int"))
    rows = events(spark, d).select("seq", "station", F.col("t").alias("recv_t"), "payload", F.when(lot % 40 == 0, 9).otherwise(lot % 3).cast("string").alias("seqid"), F.posexplode(fates).alias("i", "num"))
    part = F.when(F.col("num") == 1, F.col("payload").substr(F.lit(1), half)).otherwise(F.col("payload").substr(half + 1, F.length("payload")))
    return rows.select(
        (F.col("seq") * 4 + F.col("i")).alias("seq"), "station", "recv_t", F.lit("AI").alias("talker"), F.lit("VDM").alias("kind"), F.lit(2).alias("total"), "num", "seqid", F.lit("A").alias("channel"), part.alias("payload"), F.lit(0).alias("fill"), F.concat(F.lit("line "), "num").alias("line")
    )


@query(_FRAGMENTS_SQL)
def par7_reassembly(spark, d):
    """Fragments lost, doubled, reversed and left over; only whole messages come out."""
    return fragments.whole_messages(_fragments(spark, d)).select("seq", "station", "payload")


@query(_FRAGMENTS_SQL)
def str5_stream_fragments(spark, d):
    """The same as a stream, whose state is what a station's open messages hold."""
    base = _scratch(spark, "stream")
    rows = _fragments(spark, d)
    rows.write.parquet(f"{base}/in")
    with fragment_stream.store(spark):
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        return streams.run_to_end(fragment_stream.stream_messages(stream), base).select("seq", "station", "payload")


# The month as 15 hours, so that half an hour is a time in which some vessels are heard and others aren't.
_HURRIED_SQL = f""", m AS (SELECT seq, mmsi, {NOW} + (t - {NOW}) // 48 AS t, (mmsi % 120 - 60)::DOUBLE + sog / 1000 AS lat, (mmsi % 300 - 150)::DOUBLE + sog / 1000 AS lon, CASE WHEN k % 6 = 0 THEN concat('V', k::VARCHAR) ELSE '' END AS name, msg_type <> 'ShipStaticData' AS pos FROM ev)"""
_STATE_SQL = "count(*) AS n, max(t) AS seen, max_by(lat, seq) FILTER (pos) AS lat, max_by(lon, seq) FILTER (pos) AS lon, max_by(name, seq) FILTER (name <> '') AS name"


def _hurried(spark, d):
    rows = events(spark, d)
    at = F.lit(NOW) + F.floor((F.col("t") - NOW) / 48)
    named = F.when(F.col("k") % 6 == 0, F.concat(F.lit("V"), F.col("k").cast("string"))).otherwise("")
    near = lambda most, half: (F.col("mmsi") % most - half).cast("double") + F.col("sog") / 1000
    return rows.select("seq", "mmsi", at.alias("t"), near(120, 60).alias("lat"), near(300, 150).alias("lon"), "sog", F.lit("kystverket").alias("source"), "station", named.alias("name"), (F.col("msg_type") != "ShipStaticData").alias("pos"), "msg_type")


@query(_HURRIED_SQL + f" SELECT mmsi, {_STATE_SQL} FROM m GROUP BY 1")
def snk3_snapshot(spark, d):
    """All of the vessels' state as JSON, in a folder that is there when it is whole, and read again as it was."""
    path = _scratch(spark, "snapshots")
    vessel_stream.save(vessels.vessel_fold(_hurried(spark, d).where(F.col("t") <= NOW)), path, NOW)
    vessel_stream.save(vessels.vessel_fold(_hurried(spark, d)), path, NOW + 1)
    return spark.read.schema(vessel_stream.OUT).json(vessel_stream.latest(spark, path)).select("mmsi", "n", "seen", "lat", "lon", "name")


@query(
    _HURRIED_SQL
    + f""", fresh AS (SELECT mmsi FROM m WHERE t <= {NOW} GROUP BY 1 HAVING max(t) > {NOW} - 1800000000)
SELECT mmsi, {_STATE_SQL} FROM m WHERE t > {NOW} OR mmsi IN (SELECT mmsi FROM fresh) GROUP BY 1"""
)
def src13_restored_stream(spark, d):
    """A stream stopped at a moment and started anew from its snapshot; vessels not seen for half an hour begin from nothing."""
    base, rows = _scratch(spark, "restored"), _hurried(spark, d)
    before = vessels.vessel_fold(rows.where(F.col("t") <= NOW))
    restored = vessel_stream.restore(spark, vessel_stream.save(before, f"{base}/snapshots", NOW), NOW)
    later = vessels.prepared(rows.where(F.col("t") > NOW))
    later.write.parquet(f"{base}/in")
    with fragment_stream.store(spark):
        told = streams.run_to_end(vessel_stream.stream_states(spark.readStream.schema(later.schema).parquet(f"{base}/in"), restored), base)
    # what the stream had no news of is as it was
    columns = ("n", "seen", "lat", "lon", "name")
    every = told.select("mmsi", *columns).unionByName(restored.select("mmsi", *columns))
    return every.groupBy("mmsi").agg(F.max_by(F.struct(*columns), "n").alias("x")).select("mmsi", "x.*")


@query(_DEDUPE_SQL.replace("payload", "source").replace("1800000000", str(5 * MIN)) + " SELECT seq, is_dup FROM f")
def win1_busy_sources(spark, d):
    """Five keys with all rows between them, each over several tasks: blocks as maps of the time last kept."""
    rows = events(spark, d).select("seq", "t", "source")
    return folds.dedupe(rows, ["source"], 5 * MIN, busy.busy_keys(rows, ["source"], 100), 1_000).select("seq", "is_dup")


@query(""", o AS (SELECT source, seq, k % 3 = 0 AS frees, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM ev),
RECURSIVE f AS (SELECT source, rn, seq, CASE WHEN frees THEN 0 ELSE 1 END AS n, NOT frees AS granted FROM o WHERE rn = 1
  UNION ALL SELECT o.source, o.rn, o.seq, CASE WHEN frees THEN greatest(f.n - 1, 0) WHEN f.n < 3 THEN f.n + 1 ELSE f.n END, NOT frees AND f.n < 3 FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
SELECT seq, granted FROM f""")
def win9_busy_slots(spark, d):
    """The same of slots: a block is a table of how many are open."""
    rows = events(spark, d)
    return folds.slots(rows, ["source"], F.col("k") % 3 == 0, 3, busy.busy_keys(rows, ["source"], 100), 1_000).select("seq", "granted")
