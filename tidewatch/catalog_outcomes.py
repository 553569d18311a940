"""Queries of outcomes, counters and metrics, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import _LICENSE_SQL, NOW, _scratch, query
from tidewatch.functions import columns as C
from tidewatch.plans import chain
from tidewatch.plans.adapt import events, spread
from tidewatch.plans.scratch import written
from tidewatch.sources import codec, hourly
from tidewatch.streaming import dedupe as streams
from tidewatch.streaming import metrics

HOUR = 3_600_000_000
#: What becomes of the lines below, before they are messages.
_LINE_SQL = "CASE WHEN seq % 17 = 0 THEN 'parse_err' WHEN seq % 19 = 0 THEN 'ignored' WHEN seq % 23 = 0 THEN 'decode_fail' WHEN seq % 7 = 0 THEN 'replayed' ELSE 'ok' END"
_OUTCOMES_SQL = f""", l AS (SELECT seq, mmsi, source, t, {_LINE_SQL} AS o FROM ev),
m AS (SELECT *, last_value(CASE WHEN source NOT LIKE 'udp:%' THEN t END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trusted FROM l WHERE o = 'ok'),
j AS (SELECT seq, source, t, o AS outcome FROM l WHERE o <> 'ok' UNION ALL SELECT seq, source, t, CASE WHEN source LIKE 'udp:%' AND (trusted IS NULL OR t - trusted >= {HOUR}) THEN 'uncorroborated' ELSE 'event' END FROM m
  UNION ALL SELECT seq, source, t, 'duplicate' FROM m WHERE seq % 3 = 0)"""


def _lines(spark, d):
    """Position reports of vessels that lie still, every third line told twice; some lines broken, of another kind, too short or of long ago."""
    e = spread(events(spark, d)).withColumns({"__lat": (F.col("mmsi") % 120 - 60).cast("double"), "__lon": (F.col("mmsi") % 300 - 150).cast("double")})
    coded = codec.encoded(e, 1, {"mmsi": F.col("mmsi"), "lat": F.col("__lat"), "lon": F.col("__lon"), "sog": F.least("sog", F.lit(102.2)), "heading": F.col("seq") % 360, "second": F.col("seq") % 60, "cog": (F.floor(F.col("seq") / 60) % 3600) / 10})
    line, short = F.element_at("nmea", 1), "!AIVDM,1,1,,A,w,0*51"
    old = C.tag_block([("c", F.floor((F.col("t") - 70_000_000) / 1_000_000).cast("string"))])
    body = F.when(F.col("seq") % 17 == 0, F.concat(F.lit("x"), line)).when(F.col("seq") % 19 == 0, "$GPGLL,1*4D").when(F.col("seq") % 23 == 0, short).when(F.col("seq") % 7 == 0, F.concat(old, line)).otherwise(line)
    twice = (F.col("seq") % 3 == 0) & (F.col("seq") % 17 != 0) & (F.col("seq") % 19 != 0) & (F.col("seq") % 23 != 0) & (F.col("seq") % 7 != 0)
    rows = coded.select("seq", "source", F.col("source").alias("station"), F.col("t").alias("recv_t"), F.lit(True).alias("buffered"), body.alias("body"), F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.withColumn("seq", F.col("seq") * 2 + F.col("copy")).drop("copy")


def _judged(spark, d):
    """seq, source, t, outcome of all of these lines, by the whole chain."""
    lines = written(chain.judged_lines(_lines(spark, d)), "lines")
    told = written(chain.messages(lines, kept=True), "told")
    return chain.judged_rows(lines, told, chain.events(told))


@query(_OUTCOMES_SQL + " SELECT outcome, count(*) AS n FROM j GROUP BY 1")
def agg10_outcomes(spark, d):
    """Every line through the chain to its end; a short message fails to decode, a copy ten seconds later would be an event."""
    return _judged(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_OUTCOMES_SQL + " SELECT counter, (SELECT count(*) FROM j WHERE j.outcome = c.outcome) AS n FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in metrics.COUNTERS.items()) + ") c(counter, outcome)")
def str12_stream_counters(spark, d):
    """SNK11, STR9: counted while a stream runs over several batches, and added up by a listener."""
    base, rows = _scratch(spark, "counters"), _judged(spark, d)
    rows.repartition(4).write.parquet(f"{base}/in")
    counts = metrics.Counts()
    spark.streams.addListener(counts)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        query_ = metrics.observed(stream, "outcomes", F.col("outcome")).writeStream.format("noop").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query_.awaitTermination()
        counts.wait(query_.runId)
    finally:
        spark.streams.removeListener(counts)
    return spark.createDataFrame([(k, counts.totals[k]) for k in metrics.COUNTERS], "counter string, n long")


_PREFIX = "tidewatch_"
_METRICS_SQL = " UNION ALL ".join(
    [f"SELECT {i} AS part, concat('# HELP {_PREFIX}{k}_total {metrics.HELP[k].replace(chr(39), chr(39) * 2)}', chr(10), '# TYPE {_PREFIX}{k}_total counter', chr(10), '{_PREFIX}{k}_total ', (SELECT count(*) FROM j WHERE outcome = '{v}')) AS line" for i, (k, v) in enumerate(metrics.COUNTERS.items())]
    + [f"SELECT 12, concat('# TYPE {_PREFIX}vessels gauge', chr(10), '{_PREFIX}vessels ', (SELECT count(DISTINCT mmsi) FROM m))", f"SELECT 12, concat('# TYPE {_PREFIX}clients gauge', chr(10), '{_PREFIX}clients ', (SELECT count(DISTINCT source) FROM ev))"]
    + [f"SELECT {13 + 2 * i}, concat('# HELP {_PREFIX}{k} {metrics.HELP[k].replace(chr(39), chr(39) * 2)}', chr(10), '# TYPE {_PREFIX}{k} {kind}')" for i, (k, kind) in enumerate((("source_last_age_seconds", "gauge"), ("source_events_total", "counter")))]
    + [f"SELECT 14, concat('{_PREFIX}source_last_age_seconds{{source=\"', source, '\"}} ', ({NOW} - max(t)) // 1000000) FROM j WHERE outcome = 'event' GROUP BY source", f"SELECT 16, concat('{_PREFIX}source_events_total{{source=\"', source, '\"}} ', count(*)) FROM j WHERE outcome = 'event' GROUP BY source"]
)


@query(_OUTCOMES_SQL + " " + _METRICS_SQL)
def snk11_exposition(spark, d):
    """All 12 counters, both gauges and the sources as text, with what they mean and are."""
    rows = written(_judged(spark, d), "judged")
    named = F.create_map(*(F.lit(x) for k, v in metrics.COUNTERS.items() for x in (v, k)))
    counters = rows.groupBy(F.element_at(named, F.col("outcome")).alias("name")).agg(F.count("*").alias("n")).where("name is not null")
    e = events(spark, d)
    fine = e.where((F.col("seq") % 17 != 0) & (F.col("seq") % 19 != 0) & (F.col("seq") % 23 != 0) & (F.col("seq") % 7 != 0))
    gauges = fine.agg(F.countDistinct("mmsi").alias("n")).select(F.lit("vessels").alias("name"), "n").unionByName(e.agg(F.countDistinct("source").alias("n")).select(F.lit("clients").alias("name"), "n"))
    age = ((NOW - F.max("t")) / 1_000_000).cast("long")
    sources = rows.where("outcome = 'event'").groupBy("source").agg(age.alias("age_s"), F.count("*").alias("events"))
    return metrics.exposition(counters, gauges, sources, _PREFIX)


def _archived(spark, d):
    path = _scratch(spark, "hourly")
    hourly.write(events(spark, d).select("seq", F.col("t").alias("recv_t"), "source", "station", F.concat("payload", F.lit("\r\n")).alias("body")), path)
    return hourly.read(spark, path)


_LICENSED = f"SELECT {_LICENSE_SQL.format('source')} AS license, source, strftime(make_timestamp(t), '%Y-%m-%d %H') AS hour, t AS recv_t, station, payload AS body FROM ev"


@query(" " + _LICENSED)
def snk1_hourly_archive(spark, d):
    """Every reception as a gzipped line of its hour, and back."""
    return _archived(spark, d)


@query(f" SELECT * FROM ({_LICENSED}) WHERE source IN ('udp:ab', 'aishub') AND hour >= '2024-01-10 00' AND hour < '2024-01-12 06' AND length(body) > 8")
def src14_hours(spark, d):
    """Two sources and some hours of an archive: only their files are read."""
    return _archived(spark, d).where(F.col("source").isin("udp:ab", "aishub") & (F.col("hour") >= "2024-01-10 00") & (F.col("hour") < "2024-01-12 06") & (F.length("body") > 8))
