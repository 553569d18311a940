"""Counters of streams: observed over several batches, counted once, silent streams named."""

from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_streams import in_batches
from tidewatch.streaming import metrics


def test_counts_over_batches(spark):
    rows = [[(i, o) for i, o in enumerate(["event"] * n + ["duplicate", "thinned", None, "odd"])] for n in (3, 0, 5)]
    stream, base = in_batches(spark, rows, "seq int, outcome string")
    counts = metrics.Counts()
    spark.streams.addListener(counts)
    try:
        query = metrics.observed(stream, "outcomes", F.col("outcome")).writeStream.queryName("lines").format("noop").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert counts.wait(query.runId)
    finally:
        spark.streams.removeListener(counts)
    assert {k: v for k, v in counts.totals.items() if v} == {"events": 8, "duplicates": 3, "thinned": 3}
    assert set(counts.totals) == set(metrics.COUNTERS)
    at = counts.heard["lines"]
    assert counts.silent(at + 100) == {} and counts.silent(at + 200) == {"lines": 200}


def test_a_batch_told_again_counts_once():
    counts = metrics.Counts()
    progress = lambda batch, n: SimpleNamespace(name="s", id="1", batchId=batch, numInputRows=n, timestamp="2024-01-01T00:00:00.000Z", observedMetrics={"m": Row(events=n, duplicates=None)})
    for batch, n in ((0, 2), (0, 2), (1, 5), (1, 5)):
        counts.add(progress(batch, n))
    assert counts.totals["events"] == 7 and counts.totals["duplicates"] == 0


def test_exposition(spark):
    counters = spark.createDataFrame([("events", 3), ("events", 4)], "name string, n long")
    gauges, sources = spark.createDataFrame([("vessels", 2)], "name string, n long"), spark.createDataFrame([('a"b\\', 1, 2)], "source string, age_s long, events long")
    lines = "\n".join(r.line for r in metrics.exposition(counters, gauges, sources, "x_").collect()).split("\n")
    assert lines[:3] == [f"# HELP x_events_total {metrics.HELP['events']}", "# TYPE x_events_total counter", "x_events_total 7"]
    assert "x_thinned_total 0" in lines and "x_vessels 2" in lines and 'x_source_events_total{source="a\\"b\\\\"} 2' in lines
    assert sum(line.endswith(" counter") for line in lines) == 13 and sum(line.endswith(" gauge") for line in lines) == 2
