"""Counters of running streams: observed in the plan, added up by a listener.

``observed`` lets Spark count outcomes while rows pass by, without a further action or shuffle. The
listener adds each batch's counts once, also if a batch is reported again, and keeps when each stream last had rows. From
these follow the text exposition and the health of the streams.
"""

from __future__ import annotations

import threading
from collections import Counter
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# Fixed values of the service: its counters with the outcome that each counts, and the silence that makes a stream unhealthy.
COUNTERS = {
    "events": "event", "duplicates": "duplicate", "parse_errors": "parse_err", "replayed": "replayed", "decode_failures": "decode_fail", "client_drops": "client_drop", "ping_timeouts": "ping_timeout", "archive_drops": "archive_drop",
    "ratelimited": "rate_limited", "thinned": "thinned", "implausible": "implausible", "uncorroborated": "uncorroborated",
}
SILENCE_S = 120
HELP = {
    "events": "messages told, decoded and without copies", "duplicates": "copies of messages", "parse_errors": "lines that cannot be read", "replayed": "buffered lines that are only archived", "decode_failures": "whole messages that cannot be decoded", "client_drops": "events that a full queue lost",
    "ping_timeouts": "connections that did not answer", "archive_drops": "receptions that the archive lost", "ratelimited": "requests over their rate", "thinned": "events over a connection's rate", "implausible": "positions that imply an impossible speed", "uncorroborated": "events that no trusted source bears out",
    "source_last_age_seconds": "seconds since a source's last event", "source_events_total": "events of a source",
}


def observed(rows: DataFrame, name: str, outcome: Column) -> DataFrame:
    """``rows``, whose outcomes are counted as they pass: a column of metrics for each counter."""
    return rows.observe(name, *(F.count_if(outcome == value).alias(counter) for counter, value in COUNTERS.items()))


class Counts(StreamingQueryListener):
    """Totals of all observed streams of a session."""

    def __init__(self) -> None:
        self.totals: Counter = Counter()
        self.heard: dict[str, float] = {}
        self._seen: dict[tuple[str, str], int] = {}
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._change:
            self.heard.setdefault(event.name or str(event.id), _seconds(event.timestamp))

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def add(self, progress) -> None:
        """Adds a batch's counts, if they are not there yet."""
        stream = progress.name or str(progress.id)
        with self._change:
            if progress.numInputRows:
                self.heard[stream] = max(self.heard.get(stream, 0.0), _seconds(progress.timestamp))
            for metric, row in (progress.observedMetrics or {}).items():
                if self._seen.get((str(progress.id), metric), -1) < progress.batchId:
                    self._seen[str(progress.id), metric] = progress.batchId
                    self.totals.update({k: v for k, v in row.asDict().items() if v is not None})
            self._change.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Until all news of a run that ended has come: listeners hear of things a little later."""
        with self._change:
            return self._change.wait_for(lambda: str(run_id) in self._ended, seconds)

    def silent(self, now_s: float) -> dict[str, int]:
        """Streams that had no rows for longer than they may, with the seconds; a service with any is unwell."""
        with self._change:
            return {s: int(now_s - at) for s, at in sorted(self.heard.items()) if now_s - at > SILENCE_S}


def _seconds(timestamp: str) -> float:
    return datetime.fromisoformat(timestamp.replace("Z", "+00:00")).timestamp()


def exposition(counters: DataFrame, gauges: DataFrame, sources: DataFrame, prefix: str) -> DataFrame:
    """part, line: the text exposition, in order. ``counters``: name, n, those that are missing are 0; ``gauges``: name, n; ``sources``: source, age_s, events."""
    names = counters.sparkSession.createDataFrame([(i, name, HELP[name]) for i, name in enumerate(COUNTERS)], "part int, name string, help string")
    full = names.join(F.broadcast(counters.where(F.col("name").isin(*COUNTERS)).groupBy("name").agg(F.sum("n").alias("n"))), "name", "left")
    metric = F.concat(F.lit(prefix), "name", F.lit("_total"))
    head = lambda name, kind, told=None: F.concat(*([F.lit("# HELP "), name, F.lit(" "), told, F.lit("\n")] if told is not None else []), F.lit("# TYPE "), name, F.lit(f" {kind}\n"))
    counted = full.select("part", F.concat(head(metric, "counter", F.col("help")), metric, F.lit(" "), F.coalesce("n", F.lit(0)).cast("string")).alias("line"))
    gauge = F.concat(F.lit(prefix), "name")
    measured = gauges.select(F.lit(len(COUNTERS)).alias("part"), F.concat(head(gauge, "gauge"), gauge, F.lit(" "), F.col("n").cast("string")).alias("line"))
    parts = [counted, measured]
    for k, (name, kind, value) in enumerate((("source_last_age_seconds", "gauge", "age_s"), ("source_events_total", "counter", "events"))):
        own = F.lit(prefix + name)
        title = counters.sparkSession.range(1).select(F.lit(len(COUNTERS) + 1 + 2 * k).alias("part"), F.concat(F.lit(f"# HELP {prefix}{name} {HELP[name]}\n# TYPE {prefix}{name} {kind}")).alias("line"))
        label = F.replace(F.replace("source", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        parts += [title, sources.select(F.lit(len(COUNTERS) + 2 + 2 * k).alias("part"), F.concat(own, F.lit('{source="'), label, F.lit('"} '), F.col(value).cast("string")).alias("line"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("part", "line")
