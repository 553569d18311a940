"""Fragments of a stream put together: open messages are map state, and a station that falls silent is forgotten by a timer.

The state of a station is the number of its sentences so far and, for every open message, the
payloads and lines that it took. A message that is too old is removed when its station is next heard, everything when
the watermark has passed ``SILENT_MS`` after the station's last sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidewatch.operators.fragments import FORGET, KEY, step

SILENT_MS, LATE = 3_600_000, "1 day"
#: ``transformWithState`` keeps its state in this store alone.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_KEY = "total int, seqid string, channel string, kind string, talker string"
OUT = f"station string, seq long, recv_t long, {_KEY}, fill int, payload string, nmea array<string>"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class _Fragments(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long, last_ms long")
        self.open = handle.getMapState("open", _KEY, "n long, payloads array<string>, lines array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, last = self.count.get() if self.count.exists() else (0, None)
        before = {tuple(k): (x[0], list(x[1]), list(x[2])) for k, x in self.open.iterator()}
        opened, out = dict(before), []
        frame = pd.concat(list(rows)).sort_values("seq")
        heard = int(frame["recv_t"].max()) // 1000
        for row in frame.itertuples(index=False):
            if row.total > 1:
                own = tuple(getattr(row, c) for c in KEY)
                got = step(opened, own, n, row.total, row.num, row.payload, row.line)
                if got is not None:
                    out.append((key[0], row.seq, row.recv_t, *own, row.fill, "".join(got[0]), got[1]))
            n += 1
        opened = {k: x for k, x in opened.items() if n - x[0] <= FORGET}
        for k in before.keys() - opened.keys():
            self.open.removeKey(k)
        for k, x in opened.items():
            if before.get(k) != x:
                self.open.updateValue(k, x)
        if last is None or heard > last:
            if last is not None:
                self.handle.deleteTimer(last + SILENT_MS)
            last = heard
            self.handle.registerTimer(max(last + SILENT_MS, timerValues.getCurrentWatermarkInMs() + 1))
        self.count.update((n, last))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.count.get()[1] if self.count.exists() else None
        # a station heard since has a later timer
        if last is None or last + SILENT_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.count.clear()
            self.open.clear()
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in the store that map state and timers ask for."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE[0], before)


def stream_messages(parsed: DataFrame) -> DataFrame:
    """Whole messages of a stream of parsed sentences (station, seq, recv_t in microseconds, talker, kind, total, num, seqid, channel, payload, fill, line).

    Those of one fragment pass by; those of several are told when their last fragment comes. Start it within ``store``.
    """
    timed = parsed.withColumn("ts", F.timestamp_micros("recv_t")).withWatermark("ts", LATE)
    several = F.col("total") > 1
    slim = timed.select("station", "seq", "recv_t", "ts", "total", *(F.when(several, F.col(c)).alias(c) for c in ("num", "seqid", "channel", "kind", "talker", "fill", "payload", "line")))
    whole = slim.groupBy("station").transformWithStateInPandas(_Fragments(), OUT, "Append", "EventTime")
    single = parsed.where(~several).select(*(c for c in _COLUMNS if c != "nmea"), F.array("line").alias("nmea"))
    return single.select(*_COLUMNS).unionByName(whole)
