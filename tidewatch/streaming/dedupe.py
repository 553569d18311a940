"""Streaming forms: the greedy dedupe and the vessels' fold as stateful operators, and runs to completion.

A key's state goes when nothing can need it any more: a payload's a minute after the window
of its last kept message, a vessel's half an hour after it was last seen. The fold has its own
rule for late rows, so the watermark waits for ``LATE``; only rows later than that are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.vessels import _READ, EXPIRES_US, STATE, STATE_NAMES, fold_row, new_state

OUT = "payload string, seq long, t long, is_dup boolean"
EVICT_US, LATE = 60_000_000, "1 day"
#: Buckets of keys in a stream's state.
BUCKETS = 1024
WHOLE = {c.split()[0]: "Int64" for c in ("mmsi long", *STATE.split(", ")) if c.endswith(" long")}
#: What a fold reads that is whole; all of it but ``t`` is never null.
_WHOLE_READ = ("t", "heading", "nav_status", "ship_type")


def bucketed(rows: DataFrame, key: str) -> GroupedData:
    """Keys are kept by the bucket, each with its own state and deadline, as a call for every key costs far more than its few rows."""
    return rows.withColumn("bucket", F.pmod(F.hash(F.col(key).cast("string")), F.lit(BUCKETS))).groupBy("bucket")


def read_bucket(text: str | None) -> dict:
    """Deadline in milliseconds and state of each key of a bucket."""
    return {key: held for key, *held in json.loads(text)} if text else {}


def write_bucket(keys: dict) -> str:
    return json.dumps([[key, *held] for key, held in keys.items()])


def _settle(state: GroupState, keys: dict, touched: set) -> None:
    """Keeps what was touched, or isn't over its deadline; the bucket is called again at the first deadline."""
    now = state.getCurrentWatermarkMs()
    for key in touched:
        keys[key][0] = max(keys[key][0], now + 1)
    kept = {key: held for key, held in keys.items() if key in touched or held[0] >= now}
    if not kept:
        state.remove()
        return
    state.update((write_bucket(kept),))
    state.setTimeoutTimestamp(max(min(held[0] for held in kept.values()), now + 1))


def stream_dedupe(stream: DataFrame, window_us: int) -> DataFrame:
    """payload, seq, t, is_dup of a stream of (payload, seq, t): the state is the time of the last kept row per key."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = read_bucket(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            _settle(state, keys, set())
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        flags, touched = [], set()
        for key, t in zip(rows["payload"].tolist(), rows["t"].tolist(), strict=True):
            t = None if pd.isna(t) else int(t)
            last = keys[key][1] if key in keys else None
            dup = last is not None and t is not None and abs(t - last) < window_us
            flags.append(dup)
            last = last if dup else t
            keys[key] = [((last or 0) + window_us + EVICT_US) // 1000, last]
            touched.add(key)
        _settle(state, keys, touched)
        yield pd.DataFrame({"payload": rows["payload"], "seq": rows["seq"], "t": rows["t"], "is_dup": flags})

    timed = stream.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", LATE)
    return bucketed(timed, "payload").applyInPandasWithState(step, OUT, "keys string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_vessels(stream: DataFrame) -> DataFrame:
    """mmsi and its state, each time that it changed, of a stream of ``vessels.prepared`` rows."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = read_bucket(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            _settle(state, keys, set())
            return
        touched = fold_frames(frames, keys)
        for mmsi in touched:
            keys[mmsi][0] = ((keys[mmsi][1] or 0) + EXPIRES_US) // 1000
        _settle(state, keys, touched)
        yield told(keys, touched)

    timed = stream.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", LATE)
    return bucketed(timed, "mmsi").applyInPandasWithState(step, f"mmsi long, {STATE}", "keys string", "update", GroupStateTimeout.EventTimeTimeout)


def _values(column: pd.Series, whole: bool) -> list:
    """A column as Python values; whole numbers, which pandas tells as fractions beside nulls, are whole again."""
    values = column.tolist()
    if not column.hasnans:
        return values
    return [None if null else int(x) if whole else x for x, null in zip(values, column.isna().tolist(), strict=True)]


def fold_frames(frames: Iterator[pd.DataFrame], keys: dict) -> set:
    """Folds prepared rows into the states of their bucket, in arrival order; the vessels that they are of."""
    rows = pd.concat(list(frames))
    rows = rows.take(rows["seq"].argsort(kind="stable"))
    states: dict = {}
    columns = [_values(rows[c], c in _WHOLE_READ) for c in _READ]
    for mmsi, row in zip(_values(rows["mmsi"], True), zip(*columns, strict=True), strict=True):
        state = states.get(mmsi)
        if state is None:
            state = states[mmsi] = keys[mmsi][1:] if mmsi in keys else new_state()
        fold_row(state, row)
    for mmsi, state in states.items():
        keys[mmsi] = [keys[mmsi][0] if mmsi in keys else None, *state]
    return set(states)


def told(keys: dict, touched: set) -> pd.DataFrame:
    """The states of these vessels as rows."""
    return pd.DataFrame([[mmsi, *keys[mmsi][1:]] for mmsi in touched], columns=["mmsi", *STATE_NAMES]).astype(WHOLE)


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet folder, and read that; updates are written as they are told."""
    out, check = f"{path}/out", f"{path}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).select(*stream.columns)
