"""State of streams is kept by buckets of keys, so calls don't grow with the number of keys."""

import pandas as pd

from tidewatch.operators import vessels
from tidewatch.plans import scratch
from tidewatch.streaming import dedupe, fragments
from tidewatch.streaming import vessels as saved

S = 1_000_000


def _states(spark, base):
    return spark.read.format("statestore").load(f"{base}/checkpoint").count()


def test_dedupe_of_many_keys(spark):
    """Each of 3,000 keys three times, the second within the window; null is a key too."""
    base = scratch.new_path(spark, "stream")
    rows = [(f"p{i}" if i else None, 3000 * j + i, 9000 * S + t * S) for i in range(3000) for j, t in enumerate((0, 5, 20))]
    spark.createDataFrame(rows, "payload string, seq long, t long").write.parquet(f"{base}/in")
    got = dedupe.run_to_end(dedupe.stream_dedupe(spark.readStream.schema("payload string, seq long, t long").parquet(f"{base}/in"), 10 * S), base).collect()
    assert {r.seq for r in got if r.is_dup} == set(range(3000, 6000)) and len(got) == 9000
    assert _states(spark, base) <= dedupe.BUCKETS


def test_vessels_of_many_keys(spark):
    base = scratch.new_path(spark, "stream")
    schema = "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string"
    rows = [(3000 * j + i, i, 9000 * S + j * 60 * S, 10.0, 20.0, 5.0, "kystverket", "s", f"n{i}" if j else "", True, "PositionReport") for i in range(3000) for j in range(2)]
    prepared = vessels.prepared(spark.createDataFrame(rows, schema))
    prepared.write.parquet(f"{base}/in")
    got = dedupe.run_to_end(dedupe.stream_vessels(spark.readStream.schema(prepared.schema).parquet(f"{base}/in")), base, "update").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in vessels.vessel_fold(spark.createDataFrame(rows, schema)).collect()}
    assert _states(spark, base) <= dedupe.BUCKETS


def test_restored_vessels_of_many_keys(spark):
    """Vessels restored go on, those without news stay as they were, and all of them are in few states."""
    base = scratch.new_path(spark, "stream")
    schema = "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string"
    rows = [(3000 * j + i, i, 9000 * S + j * 60 * S, 10.0, 20.0, 5.0, "kystverket", "s", "" if j else f"n{i}", True, "PositionReport") for i in range(3000) for j in range(2)]
    before, later = (spark.createDataFrame([r for r in rows if (r[0] >= 3000) == after], schema) for after in (False, True))
    prepared = vessels.prepared(later.where("mmsi % 2 = 0"))
    prepared.write.parquet(f"{base}/in")
    with fragments.store(spark):
        told = dedupe.run_to_end(saved.stream_states(spark.readStream.schema(prepared.schema).parquet(f"{base}/in"), vessels.vessel_fold(before)), base)
    want = {tuple(r) for r in vessels.vessel_fold(spark.createDataFrame(rows, schema)).where("mmsi % 2 = 0").collect()}
    assert {tuple(r) for r in told.collect()} == want
    assert spark.read.format("statestore").option("stateVarName", "vessels").load(f"{base}/checkpoint").count() <= dedupe.BUCKETS


def test_fold_of_frames_keeps_whole_numbers():
    """pandas tells times beside a null as fractions; the state, and the deadline made of it, stay whole. Rows come in any order."""
    rows = [(3, 1, 9000 * S), (1, 2, None), (2, 1, 8000 * S), (4, 2, 9500 * S)]
    other = {"pos": False, "low": False, "dup": False, "heard": False, "lat": None, "lon": 1.5, "sog": 1.0, "cog": 1.0, "heading": 5, "nav_status": 1, "name": "", "ship_type": 0, "kind": "vessel", "source": None, "station": "s", "msg_type": "m"}
    frame = pd.DataFrame([dict(zip(("seq", "mmsi", "t"), r, strict=True)) | other for r in rows])
    keys = {1: [7, *vessels.new_state()]}
    assert dedupe.fold_frames(iter([frame[:2], frame[2:]]), keys) == {1, 2}
    assert keys[1][0] == 7 and keys[2][0] is None
    for mmsi, seen, stale in ((1, 9000 * S, 0), (2, 9500 * S, 1)):
        state = dict(zip(vessels.STATE_NAMES, keys[mmsi][1:], strict=True))
        assert (state["seen"], state["n"], state["n_stale"], state["source"]) == (seen, 2, stale, None) and type(state["seen"]) is int
