"""The ordered folds with one key that has most rows, against plain versions; no key's rows are collected in one row."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import folds, vessels


def rows(n=20_000):
    rng = random.Random(4)
    return [(i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.9 else f"k{i % 7}", i * 10 + rng.randrange(-40, 40)) for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_dedupe_and_limit_of_a_busy_key(spark):
    df = spark.createDataFrame(rows(), "seq long, key string, t long").repartition(5)
    last, limits, want = {}, {}, {}
    for i, k, t in rows():
        dup = k in last and abs(t - last[k]) < 60
        last[k] = last[k] if dup else t
        start, n = limits.get(k, (None, 0))
        limits[k] = (t, 1) if start is None or t - start > 100 else (start, n + 1)
        want[i] = dup, limits[k][1] <= 3
    judged, limited = folds.dedupe(df, ["key"], 60), folds.anchored_limit(df, ["key"], 100, 3)
    assert {r.seq: r.is_dup for r in judged.collect()} == {i: d for i, (d, _) in want.items()}
    assert {r.seq: r.allowed for r in limited.collect()} == {i: a for i, (_, a) in want.items()}
    assert "collect_list" not in plan(judged) + plan(limited)


def test_latest_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 100)
    rng = random.Random(5)
    data = [(i, rng.choice(["udp:a", "udp:a", "udp:b", "http:c", None]), rng.randrange(9), rng.random() < 0.01) for i in range(3000)]
    df = spark.createDataFrame(data, "seq long, source string, mmsi long, own boolean").repartition(3)
    label, known, want, values = {}, {}, {}, {}
    for i, s, m, own in data:
        if own and s and s.startswith("udp:"):
            label[s] = f"mmsi:{m}"
        if own:
            known[m] = i
        want[i], values[i] = label.get(s, s), known.get(m)
    told = folds.relabel(df, F.col("own"))
    assert {r.seq: r.label for r in told.collect()} == want and told.columns == [*df.columns, "label"]
    assert {r.seq: r.known for r in folds.last_known(df, F.when(F.col("own"), F.col("seq")), "known").collect()} == values
    assert "__block" in plan(told)


def test_vessel_fold_collects_nothing(spark):
    data = [(i, 7 if i % 3 else i, i * 1_000_000, 10.0 + i / 1e5, 20.0, 5.0, "kystverket", f"s{i % 4}", "" if i % 5 else f"n{i}", True) for i in range(9000)]
    out = vessels.vessel_fold(spark.createDataFrame(data, "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean").repartition(3))
    got = {r.mmsi: r for r in out.collect()}
    assert len(got) == 3001 and sum(r.n for r in got.values()) == 9000
    assert (got[7].n, got[7].seen, got[7].name, got[7].station) == (6000, 8_999_000_000, "n8995", "s3")
    assert "collect_list" not in plan(out)


def test_rows_without_a_time(spark):
    """They count and tell their static fields, but move nothing; the stream form of the dedupe passes them on."""
    from tidewatch.operators import vessels

    rows = [(0, 7, 100, 50.0, 1.0, "A", True), (1, 7, None, 51.0, 2.0, "B", True), (2, 8, None, 51.0, 2.0, "", True), (3, 7, 101, 52.0, 1.0, "", True)]
    df = spark.createDataFrame([(*r[:3], r[3], r[4], 3.0, s, "k", r[5], r[6], "PositionReport") for r in rows for s in ("udp:a",)], "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string")
    got = {r.mmsi: (r.seen, r.has_pos, r.lat, r.name, r.n, r.n_stale) for r in vessels.vessel_fold(df).collect()}
    assert got == {7: (101, True, 52.0, "B", 3, 1), 8: (None, False, None, None, 1, 1)}
    assert {r.seq: r.stale for r in vessels.vessel_stamps(df).collect()} == {0: False, 1: True, 2: True, 3: False}


def test_fan_out_of_small_large_and_world_boxes(spark):
    """One box, several that overlap, the whole world, a point; against the plain test of every pair."""
    import random

    from tidewatch.operators import subscribe

    rng = random.Random(6)
    points = [(i, i % 9, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(400, 1, 90.0, 180.0), (401, 2, None, None)]
    boxes = [(0, -90.0, -180.0, 90.0, 180.0), (1, 10.0, 10.0, 10.3, 10.4), (2, -5.0, -5.0, 20.0, 26.0), (2, 0.0, 0.0, 30.0, 30.0), (3, 89.0, 179.0, 90.0, 180.0), (4, 5.0, 5.0, 5.0, 5.0), (5, -60.0, -100.0, 60.0, 100.0)]
    for some in (boxes, boxes[1:2], boxes[:1], []):
        got = subscribe.fan_out(spark.createDataFrame(points, "seq long, mmsi long, lat double, lon double"), spark.createDataFrame(some, "sub long, min_lat double, min_lon double, max_lat double, max_lon double")).collect()
        want = {(s, i, m) for i, m, la, lo in points if la is not None for s, a, b, c, d in some if a <= la <= c and b <= lo <= d}
        assert sorted((r.sub, r.seq, r.mmsi) for r in got) == sorted(want)
