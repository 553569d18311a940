"""Streams over several batches: the state goes on from batch to batch, late rows are folded, old state goes."""

import random

from tidewatch.operators import vessels
from tidewatch.plans import scratch
from tidewatch.streaming import dedupe, windows

S = 1_000_000


def in_batches(spark, batches, schema):
    """A stream that reads one batch at a time."""
    base = scratch.new_path(spark, "stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{base}/in"), base


def test_dedupe_over_batches(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(5)}", i, 9000 * S + i * 2 * S + rng.randrange(-3, 3) * S) for i in range(90)]
    stream, base = in_batches(spark, [rows[:30], rows[30:60], rows[60:]], "payload string, seq long, t long")
    last, want = {}, {}
    for p, i, t in rows:
        want[i] = p in last and abs(t - last[p]) < 10 * S
        last[p] = last[p] if want[i] else t
    got = dedupe.run_to_end(dedupe.stream_dedupe(stream, 10 * S), base)
    assert {r.seq: r.is_dup for r in got.collect()} == want


def test_late_copies_over_batches(spark):
    """A copy in a later batch is a copy, also with an earlier time; days later its key's state has gone and it is judged anew."""
    day = 86_400 * S
    rows = [[("a", 0, 5 * day)], [("b", 1, 5 * day + 900 * S)], [("a", 2, 5 * day - 9 * S)], [("b", 3, 9 * day)], [("b", 4, 9 * day + 60 * S)], [("a", 5, 9 * day + 70 * S)]]
    stream, base = in_batches(spark, rows, "payload string, seq long, t long")
    got = {r.seq: r.is_dup for r in dedupe.run_to_end(dedupe.stream_dedupe(stream, 10 * S), base).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}


def test_vessels_over_batches(spark):
    rng = random.Random(3)
    rows = [(i, 100 + i % 3, 9000 * S + i * S * 60 - (900 * S if i % 7 == 0 else 0), 10 + i / 1000, 20.0, 5.0, "kystverket" if i % 2 else "udp:a", f"s{i % 4}", f"n{i}" if rng.random() < 0.3 else "", i % 5 != 0, "PositionReport") for i in range(60)]
    schema = "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string"
    prepared = [vessels.prepared(spark.createDataFrame(rows[a : a + 20], schema)) for a in (0, 20, 40)]
    stream, base = in_batches(spark, [[tuple(r) for r in p.collect()] for p in prepared], prepared[0].schema)
    told = dedupe.run_to_end(dedupe.stream_vessels(stream), base, "update")
    want = {r.mmsi: r for r in vessels.vessel_fold(spark.createDataFrame(rows, schema)).collect()}
    got = {}
    for r in told.collect():
        if r.mmsi not in got or r.n + r.n_jump > got[r.mmsi].n + got[r.mmsi].n_jump:
            got[r.mmsi] = r
    assert {m: tuple(r) for m, r in got.items()} == {m: tuple(r) for m, r in want.items()}


def test_hours_over_batches(spark):
    rows = [(i * 600 * S, "A" if i % 3 else "B") for i in range(60)]
    stream, base = in_batches(spark, [rows[:20], rows[20:40], rows[40:]], "t long, msg_type string")
    got = windows.latest(dedupe.run_to_end(windows.hourly_counts(stream), base, "update"), "start_t", "msg_type")
    want = {}
    for t, k in rows:
        want[t // (3600 * S) * 3600 * S, k] = want.get((t // (3600 * S) * 3600 * S, k), 0) + 1
    assert {(r.start_t, r.msg_type): r.events for r in got.collect()} == want


def test_restored_stream_equals_one_that_ran_through(spark):
    """Stopped after two of five batches, saved as JSON, and started from it: the same states as without a stop, and as the fold."""
    from tidewatch.streaming import fragments
    from tidewatch.streaming import vessels as saved

    rng = random.Random(9)
    schema = "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string"
    rows = [(i, 100 + i % 6, 9000 * S + i * S * 20 - (300 * S if i % 7 == 0 else 0), 10 + i / 1000 + (5 if i % 11 == 0 else 0), 20.0, 5.0, "kystverket" if i % 2 else "udp:a", f"s{i % 4}", f"n{i}" if rng.random() < 0.3 else "", i % 5 != 0, "PositionReport") for i in range(200)]
    batches = [[tuple(r) for r in vessels.prepared(spark.createDataFrame(rows[a : a + 40], schema)).collect()] for a in range(0, 200, 40)]
    kind = vessels.prepared(spark.createDataFrame([], schema)).schema
    last = lambda told: {m: max((tuple(r) for r in told if r.mmsi == m), key=lambda r: sum(r[-3::2])) for m in {r.mmsi for r in told}}

    def run(parts, restored=None):
        with fragments.store(spark):
            stream, base = in_batches(spark, parts, kind)
            return last(dedupe.run_to_end(saved.stream_states(stream, restored), base).collect())

    want = {r.mmsi: tuple(r) for r in vessels.vessel_fold(spark.createDataFrame(rows, schema)).collect()}
    assert run(batches) == want
    path, now = scratch.new_path(spark, "snapshots"), 9000 * S + 80 * 20 * S
    assert saved.latest(spark, path) is None
    first = spark.createDataFrame(list(run(batches[:2]).values()), saved.OUT)
    saved.save(first.where("mmsi < 103"), path, now - 1)
    saved.save(first, path, now)
    restored = saved.restore(spark, saved.latest(spark, path), now)
    assert restored.count() == 6 and run(batches[2:], restored) == want
    assert saved.restore(spark, saved.latest(spark, path), now + 1800 * S).count() == 0


def test_a_silent_vessel_is_forgotten(spark):
    """Its timer fires when the watermark has passed; heard again, it begins from nothing, and others go on."""
    from tidewatch.streaming import fragments
    from tidewatch.streaming import vessels as saved

    day = 86_400 * S
    schema = "seq long, mmsi long, t long, lat double, lon double, sog double, source string, station string, name string, pos boolean, msg_type string"
    row = lambda i, m, t, name: (i, m, t, 10.0, 20.0, 5.0, "kystverket", "s", name, True, "PositionReport")
    rows = [[row(0, 1, 10 * day, "A"), row(1, 2, 10 * day, "B")], [row(2, 2, 12 * day, "")], [row(3, 2, 12 * day + 60 * S, "")], [row(4, 1, 12 * day + 61 * S, "")]]
    batches = [[tuple(r) for r in vessels.prepared(spark.createDataFrame(b, schema)).collect()] for b in rows]
    with fragments.store(spark):
        stream, base = in_batches(spark, batches, vessels.prepared(spark.createDataFrame([], schema)).schema)
        got = {(r.mmsi, r.seen): (r.name, r.n) for r in dedupe.run_to_end(saved.stream_states(stream), base).collect()}
    assert got[1, 12 * day + 61 * S] == (None, 1) and got[2, 12 * day] == ("B", 2)
