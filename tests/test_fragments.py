"""Reassembly against a plain walk over a station's sentences, in one batch and as a stream of several."""

import random

import pytest

from tests.test_streams import in_batches
from tidewatch.operators import fragments
from tidewatch.streaming import dedupe
from tidewatch.streaming import fragments as stream_form

SCHEMA = "seq long, station string, recv_t long, talker string, kind string, total int, num int, seqid string, channel string, payload string, fill int, line string"
S = 1_000_000


def sentences(parts, station="s"):
    """Rows of (fragments in all, number, sequence id) as they come."""
    return [(i, station, i * S, "AI", "VDM", total, num, str(seqid), "A", f"p{i}", 0, f"l{i}") for i, (total, num, seqid) in enumerate(parts)]


def plain(rows):
    """seq of each last fragment with the payloads of its message."""
    held, heard, out = {}, {}, {}
    for seq, station, _, talker, kind, total, num, seqid, channel, payload, *_ in sorted(rows, key=lambda r: r[0]):
        n = heard[station] = heard.get(station, -1) + 1
        key = (station, total, seqid, channel, kind, talker)
        if total == 1:
            continue
        if num == 1:
            held[key] = [n, [payload]]
        elif key in held and n - held[key][0] <= 32 and len(held[key][1]) == num - 1:
            held[key] = [n, [*held[key][1], payload]]
            if num == total:
                out[seq] = "".join(held.pop(key)[1])
        elif key in held and n - held[key][0] > 32:
            del held[key]
    return out


def read(spark, rows):
    return {r.seq: r.payload for r in fragments.whole_messages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


@pytest.mark.parametrize(
    ("parts", "ends"),
    [
        ([(2, 1, 0), (2, 2, 0), (2, 2, 0)], [1]), ([(2, 1, 0), (2, 1, 0), (2, 2, 0), (2, 2, 0)], [2]), ([(2, 2, 0), (2, 1, 0)], []), ([(2, 1, 0), (2, 2, 0), (2, 2, 0), (2, 1, 0), (2, 2, 0)], [1, 4]),
        ([(3, 1, 0), (2, 1, 0), (3, 2, 0), (2, 2, 0), (3, 3, 0)], [3, 4]), ([(3, 1, 0), (3, 3, 0), (3, 2, 0), (3, 3, 0)], [3]), ([(2, 1, 0)] + [(1, 1, 0)] * 31 + [(2, 2, 0)], [32]), ([(2, 1, 0)] + [(1, 1, 0)] * 32 + [(2, 2, 0)], []),
    ],
)
def test_cases(spark, parts, ends):
    got = read(spark, sentences(parts))
    assert sorted(got) == ends and got == plain(sentences(parts))


def many(n, stations=("a", "b", None)):
    rng = random.Random(4)
    out = []
    for i in range(n):
        total = rng.choice([1, 1, 2, 2, 3, 5])
        out.append((i, rng.choice(stations), i * S, rng.choice(["AI", "BS"]), "VDM", total, rng.randint(1, total) if rng.random() < 0.5 else 1 + i % total, rng.choice("01") if total > 1 else "", rng.choice("AB"), f"p{i}", 0, f"l{i}"))
    return out


def test_blocks_of_a_busy_station(spark, monkeypatch):
    """Blocks that begin in the midst of messages tell the same as one pass; spans of arrival numbers too."""
    rows = many(3000)
    want = plain(rows)
    assert len(want) > 100 and read(spark, rows) == want
    monkeypatch.setattr(fragments, "BLOCK", 300)
    monkeypatch.setattr(fragments, "SPAN", 64)
    assert read(spark, rows) == want


def test_columns_and_no_rows(spark):
    df = spark.createDataFrame(sentences([(2, 1, 0), (2, 2, 0)]), SCHEMA).selectExpr("*", "seq * 10 as n", "'x' as nmea_of")
    (r,) = fragments.whole_messages(df).collect()
    assert (r.payload, list(r.nmea), r.n, r.recv_t, r.nmea_of) == ("p0p1", ["l0", "l1"], 10, S, "x")
    assert fragments.whole_messages(df.limit(0)).count() == 0


def test_stream_over_batches(spark):
    """Messages whose fragments come in different batches; the state goes on from one to the next."""
    rows = many(600, ("a", "b"))
    singles = {r[0]: r[9] for r in rows if r[5] == 1}
    with stream_form.store(spark):
        stream, base = in_batches(spark, [rows[a : a + 120] for a in range(0, 600, 120)], SCHEMA)
        got = dedupe.run_to_end(stream_form.stream_messages(stream), base).collect()
    assert {r.seq: r.payload for r in got} == plain(rows) | singles and len(got) == len(plain(rows) | singles)


def test_stream_forgets_a_silent_station(spark):
    """Two days later the timer has cleared the station: a second fragment finds nothing, and its sentences are counted anew."""
    day = 86_400
    at = lambda seq, t, station, num: (seq, station, t * S, "AI", "VDM", 2, num, "0", "A", f"p{seq}", 0, f"l{seq}")
    batches = [[at(0, 0, "a", 1)], [at(1, 10, "b", 1)], [at(2, 3 * day, "b", 2)], [at(3, 3 * day + 60, "b", 1)], [at(4, 3 * day + 70, "a", 2), at(5, 3 * day + 70, "b", 2)]]
    with stream_form.store(spark):
        stream, base = in_batches(spark, batches, SCHEMA)
        got = dedupe.run_to_end(stream_form.stream_messages(stream), base).collect()
    assert {r.seq: r.payload for r in got} == {2: "p1p2", 5: "p3p5"}
