"""Rules spread over blocks of busy keys against the same rules row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import busy, folds


def walk(rule, rows):
    state, out = None, []
    for r in rows:
        state, flag = rule.step(state, r)
        out.append((state, flag))
    return out


def times(rng, n, kind):
    if kind == "rising":
        return sorted(rng.randrange(n * 4) for _ in range(n))
    if kind == "equal":
        return [7] * n
    if kind == "falling":
        return sorted((rng.randrange(n * 4) for _ in range(n)), reverse=True)
    out = [i * 3 + rng.randrange(-40, 40) for i in range(n)]
    return [None if kind == "gaps" and rng.random() < 0.05 else t for t in out]


@pytest.mark.parametrize("kind", ["rising", "equal", "falling", "mixed", "gaps"])
def test_maps_of_blocks(kind):
    """Block by block the map leads where the walk does, from whatever state it is entered with."""
    rng = random.Random(kind)
    for _ in range(150):
        rule = rng.choice([busy.Dedupe(rng.randrange(1, 60)), busy.Limit(rng.randrange(0, 60), rng.randrange(1, 5))])
        rows = times(rng, rng.randrange(1, 60), kind)
        for state in [None, *([t, 1] if isinstance(rule, busy.Limit) else t for t in range(-70, 260, 7))]:
            want = state
            for r in rows:
                want, _ = rule.step(want, r)
            got = rule.enter(rule.summary([rows if None in rows else np.array(rows)]), state)
            assert (list(got) if isinstance(rule, busy.Limit) else got) == want, (type(rule), rows, state)


def test_maps_of_slots():
    rng = random.Random(5)
    for _ in range(100):
        rule, rows = busy.Slots(rng.randrange(1, 6)), [rng.random() < 0.4 for _ in range(rng.randrange(1, 40))]
        for state in range(rule.most + 1):
            assert rule.enter(rule.summary([rows]), state) == walk_from(rule, rows, state)


def walk_from(rule, rows, state):
    for r in rows:
        state, _ = rule.step(state, r)
    return state


def test_spread_equals_fold(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None, None, None]), i * 2 + rng.randrange(-30, 30) if i % 50 else None, i % 3 == 0, f"x{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "seq long, k string, t long, free boolean, other string").repartition(3)
    keys = busy.busy_keys(df, ["k"], 1000)
    assert {r.k for r in keys.collect()} == {"hot", None}
    for f in (lambda d, x: folds.dedupe(d, ["k"], 25, x, 500), lambda d, x: folds.anchored_limit(d, ["k"], 40, 3, x, 500), lambda d, x: folds.slots(d, ["k"], F.col("free"), 4, x, 500)):
        plain, wide = f(df, None), f(df, keys)
        assert plain.columns == wide.columns
        assert sorted(map(tuple, plain.collect()), key=lambda r: r[0]) == sorted(map(tuple, wide.collect()), key=lambda r: r[0])
