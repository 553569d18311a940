"""Ordered rules for busy keys, whose rows are too many for one task.

A rule carries a small state from row to row, so a block of a key's rows is a map from the
state on entering it to the state on leaving it. Such a map is told by few numbers:

* A greedy rule (the dedupe, the limiter) forgets what was before once it keeps a row. From every row of the
  block the rows kept after it follow, so the state on leaving is known for each row that could be the first
  one kept. Which one that is depends on the state entering by a few thresholds only, the running
  extremes of the block's times; thresholds with the same outcome are one.
* A rule with few states (the slots) is its table.

Maps of a key's blocks are applied one after another, which reads some numbers a block and no rows; then every
block is walked from its own entering state. Blocks are ranges of arrival numbers, so all tasks
have work however few the busy keys are. The outcome is that of the plain fold.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.scratch import written

#: Rows from which on a key is busy; arrival numbers of a block.
BUSY, BLOCK = 1_000_000, 65_536
_FIRST, _EARLY = -(1 << 63), -(1 << 62)


def busy_keys(df: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """Keys with more than ``most`` rows: at most one for that many rows of the table."""
    return written(df.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > (BUSY if most is None else most)).select(*key), "busy")


class _Chain:
    """The rows of a block that follow from one another: after a kept row, the next that is ``gap`` later or (``both``) earlier is kept."""

    def __init__(self, times: np.ndarray, gap: int, both: bool):
        n = len(times)
        self.times, self.gap, self.both, self.n = times, gap, both, n
        self.highest, self.lowest = np.maximum.accumulate(times), np.minimum.accumulate(times)
        # while no earlier row is past a row's bound, the running extreme passes it where the first later row does
        ahead = np.searchsorted(self.highest, times + gap)
        still = np.minimum.accumulate(times[::-1])[::-1]
        back = both and n > 1 and bool((still[1:] <= times[:-1] - gap).any())
        self.next = self._met(times) if back or (self.highest >= times + gap).any() else ahead
        last, follows = list(range(n)), self.next.tolist()
        for i in range(n - 1, -1, -1):
            if follows[i] < n:
                last[i] = last[follows[i]]
        #: Of each row, the last one kept if it is kept.
        self.last = np.array([*last, -1], np.int64)

    def _met(self, times: np.ndarray) -> np.ndarray:
        """The next row to be kept after each, whatever the order of times: from the last row on, with the later rows that pass all before them."""
        high, high_t, low, low_t, out = [], [], [], [], [self.n] * self.n
        times = times.tolist()
        for i in range(self.n - 1, -1, -1):
            t = times[i]
            k = bisect_right(high_t, -t - self.gap)
            found = high[k - 1] if k else self.n
            if self.both and (k := bisect_right(low_t, t - self.gap)):
                found = min(found, low[k - 1])
            out[i] = found
            while high_t and high_t[-1] >= -t:
                high.pop(), high_t.pop()
            high.append(i), high_t.append(-t)
            while low_t and low_t[-1] >= t:
                low.pop(), low_t.pop()
            low.append(i), low_t.append(t)
        return np.array(out, np.int64)

    def first(self, entered) -> np.ndarray:
        """The first row kept when the block is entered with these times."""
        entered = np.asarray(entered, np.int64)
        found = np.searchsorted(self.highest, entered + self.gap)
        return np.minimum(found, np.searchsorted(-self.lowest, self.gap - entered)) if self.both else found

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Entering times at which the last row kept changes, and that row below the first and from each on (-1: none is kept)."""
        rise = self.highest[np.concatenate([[True], np.diff(self.highest) > 0])] - self.gap + 1
        fall = self.lowest[np.concatenate([[True], np.diff(self.lowest) < 0])] + self.gap if self.both else rise[:0]
        cuts = np.unique(np.concatenate([rise, fall]))
        told = self.last[self.first(np.concatenate([[cuts[0] - 1], cuts]))]
        changed = np.flatnonzero(np.diff(told))
        return cuts[changed], told[np.concatenate([[0], changed + 1])]

    def kept(self, first: int) -> list[int]:
        out, follows = [], self.next.tolist()
        while first < self.n:
            out.append(first)
            first = follows[first]
        return out


class Greedy:
    """The next row to be kept is the first one that is far enough from the last: ``window_us`` later or, if ``both``, earlier.

    A block's map: entering times in order at which the outcome changes, the outcomes between
    them (null where no row is kept), and the outcome without a state before.
    """

    def __init__(self, window_us: int, both: bool, strict: bool):
        self.window, self.both, self.gap = window_us, both, window_us + strict

    def chain(self, times: np.ndarray | list) -> _Chain | None:
        """None if a row has no time: only then the times are a list."""
        return _Chain(np.asarray(times, np.int64), self.gap, self.both) if isinstance(times, np.ndarray) or None not in times else None

    def walked(self, times: np.ndarray | list, state) -> tuple[list[bool], object]:
        flags = []
        for t in times.tolist() if isinstance(times, np.ndarray) else times:
            state, flag = self.step(state, t)
            flags.append(flag)
        return flags, state


class Dedupe(Greedy):
    """State: the time of the last kept row. A row without a time is kept and forgets it."""

    name, read = "is_dup", ("t",)

    def __init__(self, window_us: int):
        super().__init__(window_us, True, False)

    def step(self, last, t):
        dup = last is not None and t is not None and abs(t - last) < self.window
        return (last if dup else t), dup

    def summary(self, columns: list[list]) -> list:
        (times,) = columns
        chain = self.chain(times)
        if chain is None:
            # from the last row without a time on, the state before doesn't matter
            gap = max(i for i, t in enumerate(times) if t is None)
            return ["always", self.walked(times[gap:], None)[1]]
        cuts, told = chain.cuts()
        return ["map", cuts.tolist(), [int(times[i]) if i >= 0 else None for i in told.tolist()], int(times[chain.last[0]])]

    def enter(self, summary: list, state):
        if summary[0] == "always":
            return summary[1]
        _, cuts, told, fresh = summary
        if state is None:
            return fresh
        got = told[bisect_right(cuts, state)]
        return state if got is None else got

    def flags(self, columns: list[list], state) -> list[bool]:
        (times,) = columns
        chain = self.chain(times)
        if chain is None:
            return self.walked(times, state)[0]
        out = np.ones(len(times), bool)
        out[chain.kept(int(chain.first(state)) if state is not None else 0)] = False
        return out.tolist()


class Limit(Greedy):
    """State: when the window began, and how many rows it has had. A row without a time belongs to the window, or begins one that has none."""

    name, read = "allowed", ("t",)

    def __init__(self, window_us: int, most: int):
        super().__init__(window_us, False, True)
        self.most = most

    def step(self, state, t):
        start, n = state or (None, 0)
        start, n = (t, 1) if start is None or t is not None and t - start > self.window else (start, n + 1)
        return [start, n], n <= self.most

    def summary(self, columns: list[list]) -> list:
        (times,) = columns
        fresh = self.walked(times, None)[1]
        # in an open window a row without a time is as one that is as early as can be
        held = times if isinstance(times, np.ndarray) else [_EARLY if t is None else t for t in times]
        cuts, told = self.chain(held).cuts()
        return [len(times), cuts.tolist(), [[int(held[i]), len(times) - i] if i >= 0 else None for i in told.tolist()], fresh]

    def enter(self, summary: list, state):
        n, cuts, told, fresh = summary
        if state is None or state[0] is None:
            return fresh
        got = told[bisect_right(cuts, state[0])]
        return [state[0], state[1] + n] if got is None else got

    def flags(self, columns: list[list], state) -> list[bool]:
        (times,) = columns
        chain = self.chain(times)
        if chain is None or state is not None and state[0] is None:
            return self.walked(times, state)[0]
        begins = chain.kept(int(chain.first(state[0])) if state is not None else 0)
        at = np.arange(len(times))
        place = at + 1 + (state[1] if state is not None else 0)
        if begins:
            starts = np.array(begins)
            own = np.searchsorted(starts, at, side="right") - 1
            place = np.where(own >= 0, at - starts[own] + 1, place)
        return (place <= self.most).tolist()


class Slots:
    """State: how many streams are open, of at most ``most``."""

    name, read = "granted", ("__frees",)

    def __init__(self, most: int):
        self.most = most

    def step(self, n, free):
        n = n or 0
        if free:
            return max(n - 1, 0), False
        return (n + 1, True) if n < self.most else (n, False)

    def summary(self, columns: list[list]) -> list[int]:
        after = np.arange(self.most + 1)
        for free in columns[0]:
            after = np.maximum(after - 1, 0) if free else np.minimum(after + 1, self.most)
        return after.tolist()

    def enter(self, summary: list[int], state):
        return summary[state or 0]

    def flags(self, columns: list[list], state) -> list[bool]:
        out = []
        for free in columns[0]:
            state, flag = self.step(state, free)
            out.append(flag)
        return out


def _starts(batch: pa.RecordBatch, names: list[str]) -> list[int]:
    """Places where one of these columns differs from the row before, and the end."""
    differ = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        a, b = batch.column(name).slice(0, batch.num_rows - 1), batch.column(name).slice(1)
        differ |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(differ) + 1).tolist(), batch.num_rows] if batch.num_rows else []


def _values(arrays: list[pa.Array]) -> np.ndarray | list:
    """A column's values; a list if some are null or it holds no whole numbers."""
    whole = pa.concat_arrays(arrays)
    return whole.to_numpy(zero_copy_only=False) if not whole.null_count and pa.types.is_int64(whole.type) else whole.to_pylist()


def spread(df: DataFrame, key: list[str], rule, busy: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``busy`` keys with the rule's flag."""
    own = [c for c in df.columns if c != rule.name]
    n, read = len(key), rule.read
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    hot = df.select(*own).alias("a").join(busy.alias("b"), same, "left_semi").withColumn("__block", F.floor(F.col("seq") / block))
    hot = written(hot, "busy")
    kinds = dict(hot.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[list[pa.Array]] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(held, types, strict=True)), pa.array([json.dumps(rule.summary([_values(x) for x in rows]))])], names=[*key, "__block", "__map"])

        for batch in batches:
            places, types = [batch.column(c) for c in (*key, "__block")], [batch.column(c).type for c in (*key, "__block")]
            starts = _starts(batch, [*key, "__block"])
            for a, b in zip(starts, starts[1:], strict=False):
                at = tuple(c[a].as_py() for c in places)
                if at != held:
                    if held is not None:
                        yield told()
                    held, rows = at, [[] for _ in read]
                for x, c in zip(rows, read, strict=True):
                    x.append(batch.column(c).slice(a, b - a))
        if held is not None:
            yield told()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state = None
        for batch in batches:
            entries = []
            for *at, told in zip(*(batch.column(c).to_pylist() for c in (*key, "__map")), strict=True):
                if at != held:
                    held, state = at, None
                entries.append(json.dumps(state))
                state = rule.enter(json.loads(told), state)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "__block")), pa.array(entries, pa.string())], names=[*key, "__block", "__entry"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            # a block's first row brings the state on entering it
            entry = json.loads(held[0].column("__entry")[0].as_py())
            held[0] = held[0].slice(1)
            flags = rule.flags([_values([batch.column(c) for batch in held]) for c in read], entry) if sum(b.num_rows for b in held) else []
            done = 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(flags[done : done + batch.num_rows], pa.bool_())], names=[*own, rule.name])
                done += batch.num_rows

        for batch in batches:
            starts = [*np.flatnonzero(batch.column("__entry").is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            if starts[0]:
                held.append(batch.slice(0, starts[0]))
            for a, b in zip(starts, starts[1:], strict=False):
                if held:
                    yield from told()
                held = [batch.slice(a, b - a)]
        if held:
            yield from told()

    # as many tasks as the session shuffles into: the work behind is too slow for few
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = hot.select(*key, "__block", "seq", *(c for c in read if c not in key))
    maps = slim.repartition(tasks, *key, "__block").sortWithinPartitions(*key, "__block", "seq").mapInArrow(summaries, f"{keys}, __block long, __map string")
    entries = maps.repartition(*key).sortWithinPartitions(*key, "__block").mapInArrow(scan, f"{keys}, __block long, __entry string")
    entries = entries.withColumn("seq", F.lit(_FIRST).cast(kinds["seq"]) if kinds["seq"] == "bigint" else F.lit(-(1 << 31)).cast(kinds["seq"]))
    both = hot.withColumn("__entry", F.lit(None).cast("string")).unionByName(entries, allowMissingColumns=True)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), f"{rule.name} boolean"])
    return both.repartition(tasks, *key, "__block").sortWithinPartitions(*key, "__block", "seq").mapInArrow(replay, schema)
