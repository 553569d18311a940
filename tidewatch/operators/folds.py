"""Ordered folds: rules whose outcome depends on what was kept before.

A fold takes a key's rows in arrival order: rows are dealt out by key, sorted in their
task, and only the rule's small state is carried from row to row, so a key may have any
number of rows. The latest value so far is taken per block of arrival numbers, with what
earlier blocks end with carried in, so a busy key is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import busy
from tidewatch.operators.vessels import dealt, nautical_miles

#: Arrival numbers of a block.
BLOCK = 65_536


def _flagged(df: DataFrame, key: list[str], name: str, step: Callable, read: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds ``name``. ``step(state, *read)`` gives the next state and a row's flag; a key's first state is None."""
    n = len(key)
    own = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state = None
        for batch in batches:
            flags = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, *read)), strict=True):
                if row[:n] != held:
                    held, state = row[:n], None
                state, flag = step(state, *row[n:])
                flags.append(flag)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*own, name])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*own).dtypes), f"{name} boolean"])
    return dealt(df.select(*own), *key).mapInArrow(run, schema)


def _ruled(df: DataFrame, key: list[str], rule, keys: DataFrame | None, block: int) -> DataFrame:
    """A rule as a fold per key; the keys in ``keys`` are spread over tasks by blocks of so many arrival numbers."""
    if keys is None:
        return _flagged(df, key, rule.name, rule.step, rule.read)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    rest = df.alias("a").join(keys.alias("b"), same, "left_anti")
    return _flagged(rest, key, rule.name, rule.step, rule.read).unionByName(busy.spread(df, key, rule, keys, block))


def dedupe(df: DataFrame, key: list[str], window_us: int, keys: DataFrame | None = None, block: int = busy.BLOCK) -> DataFrame:
    """Adds ``is_dup``: within ``window_us`` (either way) of the last row kept for the key. Duplicates don't extend the window.

    ``keys``: those with very many rows (``busy.busy_keys``), which are spread over tasks; ``df`` is then read three times.
    """
    return _ruled(df, key, busy.Dedupe(window_us), keys, block)


def anchored_limit(df: DataFrame, key: list[str], window_us: int, most: int, keys: DataFrame | None = None, block: int = busy.BLOCK) -> DataFrame:
    """Adds ``allowed``: at most ``most`` rows in a window that starts with the key's first row after the last window ended."""
    return _ruled(df, key, busy.Limit(window_us, most), keys, block)


def slots(df: DataFrame, key: list[str], frees: Column, most: int, keys: DataFrame | None = None, block: int = busy.BLOCK) -> DataFrame:
    """Adds ``granted``: of a key's streams at most ``most`` are open at a time; a refused one takes no slot, and rows that ``frees`` give one back."""
    return _ruled(df.withColumn("__frees", frees), key, busy.Slots(most), keys, block).drop("__frees")


def moved(df: DataFrame, key: list[str], radius_nm: float, fraction: float = 0.25) -> DataFrame:
    """Adds ``moved``: farther than that fraction of the radius from where the key last moved to. Rows without a position never are."""

    def step(at, lat, lon):
        if lat is None or lon is None:
            return at, False
        if at is None or nautical_miles(*at, lat, lon) > radius_nm * fraction:
            return (lat, lon), True
        return at, False

    return _flagged(df, key, "moved", step, ("lat", "lon"))


def pacer(df: DataFrame, key: list[str], unit_us: int, most: int) -> DataFrame:
    """The first ``most`` rows of each key and clock unit; a limit of 0 or less lets all pass."""
    if most <= 0:
        return df
    w = Window.partitionBy(*key, F.floor(F.col("t") / unit_us)).orderBy("seq")
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def _latest(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the latest value that isn't null of the key's rows so far, this one included."""
    rows = df.withColumns({"__value": value, "__block": F.floor(F.col("seq") / BLOCK)})
    ends = rows.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__at")).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("seq"))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("__key", "__at", before.alias("__before"))
    own = F.last("__value", ignorenulls=True).over(Window.partitionBy(key, "__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__own", own).join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__at")))
    return joined.withColumn(name, F.coalesce("__own", "__before")).drop("__value", "__block", "__key", "__at", "__before", "__own")


def relabel(df: DataFrame, own: Column) -> DataFrame:
    """UDP sources take the label of the latest own-ship report so far, including this row's."""
    udp = F.coalesce(F.col("source").startswith("udp:"), F.lit(False))
    # only these rows can change, so only they are dealt out
    known = _latest(df.where(udp), "source", F.when(own, F.concat(F.lit("mmsi:"), F.col("mmsi").cast("string"))), "label")
    return known.withColumn("label", F.coalesce("label", "source")).unionByName(df.where(~udp).withColumn("label", F.col("source")))


def last_known(df: DataFrame, value: Column, name: str) -> DataFrame:
    return _latest(df, "mmsi", value, name)
