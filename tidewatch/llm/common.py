"""Shared helpers: scratch tables on the shared folder, Arrow slices, word and shingle kernels.

The kernels work on the UTF-8 bytes of a slice of documents at a time. A slice
holds at most ``SLICE_BYTES`` bytes, or one document if that is longer, so the
memory of a task follows its longest document and not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.scratch import new_path

SLICE_BYTES = 2_000_000
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C17, -1, 1 << 64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def materialize(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (with ``options`` of the writer) and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options or {}).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_words(text: str) -> Column:
    """Whether a column of texts holds more than white space; false of null."""
    return F.coalesce(F.btrim(F.col(text), F.lit("".join(map(chr, SPACES)))) != "", F.lit(False))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, one after another, and the offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds at most ``most`` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = np.cumsum(sizes)
        at, n = 0, batch.num_rows
        while at < n:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling sum and of its inverse, mod 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of table[byte] * base**position over i <= position < j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word, a run without white space inside one document."""
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = edges[edges > 0]
    last[edges - 1] = word[edges - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """For every document the sorted distinct 64-bit hashes of its ``words``-word shingles.

    A-Z is lower-cased. A document with fewer words has its whole sequence as the one
    shingle; one without words has the empty set.
    """
    n = len(offsets) - 1
    data = _LOWER[data]
    starts, ends, docs = word_bounds(data, offsets)
    hashed = range_hash(prefix_sums(data), starts, ends)
    counts = np.bincount(docs, minlength=n) if len(docs) else np.zeros(n, np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = len(hashed)
    padded = np.concatenate([hashed, np.zeros(words, np.uint64)])
    acc = np.zeros(total, np.uint64)
    for k in range(words):
        acc = acc * _SHINGLE + padded[k : k + total]
    acc = mix(acc)
    out = []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= words:
            s = np.sort(acc[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                short = mix(short * _SHINGLE + hashed[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
