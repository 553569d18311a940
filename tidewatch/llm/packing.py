"""Packing of documents into training sequences along a space-filling curve.

A document's token ids are hashed to a count vector, which a fixed random projection
takes to few dimensions. Their cells on a Hilbert curve are the sort key, so documents
of like content stand together. Partitions of the key's range are packed one after
another: ids fill sequences of ``length`` and documents are cut where a sequence is
full; what remains at a partition's end is cut at powers of two, which need no padding.

Defined results: null or blank text has the end id alone; equal keys are ordered by
doc_id (null first) and a hash of the ids; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import flat, materialize, mix, parts_of, slices
from tidewatch.llm.tokens import encoder, with_end

LENGTH, END_ID = 2048, 1
BUCKETS, DIMS, BITS = 256, 4, 8
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points with integer coordinates below ``2**bits``.

    Gray-code the coordinates from the highest bit down while undoing the curve's
    rotations and reflections, then interleave their bits.
    """
    x = np.array(cells, dtype=np.uint64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - np.uint64(1)
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - np.uint64(1)), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def curve_keys(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's projected vector of hashed token counts."""
    n = len(offsets) - 1
    hashed = (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n) * BUCKETS, np.diff(offsets)) + hashed, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    to = np.random.default_rng(11).standard_normal((BUCKETS, DIMS))
    cells = np.floor((np.tanh(0.8 * (counts @ to)) + 1) * (1 << BITS - 1))
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, key, ids (little-endian, two or four bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        for part in slices(batches, "text"):
            ids, offsets = with_end(*enc.encode(*flat(part.column("text"))), end_id)
            raw = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
            bounds = pa.py_buffer((offsets * width).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(curve_keys(ids, offsets)), pa.array(np.full(part.num_rows, width, np.int32)), pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, bounds, raw])],
                names=["doc_id", "key", "width", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, width int, ids binary")


class _Packer:
    """Cuts the documents of one partition into sequences; holds one open sequence."""

    def __init__(self, length: int, base: int):
        self.length, self.next, self.open, self.filled, self.rows = length, base, [], 0, []

    def add(self, doc_id, raw: memoryview) -> None:
        total, at = len(raw) // 4, 0
        while at < total:
            n = min(total - at, self.length - self.filled)
            self.open.append((doc_id, at, n, total, raw[4 * at : 4 * (at + n)]))
            self.filled, at = self.filled + n, at + n
            if self.filled == self.length:
                self._emit(self.open)
                self.open, self.filled = [], 0

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, n, total, raw in pieces:
            self.rows.append((doc_id, start, n, zlib.crc32(raw), total, self.next, offset))
            offset += n
        self.next += 1

    def close(self) -> None:
        """The open rest becomes sequences of the powers of two that it is the sum of."""
        left, pieces = self.filled, list(self.open)
        while left:
            room = 1 << left.bit_length() - 1
            left, taken = left - room, []
            while room:
                doc_id, start, n, total, raw = pieces.pop(0)
                k = min(n, room)
                taken.append((doc_id, start, k, total, raw[: 4 * k]))
                room -= k
                if k < n:
                    pieces.insert(0, (doc_id, start + k, n - k, total, raw[4 * k :]))
            self._emit(taken)
        self.open, self.filled = [], 0

    def take(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def packing(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = materialize(tokenized(docs, tokenizer, end_id), "packing")
    ordered = tokens.repartitionByRange(parts_of(docs.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id", F.xxhash64("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, width, ids in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids"), strict=True):
                packer.add(doc_id, memoryview(np.frombuffer(ids.as_buffer(), dtype=f"<u{width}").astype("<u4").tobytes()))
                if len(packer.rows) >= 20_000:
                    yield packer.take()
            yield packer.take()
        packer.close()
        yield packer.take()

    return ordered.select("doc_id", "width", "ids").mapInArrow(run, PIECE_SCHEMA)
