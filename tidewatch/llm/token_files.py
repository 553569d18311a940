"""Token files: a concatenated id array in blocks, with document boundaries in Elias-Fano form.

A token file is a Parquet dataset whose rows are blocks of the one id array, in
ascending ``doc_id`` order: the ids as little-endian integers of two bytes (four if
the vocabulary needs them) and the starts of the block's documents as an Elias-Fano
sequence with a select structure, about ``2 + log2(ids / documents)`` bits a document.
Blocks are self-contained, so any of them can be read alone and a lost task is redone
by itself; where a shard begins follows from the ids of the shards before it.

Defined results: null or blank text has the end id alone; null doc_id sorts first; of
rows with the same doc_id, order follows a hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import flat, materialize, parts_of, slices
from tidewatch.llm.tokens import encoder, with_end

END_ID = 2
_HEAD = struct.Struct("<qqB")
_SAMPLE = 64
FILE_SCHEMA = "shard int, block int, block_start long, n_docs int, n_ids long, width int, doc_ids array<bigint>, bounds binary, ids binary"


class EliasFano:
    """A non-decreasing sequence of integers in ``[0, top]``: low bits packed, high bits in unary."""

    def __init__(self, n: int, top: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        bits[ones] = 1
        pack = lambda b: np.packbits(b.astype(np.uint8), bitorder="little").tobytes()
        return cls(n, top, low_bits, pack(low.reshape(-1)), pack(bits), ones[::_SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.top, self.low_bits)
        return head + struct.pack("<qqq", len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, top, low_bits = _HEAD.unpack_from(raw)
        sizes = struct.unpack_from("<qqq", raw, _HEAD.size)
        at, parts = _HEAD.size + 24, []
        for x in sizes:
            parts.append(raw[at : at + x])
            at += x
        return cls(n, top, low_bits, *parts)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Position of the i-th one: a sample near it, then whole bytes by their counts of ones."""
        at = struct.unpack_from("<I", self.samples, 4 * (i // _SAMPLE))[0]
        left = i % _SAMPLE
        byte = self.high[at // 8] >> (at % 8) << (at % 8)
        k = at // 8
        while (ones := byte.bit_count()) <= left:
            left -= ones
            k += 1
            byte = self.high[k]
        for _ in range(left):
            byte &= byte - 1
        return 8 * k + (byte & -byte).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        high, low, at = self.select(i) - i, 0, i * self.low_bits
        for b in range(self.low_bits):
            low |= (self.low[(at + b) // 8] >> ((at + b) % 8) & 1) << b
        return (high << self.low_bits) | low

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            out |= bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the token file of ``docs`` and return it as read back."""
    spark = docs.sparkSession
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(parts_of(spark), "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        for k, part in enumerate(slices(batches, "text")):
            ids, offsets = with_end(*enc.encode(*flat(part.column("text"))), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([part.num_rows], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id").cast(pa.int64())),
                    pa.array([EliasFano.of(offsets[:-1]).to_bytes()], pa.binary()), pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()),
                ],
                names=["shard", "block", "block_start", "n_docs", "n_ids", "width", "doc_ids", "bounds", "ids"],
            )
            start += len(ids)

    return materialize(ordered.mapInArrow(blocks, FILE_SCHEMA), "tokens")


def read_tokens(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks of a token file."""
    # One row per shard, and there are as many shards as write partitions: bounded.
    totals = sorted(tuple(r) for r in file.groupBy("shard").agg(F.sum("n_ids")).collect())
    before, bases = 0, {}
    for shard, n in totals:
        bases[shard] = before
        before += n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                width, n_ids = one["width"].as_py(), one["n_ids"].as_py()
                ids = np.frombuffer(one["ids"].as_buffer(), dtype=f"<u{width}").astype("<u4")
                bounds = EliasFano.from_bytes(one["bounds"].as_py())
                starts = np.fromiter((bounds[i] for i in range(len(bounds))), np.int64, len(bounds))
                raw, ends = memoryview(ids.tobytes()), np.concatenate([starts[1:], [n_ids]])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [one["doc_ids"].values, pa.array(starts + (bases[one["shard"].as_py()] + one["block_start"].as_py())), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return file.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer, end_id))
