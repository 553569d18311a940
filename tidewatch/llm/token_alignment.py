"""Alignment of two tokenizers' tokens: a byte-level BPE (A) and a sentencepiece model with byte fallback (B).

Both encode a space and the text. The tokenizers library tells every token's characters, sentencepiece
the bytes of every piece's surface. Where a token ends and the next one begins at the same place,
that place is a coarse cut, and known in bytes. Between such cuts stand the tokens
that share a character or fall back to bytes; their ends follow from the bytes that they decode to. Places where tokens of both end
cut the text into groups, and inside a group the byte ranges that overlap give the links.

Neither tokenizer merges across certain places: A not between pre-tokens, B not between two characters that stand
side by side in no piece. So a text falls into units, each aligned once per Python worker;
what holds of a text is put together from its units. Texts come in blocks; a block lists its
different pairs with their numbers. The numbers are added up over all blocks, and every
block gets back the counts of just its own pairs, so no table of all pairs is sent anywhere.

Defined results: texts that are null or empty, or whose joined bytes aren't the space and the text in both, have no
tokens, and zeros; repeated rows count each; a null doc_id stays; a text of any length is one block at most.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, slices
from tidewatch.llm.pretokens import Ragged, Splitter, byte_letters, tokenizers_matches

#: Bytes of text of a block: the pairs of that much are held at a time, and a block is one row.
BLOCK_BYTES = 2_000_000
#: A file's writer and its readers hold a whole row group, by default of 100 rows at least: 100 blocks would be too many.
_ONE_A_GROUP = {"parquet.block.row.count.limit": 1}
#: Units (and characters of theirs) that a worker remembers, and how many of the first ones it keeps when it starts anew.
REMEMBERED, FIRST, REMEMBERED_CHARS = 500_000, 200_000, 16_000_000
AT_A_TIME = 2_000
_SHIFT = 32
_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligner:
    def __init__(self, byte_path: str, piece_path: str, pattern: str):
        import os

        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb2

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_letters())}
        self.raw_a = {i: bytes(map(back.get, t)) for t, i in self.a.get_vocab().items() if all(c in back for c in t)}
        with open(piece_path, "rb") as file:
            model = pb2.ModelProto.FromString(file.read())
        # units bring their own space
        model.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kind = pb2.ModelProto.SentencePiece
        self.raw_b = {i: bytes([int(_BYTE.fullmatch(p.piece)[1], 16)]) if p.type == kind.BYTE else p.piece.replace("▁", " ").encode() for i, p in enumerate(model.pieces)}
        pieces = [p.piece.replace("▁", " ") for p in model.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)]
        #: Neighbours in a piece: B may merge across them.
        self.glued = np.unique(np.array([ord(x) << 21 | ord(y) for p in pieces for x, y in zip(p, p[1:], strict=False)] or [-1], np.int64))
        self.splitter = Splitter(pattern, tokenizers_matches)
        self.known: dict[str, int] = {}
        #: Of every unit: tokens of A and B and groups (none if its bytes differ), its groups as text, its links as pairs of ids.
        self.sizes, self.links, self.groups, self.chars = Ragged(np.int64), Ragged(np.int64), [], 0

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of all texts, each with a space in front, and the offsets of each text's. An empty text has none."""
        split = [self.splitter.split(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        if not flat:
            return flat, at
        codes = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))[:-1]
        pairs = codes[begins - 1] << 21 | codes[begins]
        found = np.searchsorted(self.glued, pairs)
        glued = np.concatenate([[False], self.glued[np.minimum(found, len(self.glued) - 1)] == pairs])
        glued[at[:-1][at[:-1] < len(flat)]] = False
        if not glued.any():
            return flat, at
        first = ~glued
        begin = np.flatnonzero(first)
        several = np.flatnonzero(np.diff(np.concatenate([begin, [len(flat)]])) > 1)
        ends = np.concatenate([begin[1:], [len(flat)]])
        out, done = [], 0
        for a, b in zip(begin[several].tolist(), ends[several].tolist(), strict=True):
            out += flat[done:a]
            out.append("".join(flat[a:b]))
            done = b
        out += flat[done:]
        return out, np.concatenate([[0], np.cumsum(first)])[at]

    @staticmethod
    def _ends(ids: list[int], spans: list[tuple[int, int]], raw: dict[int, bytes], byte_at: list[int] | None) -> list[int]:
        """Where each token ends, in bytes: at its span's end if the next begins there, else as far as its bytes go."""
        out, at, n = [], 0, len(ids)
        for k, (i, (begin, end)) in enumerate(zip(ids, spans, strict=True)):
            if end > begin and (k + 1 == n or spans[k + 1][0] == end):
                at = byte_at[end] if byte_at else end
            else:
                at += len(raw[i])
            out.append(at)
        return out

    def align(self, unit: str, a: list[int], a_spans: list[tuple[int, int]], b: list[int], b_spans: list[tuple[int, int]]) -> tuple[list[tuple[list[int], list[int]]], list[int]] | None:
        """Groups and links of a unit; None if the bytes of either's tokens aren't its own."""
        data = unit.encode()
        if b"".join(map(self.raw_a.__getitem__, a)) != data or b"".join(map(self.raw_b.__getitem__, b)) != data:
            return None
        if len(a) == len(b) == 1:
            return [(a, b)], [a[0] << _SHIFT | b[0]]
        if len(data) == len(unit):
            # every character is a byte, so every span is one of bytes
            a_ends, b_ends = [e for _, e in a_spans], [e for _, e in b_spans]
        else:
            byte_at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in unit])]).tolist()
            a_ends, b_ends = self._ends(a, a_spans, self.raw_a, byte_at), self._ends(b, b_spans, self.raw_b, None)
        groups, links, i, j, i0, j0 = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append(a[i] << _SHIFT | b[j])
            x, y = a_ends[i], b_ends[j]
            i += x <= y
            j += y <= x
            if x == y:
                groups.append((a[i0:i], b[j0:j]))
                i0, j0 = i, j
        return groups, links

    def forget(self) -> None:
        """Starts anew with the first units if too many are remembered; numbers told before don't hold any more."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            keep = FIRST if self.chars <= REMEMBERED_CHARS else 0
            self.known = dict(islice(self.known.items(), keep))
            keep = len(self.known)
            self.sizes.keep(keep)
            self.links.keep(keep)
            self.groups, self.chars = self.groups[:keep], sum(map(len, self.known))

    def numbers(self, units: list[str]) -> np.ndarray:
        """The unit's numbers; those that are new are aligned."""
        every = [u for u in set(units) if u not in self.known]
        # the libraries' objects of few units at a time
        for k in range(0, len(every), AT_A_TIME):
            new = every[k : k + AT_A_TIME]
            sizes, links, n = [], [], len(self.known)
            for unit, told, piece in zip(new, self.a.encode_batch(new, add_special_tokens=False), self.b.encode(new, return_type="proto", num_threads=1), strict=True):
                # a piece begins where the one before ends, those of a character's first bytes end there too
                a, pieces = told.ids, piece.pieces
                b, ends = [p.id for p in pieces], [p.end for p in pieces]
                got = self.align(unit, a, told.offsets if len(a) > 1 or len(b) > 1 else (), b, list(zip([0, *ends], ends, strict=False)))
                if got is None:
                    sizes.append((0, 0, 0))
                    links.append(())
                    self.groups.append("")
                else:
                    sizes.append((len(a), len(b), len(got[0])))
                    links.append(got[1])
                    self.groups.append(";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in got[0]]))
            self.sizes.extend(sizes)
            self.links.extend(links)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            self.chars += sum(map(len, new))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def table(self, units: np.ndarray) -> np.ndarray:
        """Tokens of A, of B and groups of these units, a row each."""
        return self.sizes.values[: self.sizes.used].reshape(-1, 3)[units]


def aligner(byte_path: str, piece_path: str, pattern: str) -> Aligner:
    key = (byte_path, piece_path, pattern)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def alignments(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """doc_id and groups of each text: ids of A, ids of B."""
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path, pattern)
        for part in slices(batches, "text"):
            own.forget()
            units, at = own.units([t or "" for t in part.column("text").to_pylist()])
            rows, out = own.numbers(units), []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                told = [own.groups[u] for u in rows[x:y].tolist()]
                groups = [g.split("|") for g in ";".join(told).split(";")] if told and all(told) else []
                out.append([{"a": list(map(int, p.split(","))), "b": list(map(int, q.split(",")))} for p, q in groups])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


_DIGESTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, rows binary, ends binary, links binary, link_ends binary, pairs array<long>, counts array<long>"


class _Block:
    """Texts of a block, by the numbers of their units."""

    def __init__(self, own: Aligner):
        self.own, self.ids, self.shas, self.rows, self.ends, self.bytes = own, [], [], [], [], 0

    def add(self, part: pa.RecordBatch) -> None:
        texts = [t or "" for t in part.column("text").to_pylist()]
        units, at = self.own.units(texts)
        rows = self.own.numbers(units)
        # a unit without tokens takes all of its text with it
        empty = np.concatenate([[0], np.cumsum(self.own.table(rows)[:, 0] == 0)])
        fine = (empty[at[1:]] == empty[at[:-1]]) & (at[1:] > at[:-1])
        groups = self.own.groups
        for ok, a, b in zip(fine.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            self.shas.append(hashlib.sha256(";".join(map(groups.__getitem__, rows[a:b].tolist())).encode()).hexdigest() if ok else "")
        self.ids += part.column("doc_id").to_pylist()
        self.rows.append(rows[np.repeat(fine, np.diff(at))])
        self.ends.append(np.where(fine, np.diff(at), 0))
        self.bytes += sum(map(len, texts))

    def told(self, number: int) -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum(np.concatenate(self.ends))])
        used, rows, times = np.unique(np.concatenate(self.rows), return_inverse=True, return_counts=True)
        links, link_at = self.own.links.take(used)
        pairs, links = np.unique(links, return_inverse=True)
        counts = np.bincount(links, np.repeat(times, np.diff(link_at)).astype(np.float64), len(pairs)).astype(np.int64)
        sizes = np.column_stack([self.own.table(used), np.diff(link_at)])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes[rows], axis=0)])[at]
        per_doc = np.diff(sums, axis=0)
        raw = [x.astype("<i4").tobytes() for x in (rows, at, links, link_at)]
        lists = [pa.array([self.ids], pa.list_(pa.int64())), *(pa.array([per_doc[:, k].tolist()], pa.list_(pa.int64())) for k in range(4)), pa.array([self.shas], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in raw), pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64()))],
            names=[c.split()[0] for c in _BLOCK.split(", ")],
        )


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = aligner(byte_path, piece_path, pattern), TaskContext.get().partitionId() << 32
        block = _Block(own)
        for part in slices(batches, "text", max(1, BLOCK_BYTES // 4)):
            block.add(part)
            if block.bytes >= BLOCK_BYTES:
                yield block.told(n)
                own.forget()
                block, n = _Block(own), n + 1
        if block.ids:
            yield block.told(n)
            own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def _counted(blocks: DataFrame) -> DataFrame:
    told = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    return told.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """a, b, n: how many links of all texts hold the two ids linked."""
    counted = _counted(materialize(_blocks(docs, byte_path, piece_path, pattern), "blocks", _ONE_A_GROUP))
    return counted.select(F.shiftright("pair", _SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int").alias("b"), "n")


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of blocks, each block with the counts of its pairs: by unit first, then by document."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda c: batch.column(c)[k]  # noqa: B023, E731
            rows, at, links, link_at = (np.frombuffer(get(c).as_py(), "<i4") for c in ("rows", "ends", "links", "link_ends"))
            told = get("told").values
            place, n, best = (told.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "best")) if told is not None else (np.zeros(0, np.int64),) * 3
            of_pair = np.zeros((len(place), 2), np.int64)
            of_pair[place, 0], of_pair[place, 1] = best, n
            of_unit = np.diff(np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(of_pair[links], axis=0)])[link_at], axis=0)
            of_doc = np.diff(np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(of_unit[rows], axis=0)])[at], axis=0)
            own = [get(c).values for c in ("doc_ids", *_DIGESTS)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(of_doc[:, 0]), pa.array(of_doc[:, 1]), get("shas").values], names=[c.split()[0] for c in _OUT.split(", ")])


def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text."""
    blocks = materialize(_blocks(docs, byte_path, piece_path, pattern), "blocks", _ONE_A_GROUP)
    counts = _counted(blocks).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    counts = materialize(counts, "counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    judged = counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("pos", "pair"))
    told = asked.join(judged, "pair").groupBy("block").agg(F.collect_list(F.struct("pos", "n", "best")).alias("told"))
    return blocks.drop("pairs", "counts").join(told, "block", "left").mapInArrow(_summed, _OUT)
