"""Byte-level BPE encoding and decoding through a sentencepiece model that is made of the vocabulary.

A file of ranks (a token's bytes in base64, and its rank, a line each) becomes a sentencepiece
model, without training: every token is a piece whose bytes are written as the letters of
byte-level vocabularies, with the negative rank as its score, so the best-scored merge of
two neighbours is the one of the lowest rank, the leftmost of equals. Normalisation is the
identity, without a space in front. Texts are split into pre-tokens, every different one is
encoded once per Python worker, and a text's ids are gathered from theirs. A token that the
merges don't reach stands for a pre-token that is equal to it, as in the library
whose file it is. Decoding maps each piece's letters back to bytes.

Defined results: a null or empty text has no ids, and the digests of nothing; repeated rows
are encoded each; a null doc_id stays; texts of any length are worked off in parts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import slices
from tidewatch.llm.pretokens import Ragged, Splitter, byte_letters, grouped, tiktoken_matches

#: Pre-tokens (and ids of theirs) that a worker remembers, and how many of the first ones it keeps when it starts anew.
REMEMBERED, FIRST, REMEMBERED_IDS = 500_000, 150_000, 16_000_000
_CODERS: dict[tuple[str, str], ByteBPE] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def serialized_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the tokens in the order of their ranks; what it can't know comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb2

    letters, model = byte_letters(), pb2.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=pb2.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb2.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb2.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        ranks = read_ranks(path)
        if len({bytes([b]) for b in range(256)} - ranks.keys()) or len(ranks) > 1 << 24:
            raise ValueError("a vocabulary has all single bytes, and ranks that a score can hold")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized_model(ranks))
        self.ids = np.array(sorted(ranks.values()), np.uint32)
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        back = {c: b for b, c in enumerate(letters)}
        pieces = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(ranks))]
        self.raw, self.digits = Ragged(np.uint8), Ragged(np.uint8)
        self.raw.extend([np.frombuffer(p, np.uint8) for p in pieces])
        self.digits.extend([np.frombuffer(b"%d " % i, np.uint8) for i in self.ids.tolist()])
        #: Tokens that their own merges don't give.
        self.whole = {p: [i] for i, (p, got) in enumerate(zip(pieces, self.model.encode(list(map(self._mapped, pieces))), strict=True)) if got != [i]}
        self.splitter = Splitter(pattern, tiktoken_matches)
        self.known: dict[str, int] = {}
        self.found = Ragged(np.uint32)

    def _mapped(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.letters)

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > REMEMBERED or self.found.used > REMEMBERED_IDS:
            self.known = dict(islice(self.known.items(), FIRST if self.found.used <= REMEMBERED_IDS else 0))
            self.found.keep(len(self.known))
            new = [t for t in new if t not in self.known]
        raw = [t.encode() for t in new]
        ids = self.model.encode(list(map(self._mapped, raw)), num_threads=1)
        if self.whole:
            ids = [self.whole.get(r, i) for r, i in zip(raw, ids, strict=True)]
        self.found.extend(ids)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, one after another, and the offsets of each text's."""
        split = [self.splitter.split(t) for t in texts]
        flat = list(chain.from_iterable(split))
        new = list(set(flat) - self.known.keys())
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(rows) and rows.min() < 0:
            # the memory was cut: those that it lost are learned again, above the limit for once
            lost = list(set(flat) - self.known.keys())
            self.found.extend([self.whole.get(t.encode()) or self.model.encode(self._mapped(t.encode())) for t in lost])
            self.known.update(zip(lost, range(len(self.known), len(self.known) + len(lost)), strict=True))
            rows = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ids, at = self.found.take(rows)
        return ids, at[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after another, and the offsets of each text's."""
        raw, at = self.raw.take(ids)
        return raw, at[offsets]

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Piece numbers of ids; the vocabulary's own ranks needn't be without gaps."""
        return np.searchsorted(self.ids, tokens)


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, an array, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for part in slices(batches, "text"):
            ids, offsets = bpe.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _lists(bpe.ids[ids].astype(np.int32), offsets, pa.int32())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of ids (doc_id, ids); no ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            rows = [np.asarray(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            raw, at = bpe.decode(bpe.numbers(np.concatenate([*rows, np.zeros(0, np.int64)])), at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def byte_bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with a space between) and decoded_sha256 (of the bytes that the ids give back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for part in slices(batches, "text"):
            counts = [0] * part.num_rows
            told, given = [hashlib.sha256() for _ in counts], [hashlib.sha256() for _ in counts]
            for group in grouped([t or "" for t in part.column("text").to_pylist()]):
                ids, offsets = bpe.encode([t for _, t in group])
                raw, at = bpe.decode(ids, offsets)
                digits, places = bpe.digits.take(ids)
                raw, digits = raw.data, digits.data
                for (i, _), n, a, b, c, d in zip(group, np.diff(offsets).tolist(), at[:-1].tolist(), at[1:].tolist(), places[offsets[:-1]].tolist(), places[offsets[1:]].tolist(), strict=True):
                    if n:
                        told[i].update(b" " if counts[i] else b"")
                        told[i].update(digits[c : d - 1])
                        given[i].update(raw[a:b])
                        counts[i] += n
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in told]), pa.array([h.hexdigest() for h in given])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
