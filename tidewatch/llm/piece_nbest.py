"""SentencePiece encoding and decoding with the N best segmentations.

A text becomes one lattice of vocabulary pieces, with its spaces as U+2581 and one put
in front. Between two bytes that stand side by side in no piece the lattice has a single
node, so it falls into segments there. In a segment, the best forward (Viterbi) score of every
place is the exact rest cost for an A* search from the end back: hypotheses come off the
agenda in the order of their full scores. As each one stands for a different
segmentation, an agenda of N entries loses nothing. The N best of the text are then the
N cheapest combinations of its segments' choices.

Characters outside the vocabulary, and a U+2581 in the text itself, are spelled in byte
pieces, so decoding gives the text back. The model file is only read, never trained.

Defined results: null or empty text has one segmentation without pieces and score 0; a
text with fewer segmentations than N has those it has; ties keep the longer last piece
first; repeated rows are encoded each; a null doc_id stays.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import flat, prefix_sums, range_hash, slices

N_BEST = 4
CACHE_SEGMENTS = 600_000
SPACE = "▁"
#: A byte piece costs this much more than the model's least likely piece.
BYTE_PENALTY = 10.0
_FIRST = np.uint64(0xA5A5A5A5A5A5A5A5)
_ENCODERS: dict[tuple[str, int], NBestEncoder] = {}


class PieceModel:
    """Vocabulary and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): (i, model.get_score(i)) for i in normal}
        #: Every piece, and with None every proper beginning of one: a search stops where nothing goes on.
        self.known: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.scores for k in range(1, len(p))} | self.scores
        plain = [s for _, s in self.scores.values() if s > -1e8]
        self.byte_score = min(plain, default=0.0) - BYTE_PENALTY
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.raw = [b""] * len(ids)
        for piece, (i, _) in self.scores.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        #: Whether two bytes stand side by side in some piece (or character).
        self.glued = np.zeros((256, 256), bool)
        self.glued[:, 0x80:0xC0] = True
        joined = [np.frombuffer(r, np.uint8) for r in self.raw if len(r) > 1]
        for r in joined:
            self.glued[r[:-1], r[1:]] = True

    def spell(self, char: str) -> tuple[tuple[int, ...], float]:
        raw = char.encode()
        return tuple(self.byte_ids[b] for b in raw), self.byte_score * len(raw)

    def nbest(self, segment: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first. In ``segment`` a space is a piece's U+2581."""
        size, known = len(segment), self.known
        text = segment.replace(SPACE, "\0").replace(" ", SPACE)
        arcs: list[list[tuple[int, float, tuple[int, ...] | int]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [float("-inf")] * size
        for i in range(size):
            here = forward[i]
            for j in range(i + 1, size + 1):
                got = known.get(text[i:j], 0)
                if got:
                    piece, score = got
                    arcs[j].append((i, score, piece))
                    if here + score > forward[j]:
                        forward[j] = here + score
                elif got == 0:
                    break
            if not arcs[i + 1] or arcs[i + 1][-1][0] != i:
                ids, score = self.spell(SPACE if text[i] == "\0" else text[i])
                arcs[i + 1].append((i, score, ids))
                if here + score > forward[i + 1]:
                    forward[i + 1] = here + score
        if n == 1 or all(len(a) < 2 for a in arcs):
            n = 1
        out: list[tuple[float, list[int]]] = []
        # entries: (-full score, age, place, score behind it, pieces behind it)
        agenda: list[tuple] = [(-forward[size], 0, size, 0.0, None)]
        age = 0
        while agenda and len(out) < n:
            cost, _, at, behind, chain = agenda.pop(0)
            if not at:
                ids: list[int] = []
                while chain is not None:
                    piece, chain = chain
                    ids.extend(piece) if isinstance(piece, tuple) else ids.append(piece)
                out.append((-cost, ids))
                continue
            left = n - len(out)
            for i, score, piece in arcs[at]:
                rest = behind + score
                full = -(forward[i] + rest)
                if len(agenda) < left or full < agenda[-1][0]:
                    age += 1
                    insort(agenda, (full, age, i, rest, (piece, chain)))
                    if len(agenda) > left:
                        agenda.pop()
        return out


def cheapest(second: np.ndarray, take: int) -> list[int]:
    """Places of the ``take`` segments whose second best costs least, the first ones where costs tie."""
    able = np.flatnonzero(np.isfinite(second))
    if len(able) > take:
        border = np.partition(second[able], take - 1)[take - 1]
        able = np.concatenate([able[second[able] < border], able[second[able] == border]])[:take]
    return np.sort(able).tolist()


def combine(choices: list[tuple[int, list[float]]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n cheapest ways to choose an alternative for each segment, as (cost, changes to the best ones).

    ``choices``: place of a segment, and what its r-th best costs more than its best.
    """
    ways: list[tuple[float, tuple]] = [(0.0, ())]
    for s, costs in choices:
        ways = sorted(ways + [(c + d, (*w, (s, r))) for c, w in ways for r, d in enumerate(costs) if r])[:n]
    return ways


class NBestEncoder:
    """Encodes slices of texts; remembers the segments that a Python worker has met."""

    def __init__(self, path: str, n: int):
        self.model, self.n = PieceModel(path), n
        sizes = np.array([len(r) for r in self.model.raw])
        self.raw, self.raw_size, self.raw_start = np.frombuffer(b"".join(self.model.raw), np.uint8), sizes, np.cumsum(sizes) - sizes
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.texts: list[str] = []
        self.full: dict[int, list[tuple[float, np.ndarray]]] = {}
        self.sizes, self.starts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.second, self.best = np.full(1024, np.inf), np.zeros(1024)
        self.store, self.used = np.zeros(1 << 16, np.int32), 0

    def alternatives(self, k: int) -> list[tuple[float, np.ndarray]]:
        """(cost over the best, ids) of the n best of a remembered segment; only the few cheapest of a text are asked for."""
        if k not in self.full:
            found = self.model.nbest(self.texts[k], self.n)
            self.full[k] = [(found[0][0] - score, np.array(ids, np.int32)) for score, ids in found]
        return self.full[k]

    def _learn(self, keys: list[int], segments: list[str]) -> None:
        at = len(self.known)
        while at + len(keys) > len(self.best):
            self.sizes, self.starts, self.best, self.second = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts, self.best, self.second))
        new: list[int] = []
        for k, segment in enumerate(segments, at):
            found = self.model.nbest(segment, min(2, self.n))
            self.best[k], ids = found[0]
            self.second[k] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            self.starts[k], self.sizes[k] = self.used + len(new), len(ids)
            new.extend(ids)
        while self.used + len(new) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.texts += segments
        self.known.update(zip(keys, range(at, at + len(keys)), strict=True))

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of every segment, and for every text the bounds of its segments."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64), np.zeros(0, np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.model.glued[data[:-1], data[1:]]
        heads = offsets[:-1][np.diff(offsets) > 0]
        cut[heads] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(data))
        keys = range_hash(prefix_sums(data), s, e)
        first = np.zeros(len(data), bool)
        first[heads] = True
        keys ^= np.where(first[s], _FIRST, np.uint64(0))
        names, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = names.tolist()
        if len(self.known) + len(names) > CACHE_SEGMENTS:
            self.clear()
        entry = np.fromiter(map(self.known.get, names, [-1] * len(names)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw, where = data.tobytes(), at[new]
            texts = [(" " if f else "") + raw[a:b].decode() for a, b, f in zip(s[where].tolist(), e[where].tolist(), first[s[where]].tolist(), strict=True)]
            self._learn([names[i] for i in new.tolist()], texts)
            entry[new] = np.arange(len(self.known) - len(new), len(self.known))
        return entry[inverse], np.searchsorted(s, offsets), s

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For every text its n best: (score, ids)."""
        entries, bounds, _ = self.segments(data, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = entries[a:b]
            sizes, starts, score = self.sizes[own], self.starts[own], float(self.best[own].sum())
            total = np.cumsum(sizes)
            ids = self.store[np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1])] if len(own) else np.zeros(0, np.int32)
            # A way of the n best changes only some of the n - 1 segments whose second best costs least.
            near = cheapest(self.second[own], self.n - 1) if self.n > 1 else []
            out = []
            for cost, changes in combine([(s, [c for c, _ in self.alternatives(int(own[s]))]) for s in near], self.n):
                parts, at = [], 0
                for s, r in changes:
                    parts += [ids[at : total[s] - sizes[s]], self.alternatives(int(own[s]))[r][1]]
                    at = total[s]
                out.append((score - cost, np.concatenate([*parts, ids[at:]]) if changes else ids))
            yield out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: pieces one after another, without the space that was put in front."""
        sizes = self.raw_size[ids]
        total = np.cumsum(sizes)
        return self.raw[np.repeat(self.raw_start[ids] - (total - sizes), sizes) + np.arange(total[-1])][1:].tobytes() if len(ids) else b""


def encoder(path: str, n: int) -> NBestEncoder:
    if (path, n) not in _ENCODERS:
        _ENCODERS[path, n] = NBestEncoder(path, n)
    return _ENCODERS[path, n]


def encode_nbest(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """doc_id, rank (from 1), score, ids: the n best segmentations of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, n)
        for part in slices(batches, "text"):
            cols: list[list] = [[], [], [], []]
            for doc_id, best in zip(part.column("doc_id").to_pylist(), enc.encode(*flat(part.column("text"))), strict=True):
                for rank, (score, ids) in enumerate(best, 1):
                    for c, v in zip(cols, (doc_id, rank, score, ids), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.int32()))], names=["doc_id", "rank", "score", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of ``encoded`` but ids, and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, 1)
        for batch in batches:
            texts = [enc.decode(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid else None for x in batch.column("ids")]
            rest = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    rest = encoded.drop("ids", "text")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rest.dtypes), "text string"])
    return rest.select(*rest.columns, encoded["ids"]).mapInArrow(run, schema) if "text" in encoded.columns else encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """A digest of the n best of every text: doc_id, n_tokens and score of the best, decoded (it gives
    the text back), and by rank the arrays scores, tokens and ids_crc32 (of the ids as little-endian
    32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, n)
        for part in slices(batches, "text"):
            data, offsets = flat(part.column("text"))
            raw = data.tobytes()
            cols: list[list] = [[] for _ in range(6)]
            for k, best in enumerate(enc.encode(data, offsets)):
                text = raw[offsets[k] : offsets[k + 1]]
                row = (len(best[0][1]), best[0][0], enc.decode(best[0][1]) == text, [s for s, _ in best], [len(i) for _, i in best], [zlib.crc32(i.astype("<u4").tobytes()) for _, i in best])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_tokens", "score", "decoded", "scores", "tokens", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double, decoded boolean, scores array<double>, tokens array<long>, ids_crc32 array<long>")
