"""Token ids of whole texts by a public tokenizer file, fast enough for a corpus.

The tokenizers library encodes every different word once per Python worker; the ids of
a text are then gathered from those of its words. That is exact for vocabularies whose
pre-tokenizer never joins across ASCII white space and which ignore the case of A-Z,
as ``word_bpe_49k.json``. The strings of its added tokens are cut out of a text first, in
their own case, and stand for their one id, as in the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tidewatch.llm.common import _LOWER, prefix_sums, range_hash, word_bounds

#: Words remembered by a Python worker; beyond it, the memory starts anew.
CACHE_WORDS = 800_000
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".,!?;:")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # what is left of them in a word is of another case, and ordinary text
        self.tokenizer.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items()}
        self.find_added = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.separator = self._encode(["0"])[0]
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.lengths = np.zeros(1 << 16, np.int64)
        self.starts = np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Words without a 0 are encoded many at a time, with a 0 between them."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        plain = [i for i, w in enumerate(words) if "0" not in w]
        if len(self.separator) == 1:
            groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
            for group, ids in zip(groups, self._encode([" 0 ".join(words[i] for i in g) for g in groups]), strict=True):
                ids = np.asarray(ids, dtype=np.uint32)
                cuts = np.flatnonzero(ids == self.separator[0])
                if len(cuts) + 1 != len(group):
                    plain = [i for i in plain if i not in set(group)]
                    for i, x in zip(group, self._encode([words[i] for i in group]), strict=True):
                        out[i] = np.asarray(x, dtype=np.uint32)
                    continue
                begin = np.concatenate([[0], cuts + 1])
                end = np.concatenate([cuts, [len(ids)]])
                for i, a, b in zip(group, begin.tolist(), end.tolist(), strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, w in enumerate(words) if "0" in w] if len(self.separator) == 1 else range(len(words))
        rest = list(rest)
        for i, x in zip(rest, self._encode([words[i] for i in rest]), strict=True):
            out[i] = np.asarray(x, dtype=np.uint32)
        return out

    def _learn(self, keys: list[int], words: list[str]) -> None:
        n, found = len(self.known), self._encode_words(words)
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        while n + len(keys) > len(self.lengths):
            self.lengths, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts))
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.lengths[n : n + len(keys)] = lengths
        self.starts[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.store[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each text's ids."""
        raw = data.tobytes() if self.find_added else b""
        if not any(x in raw for x in self.added):
            return self._encode_plain(data, offsets)
        bounds = offsets.tolist()
        found = [(i, m.start(), m.end(), self.added[m[0]]) for i in range(len(bounds) - 1) for m in self.find_added.finditer(raw, bounds[i], bounds[i + 1])]
        doc, start, end, token = (np.array([f[k] for f in found], np.int64) for k in range(4))
        # Pieces end where an added token stands or the text ends; the tokens' bytes go.
        n, k = len(offsets) - 1, len(found)
        docs, at, last = np.concatenate([doc, np.arange(n)]), np.concatenate([start, offsets[1:]]), np.concatenate([np.zeros(k, bool), np.ones(n, bool)])
        order = np.lexsort((last, at, docs))
        at, last, token = at[order], last[order], np.concatenate([token, np.zeros(n, np.int64)])[order]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[start] += 1
        gone[end] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        ids, pieces = self._encode_plain(data[keep], np.concatenate([[0], np.concatenate([[0], np.cumsum(keep)])[at]]))
        tokens_so_far = np.cumsum(~last)
        out = np.zeros(len(ids) + k, np.uint32)
        out[np.arange(len(ids)) + np.repeat(tokens_so_far - ~last, np.diff(pieces))] = ids
        out[(pieces[1:] + tokens_so_far - 1)[~last]] = token[~last]
        return out, np.concatenate([[0], (pieces[1:] + tokens_so_far)[last]])

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        data = _LOWER[data]
        starts, ends, docs = word_bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        # "word." is "word" and ".": the stop ends a run of ASCII letters
        cut = (ends - starts > 1) & _STOPS[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]]
        times = 1 + cut
        last = np.cumsum(times) - 1
        s, e = np.repeat(starts, times), np.repeat(ends, times)
        e[last[cut] - 1] -= 1
        s[last[cut]] = ends[cut] - 1
        docs = np.repeat(docs, times)
        keys, first, inverse = np.unique(range_hash(prefix_sums(data), s, e), return_index=True, return_inverse=True)
        names = keys.tolist()
        if len(self.known) + len(names) > CACHE_WORDS:
            self.clear()
        entry = np.fromiter(map(self.known.get, names, [-1] * len(names)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            self._learn([names[i] for i in new.tolist()], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            entry[new] = np.arange(len(self.known) - len(new), len(self.known))
        entry = entry[inverse]
        lengths = self.lengths[entry]
        total = np.cumsum(lengths)
        ids = self.store[np.repeat(self.starts[entry] - (total - lengths), lengths) + np.arange(total[-1])]
        bounds = np.searchsorted(docs, np.arange(n_docs + 1))
        return ids, np.concatenate([[0], total])[bounds]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after the ids of every text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, dtype=np.uint32)
    lengths = np.diff(offsets)
    keep = np.arange(len(ids)) + np.repeat(np.arange(n), lengths)
    out[keep] = ids
    return out, offsets + np.arange(n + 1)
