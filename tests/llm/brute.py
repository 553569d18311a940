"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INKED = re.compile(r"[^\x20\x09\x0B-\x0D]")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in zip(*np.unique(np.array([" ".join(g) for g in grams]), return_counts=True), strict=True) if n > 1}
    hit = {i + k for i, g in enumerate(grams) if (g in twice or " ".join(g) in twice) for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(rows):
    """doc_id -> (n_shingles, component) of rows (doc_id, text) with distinct ids."""
    sets, tied = {i: shingles(t) for i, t in rows}, Sets()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                tied.union(a, b)
    return {i: (len(s), tied.find(i)) for i, s in sets.items()}


def covered(rows, length=100):
    """doc_id -> flags of covered bytes, of rows (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        flags = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                flags[k : k + length] = b"\1" * length
            seen.add(w)
        out[i] = flags
    return out


def cut_row(text, flags):
    raw = (text or "").encode()
    kept = bytes(b for b, f in zip(raw, flags, strict=True) if not f)
    spans = sum(1 for k in range(len(flags)) if flags[k] and not (k and flags[k - 1]))
    return len(raw), sum(flags), spans, hashlib.sha256(kept).hexdigest()


def cut_text(text, flags):
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not all(flags[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def dedup_lines(rows, size=8):
    """doc_id -> text without lines alike to an earlier one, of rows (doc_id, text) with distinct ids."""
    first = {}
    for i, t in sorted(rows):
        for p, line in enumerate((t or "").split("\n")):
            if INKED.search(line):
                first.setdefault(line, (i, p))
    lines, tied = list(first), Sets()
    sets = [frozenset(x[k : k + size] for k in range(max(1, len(x) - size + 1))) for x in lines]
    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                tied.union(b, a)
    keep = {}
    for a, x in enumerate(lines):
        keep[tied.find(a)] = min(keep.get(tied.find(a), (1 << 62, 0)), first[x])
    at = {x: keep[tied.find(a)] for a, x in enumerate(lines)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not INKED.search(x) or at[x] == (i, p)) if t is not None else None for i, t in rows}


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
