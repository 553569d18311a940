"""Pre-tokens: the stretches of a text that a byte-level tokenizer merges inside, each for itself.

The split pattern is compiled for Python's ``re`` with the character classes written out as
ranges. The ranges are read from the library whose split is to be met, because libraries
follow different versions of Unicode. Three forms of the pattern serve texts in ASCII, in the
basic plane and beyond it: what a text can't hold isn't looked for.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Long texts are cut before a space that follows another character, about every so many characters.
PART_CHARS = 1_000_000
_EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def tiktoken_matches(pattern: str) -> str:
    """All characters that ``pattern``, a class, matches in the tiktoken library, which drops those that it doesn't."""
    import tiktoken

    one_each = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(one_each.encode_ordinary(_EVERY)).decode()


def tokenizers_matches(pattern: str) -> str:
    """All characters that ``pattern``, a class, matches in the tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    found = pre_tokenizers.Split(Regex(pattern + "+"), behavior="removed", invert=True).pre_tokenize_str(_EVERY)
    return "".join(x for x, _ in found)


def _ranges(chars: str, most: int) -> str:
    codes = np.unique(np.array([ord(c) for c in chars], np.int64))
    codes = codes[codes <= most]
    first = codes[np.concatenate([[True], np.diff(codes) > 1])] if len(codes) else codes
    last = codes[np.concatenate([np.diff(codes) > 1, [True]])] if len(codes) else codes
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


class Splitter:
    """Splits as ``pattern`` does where ``matches`` tells the characters of a class."""

    def __init__(self, pattern: str, matches: Callable[[str], str]):
        classes = [matches(c) for c in (r"\s", r"\p{L}", r"\p{N}")]
        self.find = [re.compile(self._written(pattern, *(_ranges(c, most) for c in classes))).findall for most in (0x7F, 0xFFFF, sys.maxunicode)]
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    @staticmethod
    def _written(pattern: str, space: str, letter: str, number: str) -> str:
        out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
        for name, own in ((r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
            out = out.replace(name, own)
        if r"\p" in out:
            raise ValueError(f"a class of {pattern} isn't known")
        return out

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.find[0](text)
        return self.find[2 if self.beyond(text) else 1](text)


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts that split by themselves: no pre-token holds a character and a space after it."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def grouped(texts: list[str], most: int = PART_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Parts of the texts with their text's number, about ``most`` characters at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for part in parts(text, most):
            held.append((i, part))
            size += len(part)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


class Ragged:
    """Rows of unequal length in one array, with room for more."""

    def __init__(self, dtype):
        self.values, self.starts, self.sizes, self.n, self.used = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0, 0

    def extend(self, rows: list) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        if rows and isinstance(rows[0], np.ndarray):
            flat = np.concatenate(rows)
        else:
            flat = np.fromiter(chain.from_iterable(rows), self.values.dtype, int(sizes.sum()))
        while self.n + len(rows) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.sizes[self.n : self.n + len(rows)] = sizes
        self.starts[self.n : self.n + len(rows)] = self.used + np.cumsum(sizes) - sizes
        self.values[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(rows), self.used + len(flat)

    def keep(self, n: int) -> None:
        """Only the first ``n`` rows stay."""
        self.n, self.used = n, int(self.starts[n - 1] + self.sizes[n - 1]) if n else 0

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows, one after another, and where each row's begin (and the last ends)."""
        sizes = self.sizes[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return self.values[np.repeat(self.starts[rows] - at[:-1], sizes) + np.arange(at[-1])], at
