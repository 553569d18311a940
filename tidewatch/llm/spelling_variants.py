"""Grouping of spelling variants: words that differ by one letter, by blocked Gram matrices.

The words of at least ``LEAST_LETTERS`` letters are counted with their totals. Two words are
near if one inserted, deleted or replaced letter makes one the other; then the squared distance
of their letter counts is at most two, and their lengths differ by at most one. That distance is
read from the product of a block of letter-count rows with itself, for many words at a time;
the pairs that it leaves are compared letter by letter.

A block holds words of one length and those longer by one that have the same letters outside
a stretch: the stretch is at first one half of the word or the other, as one edit leaves
one of them alone. Where a block has more than ``MOST`` words, its stretch is halved, again and again for what
is still too large, down to one letter. Then only that letter differs, so the alphabet bounds the block. A pair is told in the block whose
stretch holds its first difference, so it is told once, however often a block was halved. No block is dropped or
capped, and none is collected.

A word's form is its near word with the largest count, if that is at least ``FACTOR`` times its own; its
root is where the forms lead. Counts grow at every step, so roots are found by a few doublings.

Defined results: a null or empty text has no words; rows of repeated ids count each; in the
deletion rule a null doc_id is written as nothing; of near words with equal counts the
first in code-point order is the form.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, slices

LEAST_LETTERS, LEAST_COUNT, FACTOR, DELETE_EVERY = 7, 2, 10, 31
#: Words of a block that isn't halved any more, and rows of one product.
MOST, TILE = 2_000, 512
#: Different words that a task holds before it passes them on.
HELD = 200_000
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_COLUMN = np.zeros(256, np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[0xC0:] = np.arange(26, 90)
_LETTERS = 90


def words_of(doc_id: int | None, text: str) -> Counter:
    """The words of a text with their numbers, after the deletion rule."""
    out: Counter = Counter()
    name = b"" if doc_id is None else b"%d" % doc_id
    for run, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(b"%s:%s" % (name, run.encode()))
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            out[run] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words with at least ``LEAST_COUNT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                held.update(words_of(doc_id, text or ""))
            if len(held) > HELD:
                yield told()
                held.clear()
        yield told()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _filed(size, low, high, longer):
    """The block of a word: its length and stretch, and the letters outside it. ``longer``: 1 for a word that is longer by one."""
    return F.xxhash64(size, low, high, F.substring("word", F.lit(1), low), F.substring("word", high + longer + 1, F.length("word")))


def _blocks(words: DataFrame) -> DataFrame:
    """Every word in four blocks: as one of its length and as one that is longer by one, by its halves."""
    size = F.length("word")
    roles = F.explode(F.array(*(F.struct((size - longer).alias("size"), F.lit(longer).alias("longer"), F.lit(second).alias("second")) for longer in (0, 1) for second in (0, 1)))).alias("r")
    half = F.floor(F.col("r.size") / 2).cast("int")
    cut = words.select("word", roles).select("word", "r.size", "r.longer", F.when(F.col("r.second") == 1, half).otherwise(0).alias("low"), F.when(F.col("r.second") == 1, F.col("r.size")).otherwise(half).alias("high"))
    # nothing is shorter than the least word
    return cut.where(F.col("size") >= LEAST_LETTERS).withColumn("block", _filed(F.col("size"), F.col("low"), F.col("high"), F.col("longer")))


def _halved(rows: DataFrame) -> DataFrame:
    mid = ((F.col("low") + F.col("high")) / 2).cast("int")
    two = F.explode(F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col("high").alias("high")))).alias("s")
    return rows.select("word", "size", "longer", two).select("word", "size", "longer", "s.low", "s.high").withColumn("block", _filed(F.col("size"), F.col("low"), F.col("high"), F.col("longer")))


def one_edit(a: str, b: str, at: int) -> bool:
    """Whether b is a with the letter at ``at``, their first difference, replaced, or one put in front of it."""
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def _first_difference(a: bytes, b: bytes) -> int:
    n, at = min(len(a), len(b)), 0
    if n <= 64:
        while at < n and a[at] == b[at]:
            at += 1
        return at
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _counts_of(words: list[bytes]) -> np.ndarray:
    """A row of letter counts for every word; in doubles where the products could pass what singles hold exactly."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = _COLUMN[np.frombuffer(b"".join(words), np.uint8)]
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * _LETTERS + letters, minlength=len(words) * _LETTERS)
    return flat.reshape(-1, _LETTERS).astype(np.float32 if sizes.max() < 2000 else np.float64)


def _near_in(rows: list[tuple]) -> Iterator[tuple[str, str]]:
    """Near pairs of rows (block, longer, low, high, size, word) in the order of their blocks: Gram matrices of ``TILE`` rows each way."""
    words = [r[5].encode("latin-1") for r in rows]
    counts = _counts_of(words)
    norms = (counts * counts).sum(axis=1)
    block, longer = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int8)
    for a in range(0, len(rows), TILE):
        for b in range(a, len(rows), TILE):
            x, y = slice(a, a + TILE), slice(b, b + TILE)
            if block[y][0] != block[x][-1] and a != b:
                break
            squared = norms[x, None] + norms[None, y] - 2 * (counts[x] @ counts[y].T)
            hit = (squared <= 2) & (block[x, None] == block[None, y]) & ((longer[x, None] == 0) | (longer[None, y] == 0))
            if a == b:
                hit &= np.tri(len(hit), dtype=bool, k=-1)
            for i, j in np.argwhere(hit).tolist():
                i, j = a + i, b + j
                if longer[i]:
                    i, j = j, i
                p, q = rows[i], rows[j]
                low, high, size = p[2:5]
                at = _first_difference(words[i], words[j])
                # told where the stretch holds the first difference, or it is put behind the last letter
                if low <= at and (at < high or at == high == size) and at < len(words[j]) and one_edit(words[i], words[j], at):
                    yield (p[5], q[5])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; whole blocks are taken together, about ``MOST`` rows at a time."""
    held: list[tuple] = []

    def told(rows: list[tuple]) -> pa.RecordBatch:
        found = list(_near_in(rows))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["a", "b"])

    for batch in batches:
        held.extend(zip(*(batch.column(c).to_pylist() for c in ("block", "longer", "low", "high", "size", "word")), strict=True))
        while len(held) > 2 * MOST:
            cut = MOST
            while cut < len(held) and held[cut][0] == held[cut - 1][0]:
                cut += 1
            if cut == len(held):
                break
            yield told(held[:cut])
            del held[:cut]
    if held:
        yield told(held)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b of all near words of a table of different words, each pair once."""
    done, rows = None, materialize(_blocks(words), "blocks")
    while True:
        sizes = rows.groupBy("block").agg(F.count("*").alias("m"), F.count_if(F.col("longer") == 0).alias("plain"))
        # a block without a word of its own length has no pair, nor has a single word
        sizes = sizes.where("m > 1 and plain > 0")
        fits = F.col("m") <= MOST
        joined = rows.join(sizes, "block").withColumn("wide", ~fits & (F.col("high") - F.col("low") > 1))
        joined = materialize(joined.drop("m", "plain"), "blocks")
        small = joined.where("not wide").drop("wide")
        done = small if done is None else done.unionByName(small)
        wide = joined.where("wide").drop("wide")
        if wide.isEmpty():
            break
        rows = materialize(_halved(wide), "blocks")
    return done.repartition("block").sortWithinPartitions("block", "longer").mapInArrow(_pairs, "a string, b string")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word and root of (word, form): where the forms lead, which is at most ``steps`` of them away."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        ahead = at.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        at = materialize(at.join(ahead, at["root"] == ahead["__w"], "left").select("word", F.coalesce("__r", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialize(word_counts(docs), "words")
    pairs = materialize(near_pairs(words.select("word")), "pairs")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    near = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = links.join(near, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    far = -F.col("best.m") >= FACTOR * F.col("n")
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    judged = materialize(judged, "judged")
    most = words.agg(F.max("n")).first()[0] or 1
    ends = roots(judged.where("form is not null"), int(math.log(most, FACTOR)) + 1)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
