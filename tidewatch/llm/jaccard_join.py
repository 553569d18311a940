"""Exact n-gram Jaccard join of documents, by signature trees.

1. Every document becomes its set of hashed five-word shingles; documents with equal
   sets are one class from here on, whatever their number.
2. A class is filed under the prefix of its set, the shingles of which any partner must
   share one (frequent shingles stand last in the order, so they rarely count). Rows go
   to their reducers packed in blocks of bytes.
3. Classes under one shingle make a list. First each is held against the list's least
   member, and lists with the same least member are one; for lists that this leaves in several components, a signature tree is built:
   its nodes hold OR-combined bitmaps of the sets and size ranges, and two nodes are only
   descended together if their greatest possible overlap suffices for some pair.
4. Members with a surviving partner are verified on their texts, the most promising pairs
   first. Pairs within one component are skipped, so a large group of copies never makes
   all its pairs, while no link between components is lost.

Defined results: null or blank text has the empty set and is its own component; a row with a
null doc_id is linked as any other, and component_id is null where no linked row has an id; repeated rows share their class; equal
doc_ids with different texts each keep their row and are linked by their own text; an empty table gives no rows. Sets are
of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import flat, materialize, mix, parts_of, shingle_sets, slices
from tidewatch.llm.components import UnionFind, components

WORDS, PERCENT = 5, 75
#: Frequent shingles put last in the order: at most so many (a bound on what is broadcast), of at least so many classes.
HOT, HOT_AT, HOT_LOCAL, HOT_WINDOW = 50_000, 64, 8, 1_000_000
#: Rows packed at a time, and classes that a task remembers so as not to pack them again; neither changes a result.
FLUSH_ROWS, REMEMBERED = 1_000_000, 500_000
LIST_BLOCK, LEAF = 1_024, 16
#: Text of several groups whose sets are made at once; doesn't change a result.
SETS_BYTES = 500_000
MIN_BITS, MAX_BITS = 256, 1 << 16
_ROW = np.dtype([("t", "<u4"), ("n", "<u4"), ("c", "<i8")])


def _need(a, b, percent: int):
    """100 * overlap >= percent * union, as overlap * (100 + percent) >= percent * (a + b)."""
    return percent * (a + b)


def bitmap(s: np.ndarray, times: int = 1) -> bytes:
    """At least ``times`` as many bits as members, one set for each."""
    bits = MIN_BITS
    while bits < times * len(s) and bits < times * MAX_BITS:
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(raw: np.ndarray, size: int) -> np.ndarray:
    while len(raw) > size:
        raw = raw[: len(raw) // 2] | raw[len(raw) // 2 :]
    return raw


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n, percent: int = PERCENT):
    """Shingles of a set of n, one of which any partner shares: n - ceil(percent * n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """kind 0: doc_id, key (hash of the text), n, class, bits of each document; kind 1: shingles (as class) frequent within a task, with their number (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        rows = 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
            values, counts = values[counts >= HOT_LOCAL].view(np.int64), counts[counts >= HOT_LOCAL]
            held.clear()
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(values), pa.nulls(n, pa.binary())], names=["kind", "doc_id", "key", "n", "class", "bits"])

        for part in slices(batches, "text"):
            sets = shingle_sets(*flat(part.column("text")), words)
            classes = [class_of(s) for s in sets]
            for c, s in zip(classes, sets, strict=True):
                if c not in held:
                    held[c] = s
                    rows += len(s)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), part.column("doc_id").cast(pa.int64()), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())],
                names=["kind", "doc_id", "key", "n", "class", "bits"],
            )
            if rows >= HOT_WINDOW:
                yield frequent()
                rows = 0
        yield frequent()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "kind int, doc_id long, key long, n long, class long, bits binary")


def prefix_rows(docs: DataFrame, hot: np.ndarray, parts: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(part, rows): the prefix of every class as packed (shingle, size, class) rows, by reducer part.

    ``hot``: frequent shingles, the least frequent first.
    """
    by_value = np.argsort(hot)
    values, rank = hot[by_value], by_value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.zeros(0, _ROW)
            held.clear()
            mixed = mix(rows["c2"]) if len(rows) else np.zeros(0, np.uint64)
            part = (mixed % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            out = np.zeros(len(rows), _ROW)
            out["t"], out["n"], out["c"] = (mixed >> np.uint64(32)).astype(np.uint32), rows["n"] if len(rows) else 0, rows["c"] if len(rows) else 0
            out, part = out[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            bounds = pa.py_buffer((np.append(first, len(part)) * _ROW.itemsize).astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, bounds, pa.py_buffer(out.tobytes())])], names=["part", "rows"])

        kind = np.dtype([("c2", "<u8"), ("n", "<u4"), ("c", "<i8")])
        for piece in slices(batches, "text"):
            sets = shingle_sets(*flat(piece.column("text")), words)
            if len(seen) > REMEMBERED:
                seen.clear()
            for s in sets:
                c, n = class_of(s), len(s)
                if not n or c in seen:
                    continue
                seen.add(c)
                p = prefix_size(n, percent)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    common = values[at] == s
                    if common.any():
                        cold, warm = s[~common], at[common]
                        s = cold if len(cold) >= p else np.concatenate([cold, hot[np.sort(rank[warm])]])
                rows = np.zeros(p, kind)
                rows["c2"], rows["n"], rows["c"] = s[:p], n, c
                held.append(rows)
                count += p
            if count >= FLUSH_ROWS:
                yield flush()
                count = 0
        yield flush()

    return docs.select("text").mapInArrow(run, "part int, rows binary")


def stars(key, table):
    """From all packed rows of a part: of the classes under one name (t), each (b) with the least (a)."""
    rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), dtype=_ROW)
    rows = rows[np.lexsort((rows["c"], rows["t"]))]
    new = np.ones(len(rows), bool)
    new[1:] = rows["t"][1:] != rows["t"][:-1]
    least = rows["c"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(rows) else rows["c"]
    far = least != rows["c"]
    order = np.lexsort((rows["c"][far], least[far]))
    a, b = least[far][order], rows["c"][far][order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table({"a": pa.array(a[once]), "b": pa.array(b[once])})


class SignatureTree:
    """Nodes over members in order: OR of bitmaps, least and greatest size, greatest excess of size over bits, component if one."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.levels = []
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        level = (bits, sizes, sizes, excess, comps)
        span = LEAF
        while True:
            starts = np.arange(0, len(level[0]), span)
            one = np.minimum.reduceat(level[4], starts) == np.maximum.reduceat(level[4], starts)
            comp = np.where(one & (level[4][starts] >= 0), level[4][starts], -1)
            level = (np.bitwise_or.reduceat(level[0], starts, axis=0), np.minimum.reduceat(level[1], starts), np.maximum.reduceat(level[2], starts), np.maximum.reduceat(level[3], starts), comp)
            self.levels.append(level)
            span = 4
            if len(starts) == 1:
                break

    def pairs(self, percent: int) -> Iterator[tuple[int, int]]:
        """Leaf nodes (numbers of spans of ``LEAF`` members) that may hold a pair of two components."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            depth, p, q = stack.pop()
            bits, least, most, excess, comp = self.levels[depth]
            if comp[p] >= 0 and comp[p] == comp[q]:
                continue
            overlap = int(np.bitwise_count(bits[p] & bits[q]).sum(dtype=np.int64)) + int(min(excess[p], excess[q]))
            if min(overlap, most[p], most[q]) * (100 + percent) < _need(least[p], least[q], percent) or 100 * most[p] < percent * least[q] or 100 * most[q] < percent * least[p]:
                continue
            if not depth:
                yield p, q
                continue
            below = len(self.levels[depth - 1][1])
            left, right = range(4 * p, min(4 * p + 4, below)), range(4 * q, min(4 * q + 4, below))
            stack += [(depth - 1, x, y) for x in left for y in right if p != q or x <= y]


def _candidates(classes, blocks, comps, sizes, raw, across: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places of two members, most promising overlap in thousandths) in different components that the signature tree can't rule out."""
    widths = np.array([len(r) for r in raw])
    found: list[tuple[np.ndarray, ...]] = []
    # Sets that can be linked have bitmaps of one width, or one of them has the next.
    for width in np.unique(widths).tolist():
        own = np.flatnonzero((widths == width) | (widths == 2 * width))
        own = own[np.lexsort((sizes[own], comps[own]))]
        n, c = sizes[own], comps[own]
        if len(own) < 2 or (c[0] == c).all():
            continue
        bits = np.stack([fold(raw[i], width) for i in own.tolist()])
        for p, q in SignatureTree(bits, n, c).pairs(percent):
            i, j = np.arange(p * LEAF, min(p * LEAF + LEAF, len(n))), np.arange(q * LEAF, min(q * LEAF + LEAF, len(n)))
            a, b = np.repeat(i, len(j)), np.tile(j, len(i))
            ok = (c[a] != c[b]) & ((widths[own[a]] == width) | (widths[own[b]] == width)) & (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a])
            if p == q:
                ok &= a < b
            if across:
                ok &= blocks[own[a]] != blocks[own[b]]
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            most = np.minimum(n[a] - np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64), n[b] - np.bitwise_count(bits[b] & ~bits[a]).sum(axis=1, dtype=np.int64))
            ok = most * (100 + percent) >= _need(n[a], n[b], percent)
            found.append((own[a[ok]], own[b[ok]], most[ok] * 1000 // (n[a[ok]] + n[b[ok]])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _groups(table) -> Iterator[tuple]:
    """The groups (list, i, j) of a pack, as tables."""
    table = table.combine_chunks().sort_by([("list", "ascending"), ("i", "ascending"), ("j", "ascending")])
    names, i, j = (table.column(c).to_numpy() for c in ("list", "i", "j"))
    edges = np.flatnonzero((names[1:] != names[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(names)], strict=True):
        yield table.slice(x, y - x), bool(i[x] != j[x])


def _with_sets(table, sets_of) -> Iterator[tuple]:
    """The groups of a pack with the sets of their texts; small groups' sets are made together, about ``SETS_BYTES`` of text at a time."""
    held, size = [], 0
    for group, across in _groups(table):
        own = group.column("text").nbytes
        if held and size + own > SETS_BYTES:
            yield from _parted(held, sets_of)
            held, size = [], 0
        held.append((group, across))
        size += own
    if held:
        yield from _parted(held, sets_of)


def _parted(held: list[tuple], sets_of) -> Iterator[tuple]:
    sets = iter(sets_of(pa.concat_tables([group for group, _ in held]).column("text").combine_chunks()))
    for group, across in held:
        yield group, across, list(islice(sets, group.num_rows))


def _survivors(percent: int):
    """Members of each list (or of two of its blocks) that a signature tree leaves a partner in another component."""

    def run(key, table):
        out = []
        for group, across in _groups(table):
            columns = [group.column(c).to_numpy() for c in ("class", "block", "comp", "n")]
            a, b, _ = _candidates(*columns, [np.frombuffer(r, np.uint8) for r in group.column("bits").to_pylist()], across, percent)
            if len(a):
                out.append(group.select(["list", "i", "j", "block", "class", "comp"]).take(pa.array(np.unique(np.concatenate([a, b])))))
        return pa.concat_tables(out) if out else table.select(["list", "i", "j", "block", "class", "comp"]).slice(0, 0)

    return run


def link_groups(table, sets_of, name_of, percent: int) -> Iterator[tuple[int, int]]:
    """Links (places in a group's table) that join components of each group of a pack, verified exactly, the most promising pairs first.

    ``sets_of`` gives the sets of a group's texts; ``name_of``, if given, the class that a set must have.
    """
    for group, across, sets in _with_sets(table, sets_of):
        classes, blocks, comps = (group.column(c).to_numpy() for c in ("class", "block", "comp"))
        _, comps = np.unique(comps, return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        a, b, worth = _candidates(classes, blocks, comps, sizes, [np.frombuffer(bitmap(s, 8), np.uint8) for s in sets], across, percent)
        tied = UnionFind(int(comps.max()) + 1)
        order = np.argsort(-worth, kind="stable")
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if tied.find(comps[x]) != tied.find(comps[y]):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both * (100 + percent) >= _need(sizes[x], sizes[y], percent) and (name_of is None or name_of(sets[x]) == classes[x] and name_of(sets[y]) == classes[y]):
                    tied.union(comps[x], comps[y])
                    yield group.column("node")[x].as_py(), group.column("node")[y].as_py()


def linked(sets_of, name_of, percent: int):
    """Links (u, v) of nodes that join the components of each group; ``text`` is each member's."""

    def run(key, table):
        found = list(link_groups(table, sets_of, name_of, percent))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def dealt_blocks(members: DataFrame, parts: int, block: int = LIST_BLOCK) -> DataFrame:
    """Members (list, class, m, ...) of lists of m as groups (list, i, j) of two blocks at most, and the pack that a group goes to."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    rest = [c for c in members.columns if c not in ("list", "m")]
    return (
        members.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("list", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", *rest)
        .withColumn("pack", F.pmod(F.xxhash64("list", "i", "j"), F.lit(parts)))
    )


def _texts(classes: DataFrame, info: DataFrame, docs: DataFrame) -> DataFrame:
    """class, text of each class's representative: doc_ids may occur again with other texts, so the text's hash is joined on too."""
    named = classes.join(info.select("class", F.col("doc_id").alias("id"), "key"), "class")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    return named.join(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").withColumnRenamed("key", "own"), same & (F.col("own") == F.col("key"))).dropDuplicates(["class"]).select("class", "text")


def _verify(pairs: DataFrame, info: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): those pairs of classes whose representatives' texts reach the threshold."""
    pairs = pairs.select("a", "b")
    texts = _texts(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct(), info, docs)
    full = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(slices([batch], "text_a"), "text_b"):
                left = part.column("text_a").dictionary_encode()
                sets = shingle_sets(*flat(left.dictionary), words)
                names = [class_of(s) for s in sets]
                other = shingle_sets(*flat(part.column("text_b")), words)
                keep = []
                for k, (i, a, b) in enumerate(zip(left.indices.to_pylist(), part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    if i is None or names[i] != a or class_of(other[k]) != b:
                        continue
                    x, y = sets[i], other[k]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * (100 + percent) >= _need(len(x), len(y), percent):
                        keep.append(k)
                yield part.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return full.mapInArrow(run, "u long, v long").distinct()


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, key, n, class of every document, with its group (a class that stands for all that are linked) and the group's least doc_id."""
    spark = docs.sparkSession
    parts = 8 * parts_of(spark)
    seen = materialize(profiles(docs, words), "profiles")
    own = seen.where("kind = 0").drop("kind")
    # A bounded number of shingles: only the order in which prefixes are taken depends on them.
    frequent = seen.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_AT).orderBy(F.desc("n"), "class").limit(HOT).collect()
    hot = np.array([r["class"] for r in sorted(frequent, key=lambda r: (r["n"], r["class"]))], dtype=np.int64).view(np.uint64)
    top = F.lit((1 << 63) - 1)
    info = own.where("n > 0").groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", top).alias("d"), "key", "n", "bits")).alias("x"))
    info = materialize(info.select("class", F.nullif(F.col("x.d"), top).alias("doc_id"), F.col("x.key").alias("key"), F.col("x.n").alias("n"), F.col("x.bits").alias("bits")), "classes")

    rows = prefix_rows(docs, hot, parts, words, percent)
    starred = materialize(rows.groupBy("part").applyInArrow(stars, "a long, b long").distinct(), "stars")

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and bitmaps allow the threshold."""
        x = pairs.join(info.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a").join(info.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for k, (na, nb, xa, xb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True)):
                    size = min(len(xa), len(xb))
                    p, q = fold(np.frombuffer(xa, np.uint8), size), fold(np.frombuffer(xb, np.uint8), size)
                    most = min(na - int(np.bitwise_count(p & ~q).sum(dtype=np.int64)), nb - int(np.bitwise_count(q & ~p).sum(dtype=np.int64)))
                    if most * (100 + percent) >= _need(na, nb, percent):
                        keep.append(k)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        fits = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
        return x.where(fits).select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")

    tried = materialize(bounded(starred), "pairs")
    links = materialize(_verify(tried, info, docs, words, percent), "links")
    # All lists with the same least member are one from here on, so a pair in several of them is met once. That member was held against all.
    sizes = starred.groupBy("a").agg(F.count("*").alias("m")).where("m > 1")
    wide = materialize(starred.join(sizes, "a").select(F.col("a").alias("list"), F.col("b").alias("class"), "m"), "lists")
    tied = components(links)
    comp = info.select("class", "n", "bits").join(tied.select(F.col("node").alias("class"), "component"), "class", "left")
    comp = materialize(comp.select("class", "n", "bits", F.coalesce("component", "class").alias("comp")), "comps")
    mixed = wide.join(comp.select("class", "comp"), "class").groupBy("list").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("list")
    dealt = dealt_blocks(wide.join(mixed, "list").join(comp, "class"), parts)
    left = dealt.groupBy("pack").applyInArrow(_survivors(percent), "list long, i int, j int, block int, class long, comp long")
    left = materialize(left, "survivors")
    known = _texts(left.select("class").distinct(), info, docs)
    again = left.join(known, "class").select("list", "i", "j", "block", "class", "comp", F.col("class").alias("node"), "text", F.pmod(F.xxhash64("list", "i", "j"), F.lit(parts)).alias("pack"))
    links = materialize(links.unionByName(again.groupBy("pack").applyInArrow(linked(lambda texts: shingle_sets(*flat(texts), words), class_of, percent), "u long, v long")), "links")
    tied = components(links).select(F.col("node").alias("class"), F.col("component").alias("group"))
    grouped = info.select("class", "doc_id").join(tied, "class", "left").select("class", "doc_id", F.coalesce("group", "class").alias("group"))
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    grouped = grouped.drop("doc_id").join(least, "group")
    return own.drop("bits").join(grouped, "class", "left").select("doc_id", "key", "n", "class", "group", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _judged(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the least doc_id (null is the last), then the least hash of the text and of the row, one of equal rows.

    Rows without shingles are their own component, one for each doc_id and text.
    """
    blank = lambda c: F.when(F.col("n") == 0, F.col(c))
    group = ["group", "blank_id", "blank_key"]
    judged = _judged(docs.select("doc_id", "text"), words, percent)
    rows = judged.select("doc_id", "key", "group", blank("doc_id").alias("blank_id"), blank("key").alias("blank_key")).groupBy("doc_id", "key", *group).agg(F.count("*").alias("times"))
    rows = materialize(rows, "rows")
    none = F.col("doc_id").isNull()
    first = rows.groupBy(*group).agg(F.min(F.struct(none.alias("none"), "doc_id", "key")).alias("x")).select(F.col("x.doc_id").alias("i"), F.col("x.key").alias("k"), F.lit(True).alias("first"))
    marked = rows.join(first, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").where("first is null or times > 1")
    marked = materialize(marked.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.coalesce("first", F.lit(False)).alias("__first")), "marked")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    single = docs.join(marked, same, "left_anti").select(*docs.columns)
    # Of a row that occurs again, with the same doc_id and text, one stays.
    again = docs.join(marked.where("__first").drop("__first"), same)
    row = F.struct(*docs.columns)
    again = again.groupBy("__id", "__key").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return single.unionByName(again)
