"""Fuzzy line dedup: of lines alike in their characters, one stays in the whole corpus.

1. Every line that isn't blank has the set of its character shingles and their MinHash
   signature. Bands of the signature are dealt out by their hash, in packed blocks, so
   lines that agree in a band meet; equal lines are one class.
2. Classes that meet are held against the least one of their band; where that leaves
   several components, the rest of the band is held against one another in blocks.
   Pairs are verified by the exact Jaccard similarity of their shingle sets; pairs within
   one component are skipped, so a large group never makes all its pairs.
3. A distributed union-find joins verified pairs; a component keeps its first line.

Defined results: null text has no lines; blank lines are kept and count as lines; a line
shorter than a shingle is its own one shingle; the first line is the one with the
smallest doc_id (null last), then the smallest hash of its row, then the first place; rows
equal in doc_id and text are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, mix, parts_of, powers, slices
from tidewatch.llm.components import components
from tidewatch.llm.jaccard_join import dealt_blocks, linked
from tidewatch.llm.jaccard_join import stars as stars_of

SHINGLE, PERCENT = 8, 75
#: A pair at the threshold meets in some band with probability 1 - (1 - 0.75**3)**10 = 0.996; at 0.85, 0.9999.
BANDS, BAND_ROWS = 10, 3
#: Rows packed at a time, and classes that a task remembers so as not to pack them again; neither changes a result.
FLUSH_ROWS, REMEMBERED = 1_000_000, 500_000
_MULTIPLIERS = np.random.default_rng(31).integers(1, 2**31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROW = np.dtype([("t", "<u4"), ("n", "<u4"), ("c", "<i8")])
#: Bytes of text whose arrays a core's own cache holds; doesn't change a result.
PIECE_BYTES = 150_000
_BLANK = [0x20, 0x09, 0x0B, 0x0C, 0x0D]
_INK = np.ones(0x22, bool)
_INK[_BLANK] = False


@cache
def _weights() -> np.ndarray:
    """The share of each code point in a rolling sum."""
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(7))


class Lines:
    """Lines of some texts as ranges of code points."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(t or "" for t in texts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t or "") for t in texts], np.int64)
        self.text_start = np.cumsum(sizes + 1) - (sizes + 1)
        breaks = np.flatnonzero(self.points == 0x0A)
        self.start = np.concatenate([[0], breaks + 1]) if len(texts) else np.zeros(0, np.int64)
        self.end = np.concatenate([breaks, [len(self.points)]]) if len(texts) else np.zeros(0, np.int64)
        up, self.down = powers(len(self.points) + 1)
        self.sums = np.zeros(len(self.points) + 1, np.uint64)
        weights = _weights().take(self.points)
        weights *= up[: len(weights)]
        np.cumsum(weights, out=self.sums[1:])

    def bounds(self) -> np.ndarray:
        """The first line of each text, and the number of lines."""
        return np.append(np.searchsorted(self.start, self.text_start), len(self.start))

    def inked(self) -> np.ndarray:
        """Whether each line holds more than white space."""
        ink = np.zeros(len(self.points) + 1, np.int32)
        np.cumsum(_INK.take(np.minimum(self.points, 0x21)), out=ink[1:])
        return ink[self.end] > ink[self.start]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def classes(self) -> np.ndarray:
        """64-bit hash of each line; 0 marks a blank line."""
        return np.where(self.inked(), self.hashes(self.start, self.end) | np.uint64(1), np.uint64(0)).view(np.int64)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of the given lines, one line after another, and their bounds."""
        start, end = self.start[which], self.end[which]
        counts = np.maximum(end - start - SHINGLE + 1, 1)
        total = np.cumsum(counts)
        first = np.repeat(start - (total - counts), counts)
        first += np.arange(len(first))
        # of every place, then of the lines' places; a line shorter than a shingle is told by its own end
        places = max(len(self.points) - SHINGLE + 1, 0)
        every = np.zeros(len(self.points) + 1, np.uint64)
        np.subtract(self.sums[SHINGLE:], self.sums[:places], out=every[:places])
        every[:places] *= self.down[:places]
        every[:places] += np.uint64(SHINGLE)
        hashed = mix(every.take(first))
        short = np.flatnonzero(end - start < SHINGLE)
        hashed[total[short] - 1] = self.hashes(start[short], end[short])
        return hashed, np.concatenate([[0], total])


def signatures(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash of each set: a row of 32-bit minima."""
    out = np.zeros((len(_MULTIPLIERS), len(bounds) - 1), np.uint32)
    if len(bounds) > 1:
        short = (hashed >> np.uint64(32)).astype(np.uint32)
        product = np.empty_like(short)
        for row, m in zip(out, _MULTIPLIERS, strict=True):
            np.minimum.reduceat(np.multiply(short, m, out=product), bounds[:-1], out=row)
    return out.T


def _order(docs: DataFrame) -> DataFrame:
    """docs with first (doc_id, null last) and row (hash of doc_id and text)."""
    return docs.withColumns({"first": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "row": F.xxhash64("doc_id", "text")})


def _line_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, classes = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for part in slices([batch], "text", PIECE_BYTES):
            lines = Lines(part.column("text").to_pylist())
            bounds.append(lines.bounds()[1:] + bounds[-1][-1])
            classes.append(lines.classes())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), pa.array(np.concatenate(classes)))
        yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("row"), lists], names=["first", "row", "lines"])


def _band_rows(docs: DataFrame, parts: int) -> DataFrame:
    """(part, rows): packed (band, number of shingles, class) rows by reducer part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.uint64)
            rows = np.concatenate([r for _, r in held]) if held else np.zeros(0, _ROW)
            held.clear()
            part = (keys % np.uint64(parts)).astype(np.int32)
            rows["t"] = (keys >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            bounds = pa.py_buffer((np.append(first, len(part)) * _ROW.itemsize).astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, bounds, pa.py_buffer(rows.tobytes())])], names=["part", "rows"])

        for piece in slices(batches, "text", PIECE_BYTES):
            lines = Lines(piece.column("text").to_pylist())
            classes = lines.classes()
            if len(seen) > REMEMBERED:
                seen.clear()
            names, at = np.unique(classes, return_index=True)
            new = np.array([i for c, i in zip(names.tolist(), at.tolist(), strict=True) if c and c not in seen], np.int64)
            if not len(new):
                continue
            new.sort()
            classes = classes[new]
            seen.update(classes.tolist())
            hashed, bounds = lines.shingles(new)
            signs = signatures(hashed, bounds).astype(np.uint64).reshape(len(new), BANDS, BAND_ROWS)
            keys = np.zeros((len(new), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(BAND_ROWS):
                keys = mix(keys + signs[:, :, r])
            rows = np.zeros(len(new) * BANDS, _ROW)
            rows["n"], rows["c"] = np.repeat(np.diff(bounds), BANDS), np.repeat(classes, BANDS)
            held.append((keys.reshape(-1), rows))
            count += len(rows)
            if count >= FLUSH_ROWS:
                yield flush()
                count = 0
        yield flush()

    return docs.select("text").mapInArrow(run, "part int, rows binary")


def line_sets(texts) -> list[np.ndarray]:
    """The shingle set of each line."""
    out = []
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    for piece in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", PIECE_BYTES):
        lines = Lines(piece.column("text").to_pylist())
        hashed, bounds = lines.shingles(np.arange(len(lines.start)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.sort(hashed[a:b])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose shingle sets are similar enough."""
    full = pairs.join(texts.toDF("b", "line_b"), "b").join(texts.toDF("a", "line_a"), "a").select("a", "b", "line_a", "line_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(slices([batch], "line_a"), "line_b"):
                left = part.column("line_a").dictionary_encode()
                sets = [line_sets(left.dictionary), line_sets(part.column("line_b"))]
                keep = []
                for k, i in enumerate(left.indices.to_pylist()):
                    x, y = sets[0][i], sets[1][k]
                    if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                        met = np.concatenate([x, y])
                        met.sort()
                        both = int(np.count_nonzero(met[1:] == met[:-1]))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            keep.append(k)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return full.mapInArrow(run, "a long, b long")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted line: (class, line) from documents with the places and classes wanted of them."""
    for batch in batches:
        classes, lines = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            own = (text or "").split("\n")
            for w in wanted:
                classes.append(w["class"])
                lines.append(own[w["pos"]])
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(lines, pa.string())], names=["class", "line"])


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(first, row, n_lines, removed): for every row of ``docs``, the places of lines that go."""
    parts = 8 * parts_of(docs.sparkSession)
    source = _order(docs)
    own = materialize(source.select("first", "row", "text").mapInArrow(_line_classes, "first long, row long, lines array<long>"), "lines")
    each = own.select("first", "row", F.posexplode("lines").alias("pos", "class")).where("class != 0")
    place = F.struct("first", "row", "pos")
    earliest = materialize(each.groupBy("class").agg(F.min(place).alias("at"), F.count("*").alias("n")), "earliest")

    stars = materialize(_band_rows(docs, parts).groupBy("part").applyInArrow(stars_of, "a long, b long").distinct(), "stars")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(earliest, "class")
    wanted = wanted.groupBy(F.col("at.first").alias("first"), F.col("at.row").alias("row")).agg(F.collect_list(F.struct("class", F.col("at.pos").alias("pos"))).alias("wanted"))
    texts = source.select("first", "row", "text").join(wanted, ["first", "row"]).mapInArrow(_pick, "class long, line string")
    texts = materialize(texts.dropDuplicates(["class"]), "texts")
    links = materialize(_verified(stars, texts, percent), "links")

    tied = components(links)
    # All lists with the same least class are one from here on; that class was held against all.
    sizes = stars.groupBy("a").agg(F.count("*").alias("m")).where("m > 1")
    wide = stars.join(sizes, "a").select(F.col("a").alias("list"), F.col("b").alias("class"), "m")
    wide = wide.join(tied.toDF("class", "component"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
    wide = materialize(wide, "wide")
    mixed = wide.groupBy("list").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("list")
    rest = dealt_blocks(wide.join(mixed, "list").join(texts.toDF("class", "text"), "class").withColumn("node", F.col("class")), parts)
    links = materialize(links.unionByName(rest.groupBy("pack").applyInArrow(linked(line_sets, None, percent), "u long, v long").toDF("a", "b")), "links")

    tied = materialize(components(links).toDF("class", "component"), "tied")
    keeper = tied.join(earliest, "class").groupBy("component").agg(F.min("at").alias("keep"))
    fate = earliest.join(tied.join(keeper, "component").select("class", "keep"), "class", "left").where((F.col("n") > 1) | F.col("keep").isNotNull())
    fate = materialize(fate.select("class", F.coalesce("keep", "at").alias("keep")), "fate")
    gone = each.join(fate, "class").where(place != F.col("keep")).groupBy("first", "row").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    return own.select("first", "row", F.size("lines").alias("n_lines")).distinct().join(gone, ["first", "row"], "left")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            if text is not None and removed:
                gone = set(removed)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            texts.append(text)
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, "text", pa.array(texts, pa.string()))
        yield batch.drop_columns(["removed"])


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with the repeated lines cut from ``text``, and n_lines and n_removed."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    judged = repeated_lines(docs.select("doc_id", "text"), percent).withColumn("n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long"))
    judged = judged.select("first", "row", F.col("n_lines").cast("long").alias("n_lines"), F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"), "removed")
    # one column for all others, so that names can't clash
    keys = _order(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in own if c != "text")).alias("own")))
    full = keys.join(judged, ["first", "row"], "left").select("text", "own", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "removed")
    schema = ", ".join(f"`{n}` {t}" for n, t in full.drop("removed").dtypes)
    cut = full.mapInArrow(_without, schema)
    return cut.select(*((F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c)) for c in own), "n_lines", "n_removed")


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_crc32 of what stays of every document."""
    out = line_dedup(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), "n_removed", F.length(text).cast("long").alias("n_chars"), F.crc32(text).alias("text_crc32"))
