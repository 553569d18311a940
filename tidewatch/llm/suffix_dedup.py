"""Exact substring dedup: bytes of repeated 100-byte strings are removed wherever they recur.

1. Every document names anchors, places chosen from its bytes alone: each 100-byte string
   has one, and equal strings have theirs at the same place in them. Anchors are counted
   by their hash in packed blocks; those that occur once are done with.
2. An anchor that occurs again brings its context, the bytes of all strings that are
   its own. Of equal contexts the earliest stays and the others are covered. So are, in a
   second step, equal parts of contexts; contexts that share no part's common bytes with
   another can't hold a repeated string.
3. What is left differs somewhere. Its suffixes are sorted by the linear grouping
   construction, and neighbours that agree in 100 bytes form runs: all but the earliest
   string of a run are covered.
4. Covered strings are joined to their document and their bytes cut out.

Equal contexts are settled where they arise, over ``HOLD_BYTES`` of text at a time: only the
earliest goes on, so at most one row a buffer and context is shuffled, and text of a short
period brings one context and not one a byte. Contexts of hot anchors are dealt out by
anchor and context, so no task gathers an anchor: equal ones are settled again, and those
whose anchor has several kinds left are cut into contexts of fewer strings, keyed by the
bytes that all of these share, until nothing differs.

Which anchors occur again, and which are hot, goes to the tasks as Bloom filters of at most
``FILTER_BITS`` bits; one that is too full lets more contexts through, but none is lost.

Defined results: null text is empty; a null doc_id comes after all others; rows equal in
doc_id and text are one document, judged alike; a document under 100 bytes loses
nothing; a copy of an earlier document of 100 bytes or more loses all; an empty table
gives no rows. Documents of equal length and equal 64-bit hash count as equal, as do contexts
whose anchor and bytes agree in both 64-bit hashes. A long document is read in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import flat, has_words, materialize, mix, parts_of, powers, prefix_sums, range_hash, slices

LENGTH, GRAM = 100, 32
#: Strings that may share an anchor: their starts lie up to REACH bytes before it.
REACH = LENGTH - GRAM
FLUSH_ROWS = 1_000_000
#: Bytes of text hashed at a time: the arrays of eight times its size stay in a core's cache.
STEP_BYTES = 250_000
#: Text whose contexts are settled together before they are shuffled; stretches of a longer document, and their overlap.
HOLD_BYTES, STRETCH, MARGIN = 8_000_000, 500_000, 2 * LENGTH
#: Contexts of one anchor that a task takes together, about 8 MB of them; an anchor that may have more goes the other, as exact way.
CAP = 20_000
#: Rows of one anchor that a step counts, and classes that a task remembers: neither changes a result.
COUNTED, REMEMBERED = 64, 500_000
#: Into how many parts the strings of a hot context are cut at a time.
FAN = 4
FILTER_BITS = 1 << 28
#: Parts of an anchor's strings (first and last start) that are compared before any suffix is sorted.
ZONES = ((0, 16), (17, 33), (34, 50), (51, REACH))
SORT_BYTES = 1 << 17
_ROW = np.dtype([("t", "<u4"), ("o", "<u8")])


def suffix_order(text: list[int]) -> list[int]:
    """Start places of the suffixes of ``text`` in ascending order (an end sorts before any symbol).

    First, suffixes are grouped by their longest Lyndon prefix. Groups are taken in
    descending order; the members of one point to the nearest place before them that is
    in a lower group, and a place that k members point to is followed by k of the group's
    prefixes, so it moves to a new group just above its own, the higher the larger k.
    Then the groups' orders are emitted: in ascending order of suffixes, the place
    before each, and on along its pointers, takes the next seat of its group.
    """
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    symbols = sorted(by_symbol)
    members = [by_symbol[c] for c in symbols]
    size = [len(m) for m in members]
    below, above = [i - 1 for i in range(len(members))], [i + 1 for i in range(len(members))]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    points, done = [-1] * n, bytearray(n)
    g, order = len(members) - 1, []
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        own.sort()
        order.append(g)
        counts: dict[int, int] = {}
        for i in own:
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = points[p]
            points[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in counts.items():
                moves.setdefault((-k, group[p]), []).append(p)
            for (_, h), places in sorted(moves.items()) if len(moves) > 1 else moves.items():
                if len(places) == size[h]:
                    continue
                new = len(members)
                members.append(places)
                size.append(len(places))
                size[h] -= len(places)
                up = above[h]
                below.append(h)
                above.append(up)
                above[h] = new
                if up < len(below) and up != new:
                    below[up] = new
                for p in places:
                    group[p] = new
        g = below[g]
    seat, start = [0] * len(members), 0
    for g in reversed(order):
        seat[g] = start
        start += size[g]
    out, placed = [-1] * n, bytearray(n)
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            at = seat[group[j]]
            seat[group[j]] = at + 1
            out[at] = j
            j = points[j]
    return out


def _sliding(x: np.ndarray, w: int, of) -> np.ndarray:
    """of (minimum or maximum) over every w values in a row."""
    span, y = 1, x
    while 2 * span <= w:
        y = of(y[:-span], y[span:])
        span *= 2
    rest = w - span
    return of(y[: len(y) - rest], y[rest:]) if rest else y


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of grams that are least among those of some string of ``LENGTH`` bytes in one document."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(data) - GRAM + 1)
    sums = prefix_sums(data)
    hashed = (sums[GRAM:] - sums[: len(at)]) * powers(len(sums))[1][: len(at)]
    hashed = ((hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    least = _sliding(hashed, REACH + 1, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[at[: len(least)] + LENGTH > ends] = 0
    edge = np.zeros(REACH, np.uint64)
    top = _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
    places = np.flatnonzero(top[: len(hashed)] == hashed)
    return places, hashed[places]


def own_strings(places: np.ndarray, hashed: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose leftmost least gram is at each place; ``begin``, ``end``: the document's bounds."""
    low, high = np.maximum(places - REACH, begin), np.minimum(places, end - LENGTH)
    # The nearest place before that is as low, and the nearest after that is lower, bound the strings.
    left = right = np.arange(len(places))
    k = 0
    while len(left) or len(right):
        k += 1
        right = right[right >= k]
        right = right[places[right] - places[right - k] <= REACH]
        found = hashed[right - k] <= hashed[right]
        low[right[found]] = np.maximum(low[right[found]], places[right[found] - k] + 1)
        right = right[~found]
        left = left[left < len(places) - k]
        left = left[places[left + k] - places[left] <= REACH]
        found = hashed[left + k] < hashed[left]
        high[left[found]] = np.minimum(high[left[found]], places[left[found] + k] - REACH - 1)
        left = left[~found]
    return low, high


def _names(hashed: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Reducer part and 32-bit name of anchors."""
    mixed = mix(hashed)
    return (mixed % np.uint64(parts)).astype(np.int32), (mixed >> np.uint64(32)).astype(np.uint32)


def _stretches(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[tuple]:
    """(rows, bytes, offsets, base, first, end): wanted documents a step at a time.

    A long document comes in stretches that overlap; its anchors from ``first`` up to ``end`` of
    the bytes belong to this one, and ``base`` is where the bytes begin in the document.
    """
    for piece in slices(batches, "text", STEP_BYTES):
        piece = piece.take(pa.array(wanted(piece), pa.int64()))
        data, offsets = flat(piece.column("text"))
        if len(data) <= STRETCH:
            yield piece, data, offsets, 0, 0, len(data)
            continue
        for at in range(0, len(data), STRETCH):
            low, end = max(0, at - MARGIN), min(len(data), at + STRETCH)
            high = min(len(data), end + MARGIN)
            yield piece, data[low:high], np.array([0, high - low]), low, at - low, end - low


def _anchor_rows(docs: DataFrame, parts: int) -> DataFrame:
    """(part, rows): packed (anchor's name, hash of document and place) rows by reducer part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        count = 0

        def flush() -> pa.RecordBatch:
            part = np.concatenate([p for p, _ in held]) if held else np.zeros(0, np.int32)
            rows = np.concatenate([r for _, r in held]) if held else np.zeros(0, _ROW)
            held.clear()
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            bounds = pa.py_buffer((np.append(first, len(part)) * _ROW.itemsize).astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, bounds, pa.py_buffer(rows.tobytes())])], names=["part", "rows"])

        def fresh(piece: pa.RecordBatch) -> list[int]:
            if len(seen) > REMEMBERED:
                seen.clear()
            return [i for i, c in enumerate(piece.column("class").to_pylist()) if not (c in seen or seen.add(c))]

        for piece, data, offsets, base, begin, end in _stretches(batches, fresh):
            classes = piece.column("class").to_numpy()
            places, hashed = anchors(data, offsets)
            own = (places >= begin) & (places < end)
            places, hashed = places[own], hashed[own]
            # text of a short period has one anchor at very many places
            order = np.argsort(hashed, kind="stable")
            if len(order) > COUNTED:
                order = order[np.concatenate([np.ones(COUNTED, bool), hashed[order][COUNTED:] != hashed[order][:-COUNTED]])]
            places, hashed = places[order], hashed[order]
            doc = np.searchsorted(offsets, places, side="right") - 1
            rows = np.zeros(len(places), _ROW)
            part, rows["t"] = _names(hashed, parts)
            rows["o"] = mix(classes.view(np.uint64)[doc] + mix((places - offsets[doc] + base).astype(np.uint64)))
            held.append((part, rows))
            count += len(rows)
            if count >= FLUSH_ROWS:
                yield flush()
                count = 0
        yield flush()

    return docs.select("class", "text").mapInArrow(run, "part int, rows binary")


def _repeated(key, table):
    """Names of a part's anchors that occur more than once (equal documents counted once), as (part << 32) | name, and how often."""
    rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), dtype=_ROW)
    rows = rows[np.lexsort((rows["o"], rows["t"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["t"][1:] != rows["t"][:-1]) | (rows["o"][1:] != rows["o"][:-1])
    names, counts = np.unique(rows["t"][new], return_counts=True)
    keep = counts > 1
    return pa.table({"name": pa.array((key[0].as_py() << 32) | names[keep].astype(np.int64)), "n": pa.array(counts[keep])})


def _bits(names, bits: int):
    """The two places of a name in the filter."""
    mixed = mix(np.asarray(names).astype(np.uint64) + np.uint64(3))
    return (mixed & np.uint64(bits - 1)).astype(np.int64), ((mixed >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(repeated: DataFrame) -> np.ndarray:
    """Bloom filter of the repeated anchors, 16 bits for each up to ``FILTER_BITS`` in all."""
    wanted = 16 * max(1, repeated.count())
    bits = 1 << 16
    while bits < min(wanted, FILTER_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column("name").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bit"])

    words = repeated.select("name").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


_CONTEXT = "h long, lo int, hi int, x long, first long, class long, at int, hot boolean, bytes binary"
_RANGE = "first long, class long, a long, b long"


def _merged(first: np.ndarray, classes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of documents (first, class), those that touch made one."""
    order = np.lexsort((a, classes, first))
    first, classes, a, b = first[order], classes[order], a[order], b[order]
    if not len(a):
        return first, classes, a, b
    group = np.cumsum(np.concatenate([[False], (first[1:] != first[:-1]) | (classes[1:] != classes[:-1])])) << 32
    most = np.maximum.accumulate(b + group)
    new = np.flatnonzero(np.concatenate([[True], (a + group)[1:] > most[:-1]]))
    last = np.append(new[1:], len(a)) - 1
    return first[new], classes[new], a[new], most[last] - group[last]


def _repeats(h, x, first, classes, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts in order: those equal to the one before, and of these those at the very same place (of a row that occurs again)."""
    same, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
    again[1:] = same[1:] & (first[1:] == first[:-1]) & (classes[1:] == classes[:-1]) & (at[1:] == at[:-1])
    return same, again


def _context_batch(h, lo, hi, x, first, classes, at, hot, start, data) -> Iterator[pa.RecordBatch]:
    """Contexts whose bytes begin at ``start`` in ``data``: of equal ones the earliest, and the others' ranges as rows without bytes."""
    names = [c.split()[0] for c in _CONTEXT.split(", ")]
    order = np.lexsort((at, classes, first, x, h))
    same, again = _repeats(*(c[order] for c in (h, x, first, classes, at)))
    gone, kept = order[same & ~again], order[~same]
    f, c, a, b = _merged(first[gone], classes[gone], at[gone], at[gone] + hi[gone] - lo[gone] + LENGTH)
    none = np.zeros(len(f), np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(len(f), pa.int64()), pa.array(none), pa.array((b - a - LENGTH).astype(np.int32)), pa.nulls(len(f), pa.int64()), pa.array(f), pa.array(c), pa.array(a.astype(np.int32)), pa.array(none.astype(bool)), pa.nulls(len(f), pa.binary())], names=names
    )
    for i in range(0, len(kept), 100_000):
        k = kept[i : i + 100_000]
        sizes = hi[k] - lo[k] + LENGTH
        total = np.cumsum(sizes)
        raw = data[np.repeat(start[k] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        bounds = pa.py_buffer(np.concatenate([[0], total]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[k]), pa.array(lo[k].astype(np.int32)), pa.array(hi[k].astype(np.int32)), pa.array(x[k]), pa.array(first[k]), pa.array(classes[k]), pa.array(at[k].astype(np.int32)), pa.array(hot[k]), pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, bounds, pa.py_buffer(raw.tobytes())])],
            names=names,
        )


def _holds(names: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each name."""
    keep = np.ones(len(names), bool)
    for at in _bits(names, 64 * len(table)):
        keep &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return keep


def _contexts(docs: DataFrame, parts: int, words, hot) -> DataFrame:
    """Contexts of anchors that may occur again. ``lo``, ``hi``: first and last start of the strings, counted
    from ``REACH`` before the anchor; ``at``: where the bytes begin in the document; x: hash of the context.
    Rows without bytes are ranges that an equal context of the same task covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []

        def fresh(piece: pa.RecordBatch) -> list[int]:
            new = []
            if len(seen) > REMEMBERED:
                seen.clear()
            for i, (c, f) in enumerate(zip(piece.column("class").to_pylist(), piece.column("first").to_pylist(), strict=True)):
                if f < seen.get(c, 1 << 63):  # else a copy of an earlier document, which goes as a whole
                    seen[c] = f
                    new.append(i)
            return new

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _context_batch(*(np.concatenate(c) for c in zip(*held, strict=True)), np.concatenate(texts))
            held.clear()
            texts.clear()

        size = rows = 0
        for piece, data, offsets, base, begin, end in _stretches(batches, fresh):
            classes, firsts = piece.column("class").to_numpy(), piece.column("first").to_numpy()
            places, hashed = anchors(data, offsets)
            doc = np.searchsorted(offsets, places, side="right") - 1
            low, high = own_strings(places, hashed, offsets[doc], offsets[doc + 1])
            part, name = _names(hashed, parts)
            names = (part.astype(np.int64) << 32) | name.astype(np.int64)
            keep = (low <= high) & (places >= begin) & (places < end)
            keep[keep] = _holds(names[keep], words.value)
            places, hashed, doc, low, high, names = (x[keep] for x in (places, hashed, doc, low, high, names))
            start = low - places + REACH
            x = mix(range_hash(prefix_sums(data), low, high + LENGTH) + start.astype(np.uint64))
            held.append((hashed.view(np.int64), start, high - places + REACH, x.view(np.int64), firsts[doc], classes[doc], low - offsets[doc] + base, _holds(names, hot.value), low + size))
            texts.append(data)
            size += len(data)
            rows += len(start)
            if size >= HOLD_BYTES or rows >= FLUSH_ROWS:
                yield from flush()
                size = rows = 0
        yield from flush()

    return docs.select("first", "class", "text").mapInArrow(run, _CONTEXT)


def _settled(found: DataFrame) -> DataFrame:
    """Contexts without those equal to an earlier one, whose ranges take their place; dealt out by anchor and context."""
    dealt = found.repartition(parts_of(found.sparkSession), "h", "x").sortWithinPartitions("h", "x", "first", "class", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = [batch.column(c).to_numpy() for c in ("h", "x", "first", "class", "at")]
            same, again = _repeats(*rank)
            now = tuple(c[0] for c in rank)
            if before is not None:
                same[0], again[0] = before[:2] == now[:2], before == now
            before = tuple(c[-1] for c in rank)
            gone = pa.array(same)
            columns = {c: pc.if_else(gone, pa.scalar(None, batch.column(c).type), batch.column(c)) if c in ("h", "bytes") else batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns, schema=batch.schema).filter(pa.array(~again))

    return dealt.mapInArrow(run, found.schema)


def _parted(words):
    """Contexts whose anchor the filter ``words`` may hold, as contexts of fewer strings, keyed by the bytes that these share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", HOLD_BYTES):
            batch = batch.take(pa.array(np.flatnonzero(_holds(batch.column("h").to_numpy(), words.value))))
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column("bytes"))
            sums = prefix_sums(data)
            h, lo, hi, first, classes, at, zone, span = (batch.column(c).to_numpy().astype(np.int64) for c in ("h", "lo", "hi", "first", "class", "at", "zone", "span"))
            step = -(-span // FAN)
            out = []
            for k in range(FAN):
                a = zone + k * step
                b = np.minimum(a + step, zone + span) - 1
                low, high = np.maximum(lo, a), np.minimum(hi, b)
                ok = np.flatnonzero(low <= high)
                a, b, low, high, start = a[ok], b[ok], low[ok], high[ok], offsets[:-1][ok]
                core = range_hash(sums, start + b - lo[ok], start + a - lo[ok] + LENGTH)
                x = mix(range_hash(sums, start + low - lo[ok], start + high - lo[ok] + LENGTH) + low.astype(np.uint64))
                name = mix(h[ok].view(np.uint64) + mix(core + mix((a * 256 + b).astype(np.uint64))))
                out.append((name.view(np.int64), low, high, x.view(np.int64), first[ok], classes[ok], at[ok] + low - lo[ok], a, b - a + 1, start + low - lo[ok]))
            h, lo, hi, x, first, classes, at, zone, span, start = (np.concatenate(c) for c in zip(*out, strict=True))
            for z in np.unique(zone).tolist():
                own = np.flatnonzero(zone == z)
                for part in _context_batch(*(c[own] for c in (h, lo, hi, x, first, classes, at)), np.ones(len(own), bool), start[own], data):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(n, z, np.int32)), pa.array(np.full(n, span[own[0]], np.int32))], names=[*part.schema.names, "zone", "span"])

    return run


def _zones(r: tuple, zones) -> Iterator[tuple]:
    """Parts of a context (lo, hi, bytes): (zone, bytes that all strings of the zone share, lo, hi, bytes)."""
    low, high, raw = r
    for zone in zones:
        lo, hi = max(low, zone[0]), min(high, zone[1])
        if lo <= hi:
            yield zone, raw[zone[1] - low : zone[0] - low + LENGTH], lo, hi, raw[lo - low : hi - low + LENGTH]


def _covered_strings(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """(row, start in its bytes) of every string that also starts earlier; rows: (order, bytes)."""
    text: list[int] = []
    owner, start, begin = [], [], []
    for k, (_, raw) in enumerate(rows):
        begin.append(len(text))
        text.extend(raw)
        text.append(256)  # no string of LENGTH bytes holds an end
        m = len(raw) - LENGTH + 1
        owner.append(np.full(m, k))
        start.append(np.arange(m))
    owner, start = np.concatenate(owner), np.concatenate(start)
    place = np.asarray(begin)[owner] + start
    where = np.full(len(text), -1)
    where[place] = np.arange(len(place))
    order = where[np.asarray(suffix_order(text))]
    order = order[order >= 0]
    flat_bytes = np.asarray(text, dtype=np.int16).astype(np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(flat_bytes, LENGTH)
    new = np.ones(len(order), bool)
    for a in range(0, len(order) - 1, 4096):
        b = min(a + 4097, len(order))
        w = windows[place[order[a:b]]]
        new[a + 1 : b] = (w[1:] != w[:-1]).any(axis=1)
    run = np.cumsum(new) - 1
    rank = np.asarray([r[0] for r in rows], dtype=[("f", "<i8"), ("c", "<i8"), ("a", "<i8")])
    by = [rank["f"][owner[order]], rank["c"][owner[order]], rank["a"][owner[order]] + start[order]]
    key = np.lexsort((*by[::-1], run))
    first = np.flatnonzero(np.concatenate([[True], run[key][1:] != run[key][:-1]]))
    earliest = np.repeat(key[first], np.diff(np.append(first, len(key))))
    # two contexts of one document may hold the very same string: that isn't a later one
    late = order[key[np.any([x[key] != x[earliest] for x in by], axis=0)]]
    return zip(owner[late].tolist(), start[late].tolist(), strict=True)


def _covered(rows: list[tuple]) -> list[tuple]:
    """Covered ranges (first, class, a, b) of contexts that a suffix sort decides; rows: ((first, class, at), bytes)."""
    spans: dict[int, list[int]] = {}
    for k, s in _covered_strings(rows):
        spans.setdefault(k, []).append(s)
    out = []
    for k, starts in spans.items():
        starts.sort()
        first, c, at = rows[k][0]
        a = b = starts[0]
        for s in [*starts[1:], 1 << 40]:
            if s > b + 1:
                out.append((first, c, at + a, at + b + LENGTH))
                a = s
            b = s
    return out


def _collapse(rows: list[tuple], out: list[tuple]) -> list[tuple]:
    """Rows ((first, class, at), lo, hi, bytes) in order, without those equal to an earlier one, which are covered."""
    seen: set[tuple] = set()
    rest = []
    for r in rows:
        if (k := (r[1], r[3])) in seen:
            out.append((*r[0][:2], r[0][2], r[0][2] + len(r[3])))
        else:
            seen.add(k)
            rest.append(r)
    return rest


def _decide(key, table):
    """Covered ranges among the contexts of a part's anchors."""
    table = table.combine_chunks()
    h, x, first, c, start = (table.column(n).to_numpy() for n in ("h", "x", "first", "class", "at"))
    order = np.lexsort((start, c, first, x, h))
    same, again = _repeats(*(v[order] for v in (h, x, first, c, start)))
    # Of equal contexts the earliest stays; anchors with one kind of context are settled by that.
    copies, kinds = order[same & ~again], order[~same]
    sizes = table.column("hi").to_numpy()[copies] - table.column("lo").to_numpy()[copies] + LENGTH
    settled = [first[copies], c[copies], start[copies].astype(np.int64), start[copies].astype(np.int64) + sizes]
    several = np.zeros(len(kinds), bool)
    several[1:] |= h[kinds][1:] == h[kinds][:-1]
    several[:-1] |= h[kinds][1:] == h[kinds][:-1]
    table = table.take(pa.array(kinds[several]))
    rows = sorted(zip(*(table.column(n).to_pylist() for n in ("h", "first", "class", "at", "lo", "hi", "bytes")), strict=True))
    out: list[tuple] = []
    held: list[tuple] = []
    size = at = 0
    while at < len(rows):
        to = at
        while to < len(rows) and rows[to][0] == rows[at][0]:
            to += 1
        group = _collapse([(r[1:4], *r[4:]) for r in rows[at:to]], out) if to - at > 1 else []
        at = to
        if len(group) < 2:
            continue
        parts: dict[tuple, list[tuple]] = {}
        for (first, c, start), low, high, raw in group:
            for zone, core, lo, hi, part in _zones((low, high, raw), ZONES):
                parts.setdefault((zone, core), []).append(((first, c, start + lo - low), lo, hi, part))
        for part in parts.values():
            if len(part) > 1 and len(part := _collapse(part, out)) > 1:
                held += [(r[0], r[3]) for r in part]
                size += sum(len(r[3]) for r in part)
        if size >= SORT_BYTES:
            out += _covered(held)
            held, size = [], 0
    if held:
        out += _covered(held)
    cols = list(zip(*out, strict=True)) or [()] * 4
    found = _merged(*(np.concatenate([np.asarray(v, np.int64), np.asarray(w, np.int64)]) for v, w in zip(settled, cols, strict=True)))
    return pa.table({n: pa.array(v) for n, v in zip(("first", "class", "a", "b"), found, strict=True)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc_id, text, n, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n_bytes", "ranges")), strict=True):
            raw = (text or "").encode()
            kept, merged = hashlib.sha256(), []
            for r in sorted(ranges or [], key=lambda r: r["a"]):
                if merged and r["a"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r["b"])
                else:
                    merged.append([r["a"], r["b"]])
            at = 0
            for a, b in merged:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            for c, v in zip(out, (doc_id, n, sum(b - a for a, b in merged), len(merged), kept.hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(first, class, ranges): the covered bytes (they may overlap) of each document that loses any.

    ``docs``: first (doc_id, null last), class (hash of the text), n_bytes, text.
    """
    spark = docs.sparkSession
    parts = 8 * parts_of(spark)
    long = docs.where(F.col("n_bytes") >= LENGTH)
    counted = _anchor_rows(long, parts).groupBy("part").applyInArrow(_repeated, "name long, n long")
    counted = materialize(counted, "anchors")
    share = spark.sparkContext.broadcast
    found = _contexts(long, parts, share(_filter(counted)), share(_filter(counted.where(F.col("n") > CAP))))
    found = materialize(found, "contexts")
    plain = found.where("bytes is not null and not hot").withColumn("pack", F.pmod(F.xxhash64("h"), F.lit(parts)))
    ranges = plain.groupBy("pack").applyInArrow(_decide, _RANGE)
    covered = F.col("at").cast("long").alias("a"), (F.col("at") + F.col("hi") - F.col("lo") + LENGTH).cast("long").alias("b")
    ranges = ranges.unionByName(found.where("bytes is null").select("first", "class", *covered))
    found = found.where("bytes is not null and hot").withColumns({"zone": F.lit(0), "span": F.lit(REACH + 1)})
    while found.head(1):
        found = materialize(_settled(found), "settled")
        ranges = ranges.unionByName(found.where("bytes is null").select("first", "class", *covered))
        kinds = found.where("bytes is not null").groupBy(F.col("h").alias("name")).agg(F.min("x").alias("least"), F.max("x").alias("most"))
        kinds = materialize(kinds.where("least < most").select("name"), "kinds")
        if not kinds.head(1):
            break
        found = materialize(found.where("bytes is not null").mapInArrow(_parted(share(_filter(kinds))), found.schema), "contexts")
        ranges = ranges.unionByName(found.where("bytes is null").select("first", "class", *covered))
        found = found.where("bytes is not null")
    whole = docs.groupBy("class", "n_bytes").agg(F.min("first").alias("least"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n_bytes") >= LENGTH))
    copies = docs.select("first", "class", "n_bytes").join(whole, ["class", "n_bytes"]).where("first > least")
    ranges = ranges.unionByName(copies.select("first", "class", F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b")).distinct())
    return ranges.groupBy("first", "class").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"first": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "class": F.xxhash64(text), "n_bytes": F.octet_length(text).cast("long")})


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    keyed = _keyed(docs.select("doc_id", "text"))
    judged = keyed.join(removed_ranges(keyed), ["first", "class"], "left").select("doc_id", "text", "n_bytes", "ranges")
    return judged.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without their ranges, which give way to characters that they would split."""
    for batch in batches:
        texts = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            if text is not None and ranges:
                raw = text.encode()
                gone = np.zeros(len(raw) + 1, np.int32)
                for r in ranges:
                    gone[r["a"]] += 1
                    gone[r["b"]] -= 1
                keep = np.cumsum(gone[:-1]) <= 0
                data = np.frombuffer(raw, np.uint8)
                head = np.flatnonzero((data & 0xC0) != 0x80)
                keep = np.repeat(np.logical_or.reduceat(keep, head), np.diff(np.append(head, len(data))))
                text = data[keep].tobytes().decode()
            texts.append(text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["ranges"])


def cut_repeats(docs: DataFrame, emptied: bool = True) -> DataFrame:
    """``docs``, all columns, with the covered bytes cut from ``text``, as far as they are whole characters.

    ``emptied`` False: a document that loses bytes and has no word left goes.
    """
    plain = _keyed(docs.select("doc_id", "text"))
    # one column for all others, so that names can't clash
    keyed = _keyed(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own")))
    full = keyed.join(removed_ranges(plain), ["first", "class"], "left").select("own", "text", F.col("ranges").isNotNull().alias("loses"), "ranges")
    schema = ", ".join(f"`{n}` {t}" for n, t in full.drop("ranges").dtypes)
    cut = full.mapInArrow(_cut_text, schema)
    if not emptied:
        cut = cut.where(~F.col("loses") | has_words("text"))
    return cut.select(*((F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c)) for c in docs.columns))
