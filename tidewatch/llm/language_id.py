"""Language identification by a byte convolutional network.

Filters of several widths slide over windows of a fixed number of bytes; the largest
response of each filter in a window feeds a softmax. The network is trained in numpy on
windows of a bounded sample of labelled documents and then reads every window of every
text; a text's prediction is the mean of its windows' probabilities, by their bytes.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is any
text if there is nothing to learn from. A null doc_id isn't held out and isn't learned
from. Ties go to the first language in alphabetical order. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import _LOWER, flat, slices

#: Bound on the labelled documents that the network learns from: those with the smallest hash of doc_id of each language
#: (so many at most that Spark limits them before the shuffle), filled up by the smallest of all.
LEARN_ROWS, EACH_ROWS = 6_000, 1_000
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
WINDOWS_EACH, EPOCHS, BATCH = 2, 8, 64
UNKNOWN = "und"


def remainder() -> Column:
    """crc32 of doc_id as text, mod 4: 2 marks the held-out documents."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(-1))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (zero bytes fill the last of each), their text and their sizes."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    docs = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    out[np.repeat(first * WINDOW - offsets[:-1], lengths) + np.arange(len(data))] = _LOWER[data]
    within = np.arange(len(docs)) - first[docs]
    return out.reshape(-1, WINDOW), docs, np.minimum(lengths[docs] - within * WINDOW, WINDOW)


class ByteConv:
    """tables[w][k]: response of the filters of width w to each byte at place k."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self._pairs = None

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window, and where it is."""
        tops, places = [], []
        for w, table in zip(WIDTHS, self.tables, strict=True):
            n = x.shape[1] - w + 1
            response = sum(table[k][x[:, k : k + n]] for k in range(w))
            at = response.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(tops, axis=1) + self.bias, places

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 9) -> None:
        """Adam on the cross entropy; only the places of the maxima get gradients."""
        rng, step = np.random.default_rng(seed), 0
        params = [*self.tables, self.bias, self.dense, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for epoch in range(EPOCHS):
            for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                xb, step = x[batch], step + 1
                raw, places = self.pooled(xb)
                hidden = np.maximum(raw, 0)
                p = softmax(hidden @ self.dense + self.out_bias)
                p[np.arange(len(batch)), y[batch]] -= 1
                p /= len(batch)
                back = (p @ self.dense.T) * (raw > 0)
                grads = []
                for i, (w, table) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                    g, own = np.zeros_like(table), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(xb, places[i] + k, axis=1), np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                rate = 0.02 * 0.7**epoch
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window. Neighbouring bytes are looked up in pairs: half as many lookups."""
        if self._pairs is None:
            self._pairs = [[(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(t) - 1, 2)] for t in self.tables]
        pair = x[:, :-1].astype(np.int64) * 256 + x[:, 1:]
        tops = []
        for w, table, pairs in zip(WIDTHS, self.tables, self._pairs, strict=True):
            n = x.shape[1] - w + 1
            response = pairs[0][pair[:, :n]]
            for j in range(1, len(pairs)):
                response += pairs[j][pair[:, 2 * j : 2 * j + n]]
            if w % 2:
                response += table[-1][x[:, w - 1 :]]
            tops.append(response.max(axis=1))
        return softmax(np.maximum(np.concatenate(tops, axis=1) + self.bias, 0) @ self.dense + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, rows: int = LEARN_ROWS) -> ByteConv | None:
    """Train on at most ``rows`` labelled documents that aren't held out, a few windows of each."""
    usable = (remainder() != 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ids = docs.where(usable).select("lang", "doc_id").distinct().withColumn("hash", F.xxhash64("doc_id"))
    each = max(1, min(EACH_ROWS, rows // max(1, docs.where("lang is not null").select("lang").distinct().count())))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    own = ids.withColumn("nth", nth).where(F.col("nth") <= each).select("doc_id", "hash", F.lit(0).alias("rest"))
    filled = own.unionByName(ids.orderBy("hash", "doc_id").limit(rows).select("doc_id", "hash", F.lit(1).alias("rest")))
    chosen = filled.groupBy("doc_id", "hash").agg(F.min("rest").alias("rest")).orderBy("rest", "hash", "doc_id").limit(rows).select("doc_id")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, of, _ = windows(*flat(part.column("text")))
            counts = np.bincount(of, minlength=part.num_rows)
            first = np.cumsum(counts) - counts
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            take = np.concatenate([first + (ids * 31 + 17 * k) % np.maximum(counts, 1) for k in range(WINDOWS_EACH)])
            rows_ = np.tile(np.arange(part.num_rows), WINDOWS_EACH)
            keep = np.tile(counts > 0, WINDOWS_EACH)
            take, rows_ = take[keep], rows_[keep]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows_)), part.column("lang").take(pa.array(rows_)), pa.array([x[i].tobytes() for i in take], pa.binary())],
                names=["doc_id", "lang", "window"],
            )

    # At most ``rows`` ids are broadcast, and a few windows of each come to the driver.
    sample = docs.where(usable).select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    found = sorted((r.doc_id, r.lang, bytes(r.window)) for r in sample.mapInArrow(some, "doc_id long, lang string, window binary").collect())
    langs = sorted({r[1] for r in found})
    if not langs:
        return None
    model = ByteConv(langs)
    if len(langs) > 1:
        x = np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(-1, WINDOW)
        model.train(x, np.array([langs.index(r[1]) for r in found]))
    return model


def language_id(docs: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = fit(docs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            data, offsets = flat(part.column("text"))
            n = part.num_rows
            letters = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123) | (data >= 65) & (data < 91))])
            readable = letters[offsets[1:]] > letters[offsets[:-1]]
            for i in np.flatnonzero(~readable & (np.diff(offsets) > 0)):
                readable[i] = any(c.isalpha() for c in part.column("text")[int(i)].as_py())
            names, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            if model is not None and len(data):
                x, of, sizes = windows(data, offsets)
                total = np.zeros((n, len(model.langs)))
                for a in range(0, len(x), 256):
                    np.add.at(total, of[a : a + 256], model.predict(x[a : a + 256]) * sizes[a : a + 256, None])
                mean = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
                best = mean.argmax(axis=1)
                names[readable] = np.array(model.langs, dtype=object)[best[readable]]
                scores[readable] = np.clip(mean[np.arange(n), best], 0, 1)[readable]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    inputs = docs.select("doc_id", "text", (remainder() == 2).alias("held_out"))
    return inputs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
