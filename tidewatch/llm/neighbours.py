"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample along random directions; every vector is then filed
under its leaf in every tree. A query walks all trees through one priority queue ordered
by its margin to the splits and takes the leaves it reaches first; the vectors in them
are ranked by exact cosine in double precision. How many leaves are taken is fitted on
the sample, as the fewest that find ``TARGET`` of its true neighbours.

Equal vectors are one entry with their smallest ids, and equal queries are searched once,
so a vector that fills a third of the table costs no more than another. A leaf is dealt out
in salted parts that meet its queries in one shuffle, so no task holds a whole leaf. Trees
deepen with the table, up to ``MAX_DEPTH``, the bound on what is broadcast; beyond
``LEAF << MAX_DEPTH`` vectors leaves grow with the table. Vectors of each length have a forest of their
own, of one leaf where they are few, and are neighbours among themselves.

Defined results: vectors that are null, zero, or hold null, infinite or NaN components take no
part; a null vec_id takes no part; rows with the same vec_id count as one, by its first
vector in sort order; scores that are equal to 12 decimals are ties, as those of parallel vectors are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, parts_of

K, EVERY = 5, 50
TREES, LEAF, MAX_DEPTH = 4, 400, 12
#: Bounds on the distinct vectors that trees are fitted on (16 a leaf between the two), and the recall sought among them.
SAMPLE, MOST_SAMPLE, TARGET, PROBES = 8_000, 65_536, 0.97, 120
#: Decimals to which scores are compared: those of parallel vectors may differ in their last bits.
DECIMALS = 12
#: Vectors of a leaf that meet its queries in one group, queries multiplied with them at a time, and queries in one group at most.
BLOCK, QUERY_BLOCK, QUERY_PART = 4_096, 256, 65_536


class Forest:
    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.depth, self.inner = depth, (1 << depth) - 1
        self.directions = rng.standard_normal((trees, self.inner, sample.shape[1]))
        self.cuts = np.zeros((trees, self.inner))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for n in range(self.inner):
                own = np.flatnonzero(node == n)
                along = sample[own] @ self.directions[t, n]
                self.cuts[t, n] = np.median(along) if len(own) else 0.0
                node[own] = 2 * n + 1 + (along > self.cuts[t, n])
        self.leaves = trees << depth
        self.take = self.leaves

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Number of the leaf of each vector in each tree, trees one after another."""
        out = np.zeros((len(unit), len(self.cuts)), np.int64)
        for t, (directions, cuts) in enumerate(zip(self.directions, self.cuts, strict=True)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", unit, directions[node]) > cuts[node])
            out[:, t] = node - self.inner + (t << self.depth)
        return out

    def search(self, unit: np.ndarray, take: int) -> list[int]:
        """The first ``take`` leaves that a query reaches, over all trees."""
        margins = [(d @ unit - c).tolist() for d, c in zip(self.directions, self.cuts, strict=True)]
        queue, out = [(0.0, t, 0) for t in range(len(margins))], []
        while queue and len(out) < take:
            cost, t, n = heapq.heappop(queue)
            while n < self.inner:
                m = margins[t][n]
                heapq.heappush(queue, (max(cost, abs(m)), t, 2 * n + (1 if m > 0 else 2)))
                n = 2 * n + (2 if m > 0 else 1)
            out.append(n - self.inner + (t << self.depth))
        return out

    def calibrate(self, sample: np.ndarray, k: int = K) -> None:
        """Fewest leaves that find ``TARGET`` of the sample's own neighbours, for some of its vectors."""
        probes = np.arange(0, len(sample), max(1, len(sample) // PROBES))
        near = sample[probes] @ sample.T
        near[np.arange(len(probes)), probes] = -9
        true = np.argsort(-near, axis=1)[:, :k]
        cells = self.cells(sample)
        first = np.full((len(probes), true.shape[1]), self.leaves)
        for i, p in enumerate(probes):
            rank = np.full(self.leaves, self.leaves)
            order = self.search(sample[p], self.leaves)
            rank[order] = np.arange(len(order))
            first[i] = rank[cells[true[i]]].min(axis=1)
        self.take = min(self.leaves, int(np.quantile(first, TARGET, method="higher")) + 1) if first.size else self.leaves


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=np.float64)
    # the largest component first, so that squares neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    df = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return df.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(2), "embedding")})


def _ranked(k: int):
    """The best candidates of each query (query, id, score) from a part of a leaf and the queries that reach it."""

    def run(key, leaf, queries):
        near, ids, asked = [], leaf.column("id").to_numpy(), queries.column("id").to_numpy()
        if len(ids) and len(asked):
            vectors, wanted = (unit(_matrix(t.column("embedding").combine_chunks())) for t in (leaf, queries))
            for a in range(0, len(asked), QUERY_BLOCK):
                scores = wanted[a : a + QUERY_BLOCK] @ vectors.T
                top = np.lexsort((np.broadcast_to(ids, scores.shape), -np.round(scores, DECIMALS)), axis=1)[:, : k + 1]
                near.append((np.repeat(asked[a : a + QUERY_BLOCK], top.shape[1]), ids[top].reshape(-1), np.take_along_axis(scores, top, axis=1).reshape(-1)))
        columns = [np.concatenate(c) for c in zip(*near, strict=True)] if near else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({n: pa.array(c) for n, c in zip(("query", "id", "score"), columns, strict=True)})

    return run


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of each length in a batch: the length, their places, and they themselves at length one."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, unit(_matrix(column.take(pa.array(rows))))


def _forests(entries: DataFrame, k: int) -> dict[int, tuple[int, Forest]]:
    """A fitted forest for each length of vectors, with the number of its first leaf. One row a length is read, and the samples."""
    out, first = {}, 0
    for n, count in sorted((r[0], r[1]) for r in entries.groupBy(F.size("embedding")).count().collect()):
        depth = int(np.clip(np.log2(max(1, count / LEAF)), 0, MAX_DEPTH))
        if depth:
            rows = entries.where(F.size("embedding") == n).orderBy("h1", "id").limit(min(MOST_SAMPLE, max(SAMPLE, 16 << depth))).select("embedding").collect()
            sample = unit(np.array([r.embedding for r in rows], dtype=np.float64))
            forest = Forest(sample, max(0, min(depth, int(np.log2(max(1, len(sample) / 8))))))
            forest.calibrate(sample, k)
        else:
            forest = Forest(np.zeros((0, n)), 0, 1)
        out[n] = first, forest
        first += forest.leaves
    return out


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    parts = parts_of(spark)
    usable = materialize(_usable(vectors), "vectors")
    # Of equal vectors the k + 1 smallest ids can be among a query's k nearest (one may be its own).
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    entries = (
        usable.withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("members"), F.min_by("embedding", "vec_id").alias("embedding"))
    )
    entries = materialize(entries, "entries")
    forests = _forests(entries, k)
    if not forests:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = entries.count()
    salts = max(1, -(-count // (BLOCK << max(f.depth for _, f in forests.values()))))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                for n, rows, units in _by_length(part.column("embedding")):
                    first, forest = forests[n]
                    cells, own = forest.cells(units) + first, part.take(pa.array(rows))
                    for t in range(cells.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(cells[:, t]), own.column("id"), own.column("embedding")], names=["cell", "id", "embedding"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rows, units in _by_length(batch.column("embedding")):
                first, forest = forests[n]
                for i, u in zip(rows.tolist(), units, strict=True):
                    cells = np.array(forest.search(u, forest.take), np.int64) + first
                    again = pa.array(np.full(len(cells), i))
                    yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column("id").take(again), batch.column("embedding").take(again)], names=["cell", "id", "embedding"])

    kind = dict(usable.dtypes)["embedding"]
    schema = f"cell long, id long, embedding {kind}"
    index = entries.select("id", "embedding").mapInArrow(file, schema).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    asked = usable.where(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2")
    wanted = entries.join(asked.select("h1", "h2").distinct(), ["h1", "h2"]).select("id", "embedding")
    wanted = materialize(wanted.repartition(parts), "queries")
    lots = max(1, -(-wanted.count() // QUERY_PART))
    # every lot of queries meets every part of a leaf
    every_one = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    queries = wanted.mapInArrow(seek, schema).withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")).select("*", every_one("salt", salts))
    index, group = index.select("*", every_one("lot", lots)), ["cell", "salt", "lot"]
    found = index.groupBy(*group).cogroup(queries.groupBy(*group)).applyInArrow(_ranked(k), "query long, id long, score double")
    best = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", DECIMALS)), "id"))).where(F.col("n") <= k + 1)
    near = best.join(entries.select("id", "members"), "id").select("query", "score", F.explode("members").alias("vec_id"))
    near = near.groupBy("query").agg(F.collect_list(F.struct((-F.round("score", DECIMALS)).alias("s"), "vec_id", "score")).alias("near"))
    # at most (k + 1) ** 2 candidates stand in a row; sorted once for all queries with this vector
    near = near.select(F.col("query").alias("id"), F.slice(F.array_sort("near"), 1, k + 1).alias("near"))
    by_id = entries.select("id", "h1", "h2").join(near, "id")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.withColumnRenamed("vec_id", "query_id").join(by_id.select("h1", "h2", "near"), ["h1", "h2"]).select("query_id", F.posexplode(own).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.greatest(F.least(F.col("x.score"), F.lit(1.0)), F.lit(-1.0)).alias("score"))
