"""Connected components of a distributed edge list.

Each task contracts about ``TASK_EDGES`` edges with a union-find. Where there are several
tasks, stars are then enlarged and shrunk in turn until nothing changes: every node is
tied to the smallest node it knows.
Minima are aggregated before the shuffle and joined back, so a node with very many
neighbours is split over tasks. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize


TASK_EDGES = 500_000


class UnionFind:
    """Over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars: each node with the smallest node it is tied to."""
    held = [[x.to_numpy() for x in batch.columns] for batch in batches if batch.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = UnionFind(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.union(x, y)
        roots = np.fromiter((forest.find(i) for i in range(len(nodes))), dtype=np.int64, count=len(nodes))
        far = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[roots[far]])], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges (two long columns) with the smallest node of its component.

    Rounds grow with the logarithm of the longest path; one that isn't settled after ``most_rounds`` fails.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    tasks = -(-e.count() // TASK_EDGES)
    e = materialize(e.repartition(max(1, tasks)).mapInArrow(_contract, "u long, v long"), "edges")
    before = None
    for _ in range(most_rounds if tasks > 1 else 0):
        # u > v holds for every edge. Large star: greater neighbours are tied to the least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.groupBy("u").agg(F.min("v").alias("v"))).where("u != v").distinct()
        large = materialize(large, "edges")
        # Small star: lesser neighbours, and the node itself, are tied to the least neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        if tasks > 1:
            raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
