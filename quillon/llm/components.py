"""Connected components by alternating large and small stars, and the grouping of sorted Arrow batches.

Nothing of the graph comes to the driver but a row count and a checksum a round. Hubs are harmless: minima are summed up before the
shuffle, and the joins have an exchange on either side, which Spark splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise


#: Edges of a task; up to SPLIT tasks the edges are dealt into as many parts as they need, beyond it Spark splits what is hot.
EDGES, SPLIT = 1 << 19, 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the (a, b) long pairs the least node of its component; loops are allowed."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        parts = 1 + state["n"] // EDGES

        def dealt(rows: DataFrame, parts: int = parts) -> DataFrame:
            return rows.repartition(parts, "a") if parts <= SPLIT else rows

        both = edges.where("a <> b")
        both = dealt(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = dealt(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        loops = edges.select(F.col("b").alias("a"), "b").where("a = b")
        edges = materialise(dealt(small.where("a <> b").unionByName(loops)).distinct(), "edges")
    rooted = edges.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return rooted.unionByName(tops).groupBy("node").agg(F.min("root").alias("root"))


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups of the first column, on which the batches are sorted; about ``rows`` rows each, or one group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        keys = t.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
            held, count = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1 with the least number as the root; ``root`` is always fully compressed after ``settle``."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        for x, y in zip(a.tolist(), b.tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x < y:
                root[y] = x
            elif y < x:
                root[x] = y
        self.settle()

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up
