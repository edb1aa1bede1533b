"""Exact nearest neighbours without scoring every pair: passages in blocks with a centre and a radius.

By Cauchy and Schwarz no passage of a block scores more against a query q than q.c + |q| r, with the block's centre c and radius r. So a query first meets the blocks whose centres score best, until these hold k
passages; the k-th score found is a floor, and of all other blocks only those whose bound reaches it are scored. Nothing is approximate: a block that is left out can't change a row of the result.

Queries and blocks meet in a shuffle on the block. A block has at most ``ROWS`` passages (a centre with more is parted by a hash, copies too) and is met by at most ``QUERIES`` queries in one task, so
no task grows with the data; the centres are at most ``CENTRES``, a bounded sample of the passages, which decides what is pruned and not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.retrieval import DIGITS, _best
from quillon.session import materialise

#: Centres at most, passages of a block at most (about), queries that meet a block in one task (about).
CENTRES, ROWS, QUERIES = 1024, 8192, 2048
#: Rows whose products with all centres are held at once, rows of a batch that a task gives.
STEP, GIVEN = 256, 4096
#: What rounding may add to a bound.
SLACK = 3e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Blocks:
    """``rows``: (block, pid, embedding), written; ``shapes``: (block, n, centre, radius), written, a row a block."""

    def __init__(self, passages: DataFrame, centres: int | None = None, most: int = ROWS):
        known = passages.where(F.col("embedding").isNotNull()).select("pid", "embedding")
        n = known.count()
        wanted = max(1, min(CENTRES, centres or round(n**0.5)))
        some = known.select(F.xxhash64("pid").alias("h"), "pid", "embedding").orderBy("h", "pid").limit(wanted)
        seeds = np.array([r["embedding"] for r in some.collect()], np.float64)  # CENTRES vectors
        shared = passages.sparkSession.sparkContext.broadcast(seeds)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, STEP):
                    b = batch.slice(a, STEP)
                    near = (_matrix(b.column(1)) @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column(0), b.column(1)], names=["centre", "pid", "embedding"])

        kind = f"pid {known.schema['pid'].dataType.simpleString()}, embedding {known.schema['embedding'].dataType.simpleString()}"
        placed = materialise(known.mapInArrow(assign, f"centre int, {kind}"), "centres")
        parts = placed.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(float(most))).cast("int").alias("parts"))  # a row a centre
        block = F.concat_ws("-", F.col("centre").cast("string"), F.pmod(F.xxhash64("pid"), F.col("parts")).cast("string"))
        self.rows = materialise(placed.join(F.broadcast(parts), "centre").select(block.alias("block"), "pid", "embedding"), "blocks")

        def shape(table: pa.Table) -> pa.Table:
            m = _matrix(table["embedding"])
            middle = m.mean(axis=0)
            radius = float(np.sqrt(((m - middle) ** 2).sum(axis=1)).max())
            return pa.table({"block": pa.array([table["block"][0].as_py()]), "n": pa.array([len(m)], pa.int64()), "middle": pa.array([middle.tolist()]), "radius": pa.array([radius])})

        shapes = self.rows.select("block", "embedding").groupBy("block").applyInArrow(shape, "block string, n long, middle array<double>, radius double")
        self.shapes = materialise(shapes, "block-shapes")
        self.n = n

    def collected(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(names, sizes, centres, radii): some ``CENTRES`` + n / ``ROWS`` rows."""
        rows = self.shapes.orderBy("block").collect()
        return [r["block"] for r in rows], np.array([r["n"] for r in rows], np.int64), np.array([r["middle"] for r in rows], np.float64), np.array([r["radius"] for r in rows])


def _scored(pairs: DataFrame, blocks: Blocks, k: int, exclude_same: bool, schema: str) -> DataFrame:
    """(qid, pid, score): the best k of each block for each query of ``pairs`` (block, qid, embedding)."""
    counts = pairs.groupBy("block").agg(F.ceil(F.count("*") / F.lit(float(QUERIES))).cast("int").alias("salts"))  # a row a block
    asked = pairs.join(F.broadcast(counts), "block").select("block", F.pmod(F.xxhash64("qid"), F.col("salts")).cast("int").alias("salt"), "qid", "embedding")
    held = blocks.rows.join(F.broadcast(counts), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pid", "embedding")

    def score(queries: pa.Table, passages: pa.Table) -> pa.Table:
        empty = pa.table({"qid": queries["qid"].slice(0, 0), "pid": passages["pid"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not passages.num_rows:
            return empty
        vectors, ids, out = _matrix(passages["embedding"]), np.array(passages["pid"].to_pylist()), []
        asks = queries["qid"].to_pylist()
        for a in range(0, queries.num_rows, 256):
            scores = np.round(_matrix(queries["embedding"].slice(a, 256)) @ vectors.T, DIGITS)
            if exclude_same:
                scores[np.array(asks[a : a + 256])[:, None] == ids[None, :]] = -np.inf
            n = min(k, len(ids))
            least = np.partition(scores, -n, axis=1)[:, -n]
            r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            keep = _best(r, scores[r, c], ids[c], k)
            out.append(pa.table({"qid": pa.array([asks[a + i] for i in r[keep]], queries["qid"].type), "pid": pa.array(ids[c[keep]].tolist(), passages["pid"].type), "score": pa.array(scores[r, c][keep])}))
        return pa.concat_tables(out)

    return asked.groupBy("block", "salt").cogroup(held.groupBy("block", "salt")).applyInArrow(score, schema)


def nearest_pruned(queries: DataFrame, blocks: Blocks, k: int = 20, exclude_same: bool = False) -> tuple[DataFrame, DataFrame]:
    """((qid, pid, rank, score), (qid, n_blocks, n_scored)): the rows of ``retrieval.nearest``, and how many blocks there are and were scored for each query.

    Rows without a vector take no part; a query with a vector has k rows, or as many as there are passages."""
    spark = queries.sparkSession
    names, sizes, middles, radii = blocks.collected()
    known = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding")
    qid, vector = (known.schema[c].dataType.simpleString() for c in ("qid", "embedding"))
    schema = f"qid {qid}, pid {blocks.rows.schema['pid'].dataType.simpleString()}, score double"
    if not names:
        return spark.createDataFrame([], schema.replace(", score", ", rank long, score")), known.select("qid", F.lit(0).alias("n_blocks"), F.lit(0).alias("n_scored"))
    shared = spark.sparkContext.broadcast((np.array(names), sizes, middles, radii, np.sqrt((middles**2).sum(axis=1))))
    need = k + int(exclude_same)

    def blocks_of(floor: bool):
        """A row for each block that a query meets: at first those with the best centres until they hold enough passages, and, with a floor, the others whose bound reaches it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names_, sizes_, c, r, norms = shared.value
            for b in batches:
                for a in range(0, b.num_rows, STEP):
                    part = b.slice(a, STEP)
                    q = _matrix(part.column(1))
                    middle = q @ c.T
                    order = np.argsort(-middle, axis=1, kind="stable")
                    held = np.cumsum(sizes_[order], axis=1)
                    first = np.zeros(middle.shape, bool)
                    np.put_along_axis(first, order, held - sizes_[order] < need, axis=1)
                    if floor:
                        length = np.sqrt((q * q).sum(axis=1))[:, None]
                        bound = middle + length * r + SLACK * (1 + length * (norms + r))
                        first = ~first & (bound >= np.array(part.column(2).to_pylist(), float)[:, None])
                    i, j = np.nonzero(first)
                    for x in range(0, len(i), GIVEN):  # a query may meet every block
                        at = pa.array(i[x : x + GIVEN])
                        yield pa.RecordBatch.from_arrays([pa.array(names_[j[x : x + GIVEN]].tolist(), pa.string()), part.column(0).take(at), part.column(1).take(at)], names=["block", "qid", "embedding"])

        return run

    pair = f"block string, qid {qid}, embedding {vector}"
    first = materialise(known.mapInArrow(blocks_of(False), pair), "first-blocks")
    begun = materialise(_scored(first, blocks, k, exclude_same, schema), "first-scores")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pid"))
    floors = begun.withColumn("nth", nth).where(F.col("nth") == k).select("qid", F.col("score").alias("floor"))
    asked = known.join(floors, "qid", "left").select("qid", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    more = materialise(asked.mapInArrow(blocks_of(True), pair), "more-blocks")
    every = begun.unionByName(_scored(more, blocks, k, exclude_same, schema))
    out = every.withColumn("rank", nth.cast("long")).where(F.col("rank") <= k).select("qid", "pid", "rank", "score")
    counts = first.select("qid").unionByName(more.select("qid")).groupBy("qid").agg(F.count("*").cast("int").alias("n_scored"))
    return out, counts.select("qid", F.lit(len(names)).alias("n_blocks"), "n_scored")
