"""Benchmark decontamination by SimHash windows.

For each benchmark item of n tokens the operator looks for windows of n tokens of a document whose weighted 5-token shingles
have a Jaccard similarity of 0.8 or more with the item's (weights: how often a shingle occurs). Item and window have a
64-bit SimHash of their shingles; the fingerprints within ``RADIUS`` bits are found by multi-index hashing: of four
16-bit blocks one at least differs in at most RADIUS // 4 bits, so a table for each block from the 65,536 values to the items within
that many bits names every fingerprint in the radius, and none is lost. The candidates within the radius are then
verified by the exact similarity.

A window can only be similar to an item with which it shares a shingle. The windows that share none with any item are left
out before their fingerprint is made; this loses nothing, and of ordinary text it leaves next to nothing.

The benchmark is a stated query set, taken against the documents in blocks of ``BLOCK_ITEMS`` items of at most ``BLOCK_TOKENS``
tokens together, at most 34 MB of tables and 2 MB of shingles; what shares no shingle with a group of 4 million of them (16 MB) is not read again. Documents are never shuffled for the search.

Cases: an item or document that is null or has no token matches nothing; an item of fewer than five tokens has one shingle, its
whole token list; of a document shorter than an item the whole is the one window; a document of any length is searched whole; items given twice are both reported; rows of
documents given twice are reported once each pair; null ids are reported as null; similarities are rounded to six digits, and of equal ones there is nothing to choose; an
empty table gives no pair; other columns, whatever their names, are passed through by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import ROW, packed, token_hashes, unpacked, with_row_key
from quillon.session import discard, materialise, table

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCK_ITEMS, BLOCK_TOKENS, GROUP_SHINGLES = 1024, 262_144, 1 << 22
BLOCKS, BLOCK_BITS = 4, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` tokens, from the tokens' hashes."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _ODD + tokens[k : k + n]
    return mixed(out)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of shingles: a bit is set where more than half of them have it."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=-1)
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > shingles.shape[1], axis=-1).view(np.uint64).ravel()


def near_values(bits: int) -> np.ndarray:
    """All 16-bit numbers with at most ``bits`` bits set."""
    every = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


class ItemIndex:
    """A block of items with the multi-index tables of their fingerprints: 32 KB an item, whatever the lengths."""

    def __init__(self, ids: list, tokens: list[np.ndarray], radius: int = RADIUS):
        self.radius, self.ids, self.lengths = radius, ids, {}
        near = near_values(radius // BLOCKS)
        self.tables = np.zeros((BLOCKS, 1 << BLOCK_BITS, -(-len(ids) // 8)), np.uint8)
        self.prints = np.zeros(len(ids), np.uint64)
        self.shingles: list[np.ndarray] = []
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            by_length.setdefault(len(t), []).append(i)
            self.shingles.append(np.sort(shingle_hashes(t, min(SHINGLE, len(t)))))
            self.prints[i] = simhash(self.shingles[i][None, :])[0]
            for b, value in enumerate(self.prints[i : i + 1].view(np.uint16)):
                self.tables[b, near ^ value, i >> 3] |= np.uint8(128 >> (i & 7))
        for n, rows in sorted(by_length.items()):
            mask = np.zeros(self.tables.shape[2], np.uint8)
            for i in rows:
                mask[i >> 3] |= np.uint8(128 >> (i & 7))
            self.lengths[n] = (min(SHINGLE, n), mask, np.unique(np.concatenate([self.shingles[i] for i in rows])))
        self.known = {size: np.unique(np.concatenate([x[2] for x in self.lengths.values() if x[0] == size])) for size in {x[0] for x in self.lengths.values()}}

    def search(self, tokens: np.ndarray) -> Iterator[tuple[object, float, int]]:
        """(item id, similarity, start in tokens) of every window of a document's tokens that is similar to an item."""
        for size, known in self.known.items():
            shingles = shingle_hashes(tokens, size)
            if not len(shingles):
                continue
            at = np.searchsorted(known, shingles)
            hit = known[np.minimum(at, len(known) - 1)] == shingles
            if not hit.any():
                continue
            for n, (k, mask, own) in self.lengths.items():
                width = min(n - size + 1, len(shingles))  # of a shorter document the whole is the window
                if k != size or width < SIMILARITY * (n - size + 1):
                    continue
                shared = hit & np.isin(shingles, own) if len(own) < len(known) else hit
                running = np.concatenate([[0], np.cumsum(shared)])
                starts = np.flatnonzero(running[width:] > running[:-width])
                if len(starts):
                    yield from self._windows(shingles, starts, width, mask)

    def _windows(self, shingles, starts, width, mask):
        step = max(1, min(4096, (1 << 18) // width))  # bounds the bits unpacked at once, also for very long items
        for a in range(0, len(starts), step):
            some = starts[a : a + step]
            windows = np.lib.stride_tricks.sliding_window_view(shingles, width)[some]
            found = simhash(windows)
            block = found.view(np.uint16).reshape(-1, BLOCKS)
            near = self.tables[0][block[:, 0]]
            for b in range(1, BLOCKS):
                near |= self.tables[b][block[:, b]]
            row, item = np.nonzero(np.unpackbits(near & mask, axis=1)[:, : len(self.ids)])
            close = np.bitwise_count(found[row] ^ self.prints[item]) <= self.radius
            for r, i in zip(row[close], item[close]):
                s = weighted_jaccard(np.sort(windows[r]), self.shingles[i])
                if s >= SIMILARITY:
                    yield self.ids[i], s, int(some[r])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over the sum of the larger counts; ``a`` and ``b`` are sorted."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    i = np.searchsorted(y, x)
    same = (i < len(y)) & (y[np.minimum(i, len(y) - 1)] == x)
    both = int(np.minimum(n[same], m[i[same]]).sum())
    return both / (len(a) + len(b) - both)


def item_blocks(items: DataFrame) -> Iterator[list]:
    """The items with tokens, in blocks of bounded size; the driver holds one block at a time."""
    rows = items.select("item_id", token_hashes(F.col("text")).alias("t")).where(F.size("t") > 0)
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r["t"]) > BLOCK_TOKENS):
            yield block
            block, size = [], 0
        block.append((r["item_id"], np.array(r["t"], np.int64).view(np.uint64)))
        size += len(r["t"])
    if block:
        yield block


def _short(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def item_groups(items: DataFrame) -> Iterator[tuple[dict[int, np.ndarray], list[list]]]:
    """(for each size of shingles the sorted 32-bit hashes of the items' shingles, the blocks of the items), of ``GROUP_SHINGLES`` shingles at most or one block."""
    held, found, count = [], {}, 0
    for block in item_blocks(items):
        n = sum(len(t) for _, t in block)
        if held and count + n > GROUP_SHINGLES:
            yield {size: np.unique(np.concatenate(x)) for size, x in found.items()}, held
            held, found, count = [], {}, 0
        held.append(block)
        count += n
        for _, t in block:
            size = min(SHINGLE, len(t))
            found.setdefault(size, []).append(_short(shingle_hashes(t, size)))
    if held:
        yield {size: np.unique(np.concatenate(x)) for size, x in found.items()}, held


def _token_rows(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    lists = b.column(3)
    flat, end = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), 0
    for n in lists.value_lengths().to_numpy(zero_copy_only=False).tolist():
        yield flat[end : end + n]
        end += n


def leaks(docs: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(__q_id, __q_row, doc_id, item_id, similarity, n_windows): the best similarity and the number of similar windows of each pair.

    For a group of items one pass over all documents keeps those that share a shingle with any of them, by 32 bits of its hash; only these are read again, once
    for each block of the group. The driver holds one group, the executors one block or the hashes of one group."""
    spark = docs.sparkSession
    schema = "__q_id long, __q_row long, doc_id long, item_id long, similarity double, n_windows long"
    bare = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    bare = bare.select(*ROW, "doc_id", token_hashes(F.col("text")).alias("t"))
    parts = [spark.createDataFrame([], schema)]
    for wanted, blocks in item_groups(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        known = spark.sparkContext.broadcast(wanted)

        def sift(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.zeros(b.num_rows, bool)
                for i, tokens in enumerate(_token_rows(b)):
                    for size, hashes in known.value.items():
                        mine = _short(shingle_hashes(tokens, size))
                        keep[i] |= (hashes[np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)] == mine).any()
                yield b.filter(pa.array(keep))

        sifted = materialise(bare.mapInArrow(sift, bare.schema), "sharing")
        known.unpersist()
        for block in blocks:
            shared = spark.sparkContext.broadcast(ItemIndex([i for i, _ in block], [t for _, t in block], radius))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    rows, found = [], []
                    for i, tokens in enumerate(_token_rows(b)):
                        best: dict = {}
                        for item, s, _ in shared.value.search(tokens):
                            old = best.get(item, (0.0, 0))
                            best[item] = max(old[0], s), old[1] + 1
                        rows += [i] * len(best)
                        found += [(item, round(s, 6), n) for item, (s, n) in best.items()]
                    kept = [b.column(c).take(pa.array(rows, pa.int64())) for c in range(3)]
                    more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*kept, *more], names=[x.split()[0] for x in schema.split(", ")])

            parts.append(materialise(sifted.mapInArrow(run, schema), "leaks"))
            shared.unpersist()
        discard(sifted)
    return reduce(DataFrame.unionByName, parts).distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a similar window, with all their columns as they are."""
    found = leaks(docs, items).select(*ROW).distinct()
    return unpacked(packed(docs).join(found, ROW, "left_anti"))


def op2_decontamination(spark, sf_dir):
    """doc_id, item_id, similarity and n_windows of each document that holds an item of the benchmark."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "n_windows")
