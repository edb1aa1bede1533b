"""N-gram Jaccard self-join with a MinHash LSH forest.

Documents are sets of 5-token shingles. Documents with the same set are one node, kept with the number of its copies, so no
group of copies is ever expanded. Each node has TREES x DEPTH MinHash values; a tree of the forest is the trie of the nodes'
DEPTH values, with its leaves in sorted order. Nodes match that share a prefix in some tree: at first all DEPTH values, and then, by the similarities of the links
found so far, as few as bring the measured recall to the target. Nodes whose signatures agree often enough (RELAX standard deviations below
the least similarity) are linked. A bucket, which is a subtree, gives at most one row a node and level, and only subtrees with
nodes that are not yet connected are looked at again.

The components of these links hold every true link; within each component all nodes are compared exactly, by how their shingles differ from those of the
component's root, which gives the links and, as their components, the classes. A bucket or component beyond what a task may hold is dealt out as pairs of chunks, and
nothing is dropped.

Cases: a null or empty text, or one without letters and digits, has no shingle, no link and a class of its own; a text of
one to four tokens has one shingle, all its tokens; a text of any length is read whole; rows given twice are copies of each other, and links; a null doc_id is
a document like others and, as a class id, null; of rows that tie for a class's least doc_id ``keep_one`` keeps the one with the least hash of its text; an
empty table gives an empty table; other columns, whatever their names, are passed through by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import NO_ID, ROW, packed, token_hashes, unpacked, with_row_key
from quillon.llm.components import Forest, components, whole_groups
from quillon.llm.decontamination import mixed, shingle_hashes
from quillon.session import materialise, table

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.9999
#: Standard deviations of the signature estimate below the least similarity.
RELAX = 4.5
#: What a task holds at most of one group: nodes of a bucket; nodes and values of the differences in a component. Nodes that share one copy of the root's text.
BUCKET_CHUNK, CHUNK, CHUNK_VALUES, SALT = 8192, 8192, 1 << 22, 1024
HASHES = TREES * DEPTH


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix under which a pair of the least similarity meets in some tree with the chance ``recall``."""
    for d in range(depth, 0, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def shingle_set(tokens: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a document's token hashes."""
    return np.unique(shingle_hashes(tokens, min(SHINGLE, len(tokens)))) if len(tokens) else np.zeros(0, np.uint64)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    k = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    k = (k >> np.uint64(32)).astype(np.uint32)
    return (k[:HASHES] | np.uint32(1))[:, None], k[HASHES:][:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    a, b = _multipliers()
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, x.shape[1], 4096):
        least = np.minimum(least, (x[:, i : i + 4096] * a + b).min(axis=1))
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def _token_lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    end = 0
    for n in column.value_lengths().to_numpy(zero_copy_only=False).tolist():
        yield flat[end : end + n]
        end += n


def signed(docs: DataFrame) -> DataFrame:
    """(__q_id, __q_row, node, check, n_shingles, sig): nodes are equal where the shingle sets are; without shingles, where the rows are."""
    schema = "__q_id long, __q_row long, node long, check long, n_shingles int, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, check, count, sig = [], [], [], []
            for tokens, row in zip(_token_lists(b.column(2)), b.column(1).to_pylist()):
                s = shingle_set(tokens)
                count.append(len(s))
                if len(s):
                    node.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                    check.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(signature(s).tobytes())
                else:
                    node.append(row)
                    check.append(0)
                    sig.append(b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(count, pa.int32()), pa.array(sig, pa.binary())], schema.replace(",", "").split()[::2])

    bare = with_row_key(docs.select("doc_id", "text")).select(*ROW, token_hashes(F.col("text")).alias("t"))
    return materialise(bare.mapInArrow(run, schema), "signatures")


def _dealt(rows: DataFrame, group: str, chunks: str) -> DataFrame:
    """``rows`` with __g: a group of one chunk is one, a larger one each pair of its chunks; side tells the chunks apart."""
    n = F.col(chunks).cast("int")
    mine = F.pmod(F.xxhash64("node"), n).cast("int")
    out = rows.withColumn("__n", n).withColumn("__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    low, high = F.least("__mine", "__other"), F.greatest("__mine", "__other")
    out = out.withColumn("__g", F.xxhash64(group, low, high)).withColumn("side", (F.col("__mine") > F.col("__other")).cast("int")).withColumn("same", F.col("__mine") == F.col("__other"))
    return out.drop("__n", "__mine", "__other", chunks, group)


# -- the forest ----------------------------------------------------------------------------------------------------------
def leaves(nodes: DataFrame, floor: int) -> DataFrame:
    """(bucket, key, node): a leaf of each tree for each node that shares the first ``floor`` values with another one there. key has all the tree's values, and
    bucket stands for the tree and the first ``floor`` of them, which no shorter prefix is ever asked for."""
    tree = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("key")))
    rows = nodes.select("node", F.explode(tree).alias("leaf"))
    rows = rows.select(F.xxhash64("leaf.tree", F.substring("leaf.key", 1, 2 * floor)).alias("bucket"), "leaf.key", "node")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return materialise(rows.join(shared.hint("merge"), "bucket", "left_semi"), "leaves")


def _like(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sig[a] == sig[b]).mean(axis=1)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


#: A link between two components, with the agreement of the signatures that made it.
LINK = "a long, b long, s double"


def _to_first(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (root, sig, first_root, first_sig)."""
    for b in batches:
        t = pa.Table.from_batches([b])
        sig = np.concatenate([_signatures(t.column(1)), _signatures(t.column(3))])
        s = _like(sig, np.arange(len(t)), np.arange(len(t)) + len(t))
        k = np.flatnonzero(s >= least)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), b.column(2).take(pa.array(k)), pa.array(s[k])], names=["a", "b", "s"])


def _within(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links between different components in a bucket, of rows (__g, key, root, sig) sorted by __g and key. Neighbours in the trie come first; what
    is linked is compared no more."""
    for t in whole_groups(batches):
        g, root = (t.column(k).to_numpy() for k in (0, 2))
        sig, n = _signatures(t.column(3)), len(t)
        forest, ends = Forest(n), np.searchsorted(g, g, side="right")
        order = np.lexsort((root, g))
        same = (root[order[1:]] == root[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        forest.union(order[:-1][same], order[1:][same])
        found: list[tuple] = []
        at, lag = np.arange(n), 1
        while len(at := at[at + lag < ends[at]]):
            apart = at[forest.root[at] != forest.root[at + lag]]
            for i in range(0, len(apart), 8192):
                x = apart[i : i + 8192]
                s = _like(sig, x, x + lag)
                like = s >= least
                found.append((root[x[like]], root[x[like] + lag], s[like]))
                forest.union(x[like], x[like] + lag)
            lag += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)) for k, kind in enumerate((np.int64, np.int64, float))], names=["a", "b", "s"])


def estimated_recall(links: DataFrame, similarity: float, depth: int, least: int = 1) -> dict[int, float]:
    """For prefixes of ``depth`` values and of fewer, down to ``least``: the share of all links that they find, in the band of similarities where that is least.

    Prefixes of d values find a link of similarity s with the chance p(d) = 1 - (1 - s^d)^TREES; so the links found at ``depth`` stand for the sum of 1 / p(depth)
    of all, and prefixes of d values are to find the sum of p(d) / p(depth) of these. A band without any link counts as empty: at DEPTH values a link of the least similarity
    is found with a chance of 0.97, so that is wrong for one in 40 bands with a single link. 1 without any link at all."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(similarity), F.col("s")))
    depths = range(least, depth + 1)
    chance = {d: 1 - F.pow(1 - F.pow(s, F.lit(d)), F.lit(TREES)) for d in depths}
    bands = links.groupBy(F.floor((s - similarity) * 20).alias("band")).agg(*((F.sum(chance[d] / chance[depth]) / F.sum(1 / chance[depth])).alias(f"d{d}") for d in depths))
    row = bands.agg(*(F.coalesce(F.min(f"d{d}"), F.lit(1.0)).alias(f"d{d}") for d in depths)).first()
    return {d: row[f"d{d}"] for d in depths}


def candidate_links(nodes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(node, root): the components of nodes with a like signature that share a prefix in some tree.

    The prefixes begin at DEPTH values. As long as the recall measured on the links found misses the target, they are shortened to the length at which these links say
    that it is reached, and measured again; at ``prefix_length`` it is reached for the least similarity, so they never get shorter. Each level looks only at
    buckets with nodes of different components: each node meets the first of its largest bucket, which a large group of near copies needs no more than.
    At the last level, whose buckets hold those of all others, what is still apart is compared pair by pair."""
    least = similarity - RELAX * math.sqrt(similarity * (1 - similarity) / HASHES)
    some = nodes.where("n_shingles > 0").select("node", "sig")
    floor = prefix_length(similarity, recall=recall)
    apart = leaves(some, floor).withColumn("root", F.col("node"))  # the leaves of subtrees with more than one component; all joins with it are merges at any size
    some = materialise(some.join(apart.select("node").distinct().hint("merge"), "node", "left_semi"), "meeting")
    links = some.sparkSession.createDataFrame([], LINK)

    def level(depth: int) -> tuple[DataFrame, DataFrame]:
        """The leaves with their bucket of this depth, and the buckets with more than one component."""
        rows = apart.withColumn("bucket", F.xxhash64("bucket", F.substring("key", 1, 2 * depth)))
        groups = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("key", "node", "root")).alias("first"))
        return rows, materialise(groups.where("low <> high").select("bucket", "n", F.col("first.node").alias("first"), F.col("first.root").alias("first_root")), "buckets")

    def add(found: DataFrame) -> bool:
        """Join the components that new links connect, and leave the subtrees with a single one; whether there are any links."""
        nonlocal links, apart
        found = materialise(found, "near")
        if found.isEmpty():
            return False
        links = links.unionByName(found)
        tops = materialise(components(found.select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("top")), "roots-above")  # so that Spark can split a hot root's join
        moved = apart.join(tops.hint("merge"), "root", "left").select("bucket", "key", "node", F.coalesce("top", "root").alias("root"))
        several = moved.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        apart = materialise(moved.join(several.hint("merge"), "bucket", "left_semi"), "apart")
        return True

    depth = DEPTH
    while True:
        rows, buckets = level(depth)
        if not buckets.isEmpty():
            stars = rows.join(buckets.hint("merge"), "bucket").where("root <> first_root").groupBy("node").agg(F.max_by(F.struct("root", "first", "first_root"), F.struct("n", "first")).alias("x")).select("node", "x.*")
            sigs = stars.join(some.hint("merge"), "node").select("root", "sig", "first", "first_root").join(some.select(F.col("node").alias("first"), F.col("sig").alias("first_sig")).hint("merge"), "first")
            add(sigs.select("root", "sig", "first_root", "first_sig").mapInArrow(lambda x: _to_first(x, least), LINK))
        found = estimated_recall(links, similarity, depth, floor)
        if depth == floor or (found[depth] >= recall and not links.isEmpty()):
            break
        depth = floor if links.isEmpty() else max([d for d in range(floor, depth) if found[d] >= recall], default=floor)
    rows, buckets = level(depth)
    if not buckets.isEmpty():
        chunked = buckets.select("bucket", F.ceil(F.col("n") / BUCKET_CHUNK).alias("chunks"))
        members = _dealt(rows.join(chunked.hint("merge"), "bucket").join(some.hint("merge"), "node"), "bucket", "chunks")
        members = members.select("__g", "key", "root", "sig").repartition("__g").sortWithinPartitions("__g", "key")
        links = links.unionByName(materialise(members.mapInArrow(lambda x: _within(x, least), LINK), "near"))
    return components(links.select("a", "b"))  # a component goes by one of its nodes, so the links have all nodes that any has


# -- exact links ---------------------------------------------------------------------------------------------------------
DIFFERENCE = "root long, node long, copies long, size int, base_size int, diff array<bigint>"
_MORE = np.uint64(0xA0761D6478BD642F)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (root, salt, member, node, copies, tokens) in this order, the root's own first: how a node's shingles differ from the root's, as the values of
    the root that it lacks and, marked, those that it adds."""
    last, base = None, np.zeros(0, np.uint64)
    for b in batches:
        root, salt, member, node, copies = (b.column(k).to_pylist() for k in range(5))
        out: list[tuple] = []
        for k, tokens in enumerate(_token_lists(b.column(5))):
            if last == (root[k], salt[k], node[k]):
                continue  # a row given twice is one node
            last, s = (root[k], salt[k], node[k]), shingle_set(tokens)
            if not member[k]:
                base = s
                if salt[k]:
                    continue
            diff = np.concatenate([np.setdiff1d(base, s, True), np.setdiff1d(s, base, True) ^ _MORE])
            out.append((root[k], node[k], copies[k], len(s), len(base), diff.view(np.int64)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in DIFFERENCE.split(", ")])


def _pairs(diffs: list[np.ndarray], size: np.ndarray, base: int, side: np.ndarray, same: bool, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the later ones that are similar to it; of a pair of chunks only sets of different chunks are compared.

    Two sets share what neither lacks of the root's, and what both add: common = base - lacked by a - lacked by b + equal differences. Equal differences are counted
    through an inverted index, which has a list for each value that two sets have."""
    n = len(diffs)
    values, inverse, counts = np.unique(np.concatenate(diffs), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(d) for d in diffs])
    often = counts[inverse] > 1
    inverse, owner = inverse[often], owner[often]
    by_value = np.argsort(inverse, kind="stable")
    holders, begin = owner[by_value], np.searchsorted(inverse[by_value], np.arange(len(values) + 1))
    mine = np.searchsorted(owner, np.arange(n + 1))
    # size = base - lacked + added, and lacked + added = the number of differences
    lacked = (base - size + np.array([len(d) for d in diffs])) // 2
    for i in range(n - 1):
        lists = [holders[begin[v] : begin[v + 1]] for v in inverse[mine[i] : mine[i + 1]].tolist()]
        equal = np.bincount(np.concatenate(lists), minlength=n)[i + 1 :] if lists else 0
        both = base - lacked[i] - lacked[i + 1 :] + equal
        like = both >= similarity * (size[i] + size[i + 1 :] - both) - 1e-9
        if not same:
            like &= side[i + 1 :] != side[i]
        yield i, i + 1 + np.flatnonzero(like)


def _counted(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(node, root, links) of rows (__g, node, copies, size, base_size, side, same, diff) sorted by __g."""
    for t in whole_groups(batches, 512):
        g, node, copies, size, base, side = (t.column(k).to_numpy() for k in range(6))
        same, diffs = t.column(6).to_pylist(), [d for c in t.column(7).chunks for d in _token_lists(c)]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(g)]):
            forest, links = Forest(b - a), np.zeros(b - a, np.int64)
            for i, others in _pairs(diffs[a:b], size[a:b].astype(np.int64), int(base[a]), side[a:b], same[a], similarity):
                links[i] += copies[a:b][others].sum()
                links[others] += copies[a + i]
                apart = others[forest.root[others] != forest.root[i]]
                if len(apart):
                    forest.union(np.full(len(apart), i), apart)
            own = np.flatnonzero(links)
            for x, values in zip(out, (node[a:b][own], node[a:b][forest.root[own]], links[own])):
                x.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names=["node", "root", "links"])


def exact_links(docs: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(node, root, links): of each task's nodes the local root and the number of documents linked there.

    Every text of a component is sent once, to one of the places to which the root's text goes, and leaves its difference from that; only the differences
    of a component meet each other, so a large group of near copies, which differ little, is small."""
    roots = materialise(roots, "roots")
    sizes = materialise(roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / SALT).cast("int").alias("salts")), "sizes")
    some = roots.join(sizes, "root").join(nodes.select("node", "copies", *ROW), "node")
    some = materialise(some, "candidates")  # as many as the corpus has near copies: no bound, so no broadcast at any size
    texts = with_row_key(docs.select("doc_id", "text"))
    rows = texts.join(some.hint("merge"), ROW).withColumn("member", F.col("node") != F.col("root"))
    places = F.when(F.col("member"), F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = rows.select("root", F.explode(places).alias("salt"), "member", "node", "copies", token_hashes(F.col("text")).alias("t"))
    order = ("root", "salt", "member", "node")
    diffs = materialise(rows.repartition("root", "salt").sortWithinPartitions(*order).select(*order, "copies", "t").mapInArrow(_differences, DIFFERENCE), "differences")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.size("diff")) / CHUNK_VALUES))
    dealt = _dealt(diffs.join(diffs.groupBy("root").agg(chunks.cast("int").alias("chunks")), "root"), "root", "chunks")
    dealt = dealt.select("__g", "node", "copies", "size", "base_size", "side", "same", "diff").repartition("__g").sortWithinPartitions("__g")
    return dealt.mapInArrow(lambda x: _counted(x, similarity), "node long, root long, links long")


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(__q_id, __q_row, class_id, class_row, n_links, class_size) for each row: the least row of its class, and the number of other
    rows with a similarity of at least ``similarity``, copies counted."""
    rows = signed(docs)
    nodes = rows.groupBy("node", "check").agg(F.min(F.struct(*ROW)).alias("top"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    nodes = materialise(nodes.select("node", "top.*", "copies", "sig", "n_shingles"), "nodes")
    found = materialise(exact_links(docs, nodes, candidate_links(nodes, similarity, recall), similarity), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    full = nodes.select("node", *ROW, "copies", "n_shingles").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = materialise(full, "classes")
    tops = materialise(full.groupBy("root").agg(F.min(F.struct(*ROW)).alias("top"), F.sum("copies").alias("class_size")), "tops")  # so that Spark can split a hot root's join
    by_node = full.join(tops, "root").select(
        "node",
        F.col("top.__q_id").alias("class_id"),
        F.col("top.__q_row").alias("class_row"),
        F.when(F.col("n_shingles") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        "class_size",
    )
    return rows.select(*ROW, "node").join(by_node, "node").drop("node")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """Of each class the row with the least doc_id, with all its columns as it is; of equal rows one."""
    tops = classes(docs, **parameters).select(F.col("class_id").alias("__q_id"), F.col("class_row").alias("__q_row")).distinct()
    return unpacked(packed(docs).join(tops, ROW, "left_semi").dropDuplicates(ROW))


def op8_ngram_join(spark, sf_dir):
    """doc_id, class_id, n_links and class_size for each document."""
    found = classes(table(spark, sf_dir, "documents"))
    ids = [F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("__q_id", "doc_id"), ("class_id", "class_id"))]
    return found.select(*ids, "n_links", "class_size")
