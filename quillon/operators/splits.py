"""Seeded splits, quotas, samples, overlap checks and the hash that locks a test set."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.order_statistics import first_ranks, with_rank
from quillon.functions.text import json_string, seeded
from quillon.operators.corpus import last_wins
from quillon.session import exists
from quillon.sources.files import read_manifest, write_manifest

SPLITS, HELD_OUT = ("train", "dev", "test"), ("mirage",)
CONDITIONS = {"bioasq": ["none", "strong", "oracle"], "pubmedqa": ["none", "strong", "oracle"], "mirage": ["none", "strong"]}


def conditions(dataset: str) -> list[str]:
    """The retrieval conditions that a dataset supports."""
    if dataset not in CONDITIONS:
        raise ValueError(f"unknown dataset {dataset!r}")
    return CONDITIONS[dataset]


def with_conditions(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Each row once for every retrieval condition that its dataset supports, as ``condition``; a dataset that is unknown, or null, is an error."""
    known = F.create_map(*(x for name, some in CONDITIONS.items() for x in (F.lit(name), F.array(*map(F.lit, some)))))
    unknown = F.raise_error(F.concat(F.lit("unknown dataset "), F.coalesce(dataset, F.lit("null")))).cast("array<string>")
    return rows.select("*", F.explode(F.coalesce(F.try_element_at(known, F.col(dataset)), unknown)).alias("condition"))


def least(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Exactly n rows (or all) without replacement: those with the least seeded hash; a distributed top-n."""
    return rows.orderBy(seeded(seed, F.col(key)), key).limit(n)


def permutation_split(rows: DataFrame, key: str, seed: int, sizes: dict[str, int], rest: str) -> DataFrame:
    """``rows`` with ``split``: the first rows of the seeded order by the given sizes, and the rest.

    The sizes are small against the table, so only sum(sizes) rows are sorted and joined back."""
    total = sum(sizes.values())
    top = least(rows.select(key), key, seed, total)
    top = top.withColumn("__rank", F.row_number().over(Window.orderBy(seeded(seed, F.col(key)), key)))
    label, start = F.lit(rest), 0
    for name, n in sizes.items():
        label = F.when((F.col("__rank") > start) & (F.col("__rank") <= start + n), name).otherwise(label)
        start += n
    return rows.join(top.select(key, label.alias("split")), key, "left").withColumn("split", F.coalesce("split", F.lit(rest)))


def stratified_split(rows: DataFrame, key: str, stratum: str, first: str, seed: int, test: int, dev: int) -> DataFrame:
    """Two strata: the first gets int(size * its share) of the test and of the dev rows, the other what is left of them."""
    share = rows.agg(F.avg((F.col(stratum) == first).cast("int")).alias("p")).first()["p"] or 0.0
    part = math.floor(test * share), math.floor(dev * share)
    is_first = F.col(stratum) == first
    t = F.when(is_first, part[0]).otherwise(test - part[0])
    cuts = rows.select(stratum).distinct().select(stratum, t.alias("test"), (t + F.when(is_first, part[1]).otherwise(dev - part[1])).alias("dev"))
    return first_ranks(rows, stratum, seeded(seed, F.col(key)), key, cuts, ["test", "dev"], "train")


def quota_subset(rows: DataFrame, key: str, group: str, seed: int, quota: int, total: int, largest: str) -> DataFrame:
    """Up to ``quota`` rows of each group; what then misses to ``total`` comes from the group ``largest``. ``position`` is their place in a seeded order, from 1."""
    counts = rows.groupBy(group).agg(F.least(F.count("*"), F.lit(quota)).alias("n"))
    missing = max(total - (counts.agg(F.sum("n")).first()[0] or 0), 0)
    cuts = counts.select(group, (F.lit(quota) + F.when(F.col(group) == largest, missing).otherwise(0)).alias("in"))
    kept = first_ranks(rows, group, seeded(seed, F.col(key)), key, cuts, ["in"], "out").where(F.col("split") == "in").drop("split")
    kept = with_rank(kept.withColumn("__o", seeded(f"{seed}o", F.col(key))), "position", "__o", key).drop("__o")
    return kept.withColumn("position", F.col("position") + 1)


def check_split(split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"invalid split {split!r}: must be one of {list(SPLITS)}")
    return split


def locked(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none, what ``make`` gives is written there first. Once written it is never made again, whatever the data."""
    if not exists(spark, path):
        make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def split_examples(ids: DataFrame, examples: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The examples with the ids of a locked split; of equal ids the last by ``order``. An id without example raises KeyError."""
    kept = last_wins(examples, key, order)
    lost = ids.select(key).distinct().join(kept, key, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(lost[0][key])
    return ids.select(key).join(kept, key)


def splits_of(dataset: str, loaders: dict[str, Callable[[str], DataFrame]]) -> dict[str, DataFrame]:
    """train, dev and test of a dataset; one that is held out as a whole has rows in test only. ``loaders`` take the split's name."""
    if dataset not in CONDITIONS or dataset not in loaders:
        raise ValueError(f"unknown dataset {dataset!r}: must be one of {sorted(CONDITIONS)}")
    out = {}
    for s in SPLITS:
        df = loaders[dataset]("test" if dataset in HELD_OUT else s)
        out[s] = df.limit(0) if dataset in HELD_OUT and s != "test" else df
    return out


def python_permutation(n: int, seed: int) -> list[int]:
    """The order in which Python's seeded shuffle leaves 0..n-1: only to reproduce splits that were locked by it."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both have."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def canonical_json(*fields: tuple[str, Column]) -> Column:
    """{"name": "value", ...} with sorted names, as the lock hashes it: ASCII, all other characters escaped."""
    parts = []
    for name, c in sorted(fields):
        parts += [F.lit(("{" if not parts else ", ") + f'"{name}": '), json_string(F.coalesce(c.cast("string"), F.lit("")))]
    return F.concat(*parts, F.lit("}"))


def test_hash(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """(hash, size): SHA-256 of the canonical JSON list of the rows, sorted by key.

    The lock hashes one text, so its digest is a chain: rows are made and sorted in ranges of the key, and one task reads the ranges one after another and passes
    the digest's state on from batch to batch. No task holds more than a batch of rows beside the sort of a range."""
    each = rows.select(F.col(key).cast("string").alias("k"), canonical_json(*((f, F.col(f)) for f in fields)).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(b"["), 0
        for batch in batches:
            for text in batch.column(0):
                digest.update((b", " if n else b"") + text.as_py().encode())
                n += 1
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=["hash", "size"])

    chained = each.orderBy("k", "j").coalesce(1).select("j").mapInArrow(run, "hash string, size long")
    none = hashlib.sha256(b"[]").hexdigest()  # an empty table may have no task
    return chained.agg(F.coalesce(F.max("hash"), F.lit(none)).alias("hash"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("size"))


def save_test_hash(spark: SparkSession, path: str, sets: dict[str, Callable[[], DataFrame]], key: str = "id", fields: tuple[str, ...] = ("id", "answer")) -> dict[str, dict]:
    """Writes the manifest {name: {hash, size}} of the sets that their makers give, sorted by name; a set that can't be made has {error} in its place."""
    out: dict[str, dict] = {}
    for name in sorted(sets):
        try:
            out[name] = test_hash(sets[name](), key, *fields).first().asDict()
        except Exception as e:  # the others are saved all the same
            out[name] = {"error": str(e)}
    write_manifest(spark, out, path)
    return out


def verify_test_hash(spark: SparkSession, path: str, name: str, rows: DataFrame, key: str = "id", fields: tuple[str, ...] = ("id", "answer")) -> bool:
    """Whether the set is the one that was locked. FileNotFoundError where nothing was saved, ValueError where this set was not."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no saved hashes at {path}: save_test_hash writes them")
    saved = read_manifest(spark, path)
    if "hash" not in saved.get(name, {}):
        raise ValueError(f"set {name!r} has no hash in {path}")
    return test_hash(rows, key, *fields).first()["hash"] == saved[name]["hash"]
