"""Ranks and order statistics that hold for tables of any size: ranks come from range partitions, order statistics from histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import materialise


#: Buckets that a range of values is cut into; a histogram of so many rows at most, for each rank asked for, comes to the driver.
RADIX = 4096


def exact_ranks(df: DataFrame, values: str, shares: list[tuple[int, int]], radix: int = RADIX) -> list:
    """The value at index floor(numerator * n / denominator) of the sorted values, for each (numerator, denominator); nulls do not count, and without a value each is None.

    Selection by leading digits: the range of the values is cut into ``radix`` equal buckets, these are counted with their least and largest value, and only the bucket that holds a rank is
    counted again, in its own range, until it holds a single value. Partial counts are made before the shuffle, and no value is sorted. Each round leaves a rank at most one bucket of ``radix``; equal values are
    one bucket, however many. The type of the column (a whole, decimal or floating number) is kept, and a NaN is the largest value, as in Spark's order."""
    kind = df.schema[values].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    v = F.col("value")
    # NaN is apart: it has no place in a range
    rows = df.select(F.col(values).alias("value")).where(v.isNotNull())
    nan = F.isnan(v) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(False)
    whole_range = rows.agg(F.count("*").alias("n"), F.count_if(nan).alias("nans"), F.min(F.when(~nan, v)).alias("lo"), F.max(F.when(~nan, v)).alias("hi")).first()
    n, numbers = whole_range["n"], whole_range["n"] - whole_range["nans"]
    out: list = [None] * len(shares)
    open_: dict[int, tuple] = {}  # of each share whose value is not known: (values below its range, least, largest, rank)
    for i, (numerator, denominator) in enumerate(shares):
        rank = numerator * n // denominator
        if rank < numbers:
            open_[i] = (0, whole_range["lo"], whole_range["hi"], rank)
        elif rank < n:
            out[i] = float("nan")
    while open_:
        for i in [i for i, (_, lo, hi, _) in open_.items() if lo == hi]:
            out[i] = open_.pop(i)[1]
        ranges = sorted({(lo, hi) for _, lo, hi, _ in open_.values()})
        if not ranges:
            break
        bucket, of = F.lit(None).cast("long"), F.lit(None).cast("int")
        for k, (lo, hi) in enumerate(ranges):
            inside = ~nan & v.between(F.lit(lo).cast(kind), F.lit(hi).cast(kind))
            of = F.when(inside, k).otherwise(of)
            if whole:
                place = F.floor((v.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit((hi - lo) // radix + 1).cast("decimal(20,0)"))
            else:
                lo_, half = F.lit(float(lo)), float(hi) / 2 - float(lo) / 2  # halves, so that no difference is beyond the largest number
                place = F.floor((v.cast("double") / 2 - lo_ / 2) / F.lit(half) * (radix - 1)) if half > 0 else F.lit(0)
                place = F.when(v == F.lit(hi).cast(kind), radix).otherwise(place)  # so that a range is always parted
            bucket = F.when(inside, place.cast("long")).otherwise(bucket)
        counts = rows.select(of.alias("of"), bucket.alias("bucket"), "value").where("of is not null").groupBy("of", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("of", "bucket").collect()
        for i, (below, lo, hi, rank) in open_.items():
            for r in counts:
                if ranges[r["of"]] == (lo, hi):
                    if rank < below + r["n"]:
                        open_[i] = (below, r["lo"], r["hi"], rank)
                        break
                    below += r["n"]
    return out


def exact_rank(df: DataFrame, values: str, numerator: int, denominator: int) -> DataFrame:
    """(value): the value at index floor(numerator * n / denominator) of the sorted values, as ``exact_ranks`` finds it; no row without a value."""
    value = exact_ranks(df, values, [(numerator, denominator)])
    return df.sparkSession.createDataFrame([(x,) for x in value if x is not None], T.StructType([T.StructField("value", df.schema[values].dataType)]))


def with_rank(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of the columns: range partitions, a running sum of their sizes, and a rank within each."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    placed = materialise(placed, "ranges")
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(sizes), "__part").withColumn(name, (inside + F.col("__ahead") - 1).cast("long")).drop("__part", "__ahead")  # a row a partition


def first_ranks(rows: DataFrame, stratum: str, order: Column, key: str, cuts: DataFrame, names: list[str], rest: str) -> DataFrame:
    """``rows`` with ``split``: in each stratum the first rows by the hex text ``order``, then by ``key``, in parts that end at the columns ``names`` of ``cuts``
    (stratum, running totals), and the ``rest``.

    Rows are counted by the first three digits of their hash. Most of these buckets lie on one side of every cut; only the rows of buckets that a cut goes through are ranked."""
    keyed = rows.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, 3))
    upto = F.sum("__c").over(Window.partitionBy(stratum).orderBy("__b"))
    edges = keyed.groupBy(stratum, "__b").agg(F.count("*").alias("__c")).withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__c"))
    edges = edges.join(cuts, edges[stratum].eqNullSafe(cuts[stratum])).drop(cuts[stratum])
    cut = F.lit(False)
    for n in names:
        cut = cut | ((F.col("__from") < F.col(n)) & (F.col(n) < F.col("__to")))
    edges = materialise(edges.withColumn("__cut", cut), "buckets")
    found = keyed.join(edges, keyed[stratum].eqNullSafe(edges[stratum]) & (keyed["__b"] == edges["__b"])).select(*(keyed[c] for c in rows.columns), keyed["__h"], edges["__b"], "__from", "__cut", *names)

    def named(rank: Column) -> Column:
        out = F.lit(rest)
        for n in reversed(names):
            out = F.when(rank < F.col(n), n).otherwise(out)
        return out

    whole = found.where(~F.col("__cut")).withColumn("split", named(F.col("__from")))
    nth = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", key)) - 1
    ranked = found.where("__cut").withColumn("split", named(F.col("__from") + nth))
    return whole.unionByName(ranked).select(*rows.columns, "split")
