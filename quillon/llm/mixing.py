"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources, by code point with a null last, weigh 1, 2, 3, repeating, and share all
words; no target exceeds three times its source's size, and what is above goes to the others by weight. A target t of a
source of size S takes each document floor(t / S) times, and once more each document whose hash lies below the source's
threshold. The threshold is found without a sort: the words of the source are summed by the leading bits of the hash,
the running sum names the bucket in which the remaining budget ends, and only that bucket's documents are summed
again by the next bits, until the hash is used up. The documents with the boundary hash itself are taken if
that comes nearer to the target. The histogram has 2^bits rows a source at most, whatever the number of documents.

Cases: a null text has no words and is taken 0 times; a text of any length is counted whole; a null source is the last one; rows with the same doc_id share
a hash and go together; a null doc_id has a hash of its own; a source without words gets the target 0; an empty
table gives an empty table; other columns, whatever their names, are passed through by ``mix``, which repeats rows as often as taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.columns import ROW, packed, unpacked, with_row_key
from quillon.session import materialise, table

#: Bits of the hash, bits that one level of the histogram resolves, the largest multiple of a source, the weights.
HASH_BITS, LEVEL_BITS, MOST, WEIGHTS = 60, 12, 3, 3
SRC = ["src_null", "src"]


def sized(docs: DataFrame) -> DataFrame:
    """(__q_id, __q_row, doc_id, src_null, src, size, hash): small rows, written once and read by every later pass."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    own = with_row_key(docs.select("doc_id", "text", "source"))
    return materialise(own.select(*ROW, "doc_id", F.col("source").isNull().alias("src_null"), F.coalesce("source", F.lit("")).alias("src"), size.alias("size"), hashed.alias("hash")), "sizes")


def targets(docs: DataFrame) -> DataFrame:
    """(src_null, src, source_size, target): one row a source.

    Ranks come from a range partitioning and a running sum over the partitions, so no task sorts all sources; the capped
    shares come from a few sums over the sources, of which the driver sees the totals alone."""
    sums = docs.groupBy(*SRC).agg(F.sum("size").alias("source_size"))
    placed = materialise(sums.repartitionByRange(*SRC).sortWithinPartitions(*SRC).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*SRC)) + F.col("ahead") - 1
    ranked = placed.join(offsets, "part").withColumn("weight", (rank % WEIGHTS + 1).cast("long")).drop("part", "ahead")
    ranked = materialise(ranked, "weights")
    cap, level = MOST * F.col("source_size"), 0.0
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    while total:  # each round caps at least one more source, or ends; caps reached at once are found at once
        full = cap <= F.lit(level) * F.col("weight")
        got = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (got[0] or 0)) / got[1] if got[1] else level
        if new <= level:
            break
        level = new
    return ranked.select(*SRC, "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with whole (times that every document is taken) and bound (hashes below it are taken once more)."""
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("whole", ratio.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    rows, used = docs.where("size > 0").select(*SRC, "size", "hash"), 0
    while used < HASH_BITS:
        left = HASH_BITS - used - LEVEL_BITS
        bucket = F.shiftright("hash", left)
        if used:
            inside = state.where("hit").select(*SRC, "prefix")
            rows = rows.join(inside, [rows[c] == inside[c] for c in SRC] + [F.shiftright(rows["hash"], left + LEVEL_BITS) == inside["prefix"]], "left_semi")
        sums = rows.groupBy(*SRC, bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy(*SRC).orderBy("bucket"))
        spans = sums.withColumn("to", run).join(state.select(*SRC, "rest"), SRC).where((F.col("to") > F.col("rest")) & (F.col("to") - F.col("words") <= F.col("rest")))
        edge = spans.select(*SRC, F.col("bucket").alias("next"), (F.col("to") - F.col("words")).alias("under"), "words")
        state = state.drop("words").join(edge, SRC, "left")
        hit = F.col("next").isNotNull()
        # without an edge the whole bucket, or all of the source, fits in the budget
        state = state.withColumn("prefix", F.when(hit, F.col("next")).otherwise(F.shiftleft(F.col("prefix") + 1, LEVEL_BITS) - 1 if used else F.lit((1 << LEVEL_BITS) - 1).cast("long")))
        state = materialise(state.withColumn("rest", F.when(hit, F.col("rest") - F.col("under")).otherwise(F.col("rest"))).withColumn("hit", hit).drop("next", "under"), "edges")
        used += LEVEL_BITS
    nearer = ~F.col("hit") | (2 * F.col("rest") > F.col("words"))
    return state.select(*SRC, "source_size", "target", "whole", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("bound"))


def taken(docs: DataFrame) -> DataFrame:
    """Per row: the row key, doc_id, size, source_size, target and times (how often the mix takes the row)."""
    own = sized(docs)
    goals = thresholds(own, targets(own))
    out = own.join(goals, SRC)
    times = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("hash") < F.col("bound"), 1).otherwise(0)).otherwise(0)
    return out.select(*ROW, "doc_id", "size", "source_size", "target", times.cast("long").alias("times"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns as they are."""
    often = taken(docs).where("times > 0").groupBy(*ROW).agg(F.max("times").cast("int").alias("__q_times"))
    out = packed(docs).join(often, ROW)
    return unpacked(out.withColumn("__q_copy", F.explode(F.sequence(F.lit(1), F.col("__q_times")))))


def op6_mixing(spark, sf_dir):
    """doc_id, size, source_size, target and taken for each document."""
    out = taken(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("times")).alias("taken"))


ORACLE_SQL = r"""
with recursive d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
                  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
t as (select sum(source_size)::bigint as total, count(*) as n from s),
lv(k, level) as (
  select 0, 0::double union all
  select k + 1, (select (any_value(t.total) - coalesce(sum(3 * source_size) filter (where 3 * source_size <= level * weight), 0))
                        / nullif(sum(weight) filter (where 3 * source_size > level * weight), 0) from s, t)
  from lv where k <= (select n from t) and level is not null),
z as (select s.*, least((3 * source_size)::double, (select max(level) from lv) * weight) as target from s),
q as (select z.*, case when source_size > 0 then floor(target / source_size) else 0 end as whole from z),
g as (select d.source, h, sum(size) as words from d where size > 0 group by d.source, h),
c as (select g.source, h, words, sum(words) over (partition by source order by h) as upto from g),
e as (select c.source, max(h) filter (where upto <= target - whole * source_size
                                         or (upto - words <= target - whole * source_size and 2 * (target - whole * source_size - (upto - words)) > words)) as last
      from c join q on c.source is not distinct from q.source group by c.source)
select doc_id, size, source_size, round(target, 6) as target,
       (size * (whole + case when h <= e.last then 1 else 0 end))::bigint as taken
from d join q on d.source is not distinct from q.source left join e on d.source is not distinct from e.source
"""
