"""Quality rules with cross-document line frequency.

The base counts words, symbols, repeated lines and repeated 8-word windows of each whole text, in higher-order functions
that need no more than a sort of a document's own windows. The method then hashes each normalised line, counts the distinct
documents that hold it within each host (the column ``source``), removes the lines above the host's limit, and
rejects a document of whose words too small a share is left. The limit is a share of the host's documents, with three as the least evidence, so it
means the same at every size of the input.

Hot lines and hot hosts are summed before the shuffle. Lines above the limit are few: with a share s and k lines in a mean
document of a host there are at most k/s of them; Spark broadcasts them only where its own size check allows, and
splits a hot key of the sort-merge join otherwise. 64-bit hashes of (host, line) do here: a wrong verdict needs
a line that falls on one of the few frequent hashes.

Cases: a null or empty text has no words and fails the base; a null source is a host of its own; rows with the same doc_id count as one
document of a host, also those with a null one; rows given twice get the same verdict twice; a text of any length is read whole; an empty table gives an empty table; other columns, whatever their names, are
passed through by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import DOC, ROW, let, line_key, lines, packed, with_row_key, without_lines, words
from quillon.session import materialise, table

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: A line is above the limit if more than this share of its host's documents hold it, and at least so many: two copies of a line are no evidence.
HOST_SHARE, HOST_DOCS = 0.1, 3
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3
#: A row's key with its host: what a verdict is for.
KEY = [*ROW, "__q_host"]


def window_hashes(w: Column, size: int) -> Column:
    """The hash of every run of ``size`` words, a power of two: runs of twice the length are hashed from the hashes of their halves."""

    def longer(h: Column, width: int) -> Column:
        if width == size:
            return h
        left, right = F.slice(h, 1, F.greatest(F.size(h) - width, F.lit(0))), F.slice(h, 1 + width, F.size(h))
        return let(F.zip_with(left, right, lambda x, y: F.xxhash64(x, y)), lambda h: longer(h, 2 * width))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: longer(h, 1))


def repeat_words(w: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that is found twice or more in the array ``w``."""
    def at(pairs: Column) -> Column:
        """The ascending starts of the windows that are found twice."""

        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))

        found = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(found, lambda i: F.get(pairs, i)["at"]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.zip_with(h, F.sequence(F.lit(1), F.size(h)), lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.aggregate(
            let(pairs, at),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda s, p: F.struct((s["n"] + size - F.greatest(F.lit(0), s["to"] - p)).alias("n"), (p + size).alias("to")),
            lambda s: s["n"],
        )

    some = let(window_hashes(w, size), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) <= size, F.lit(0)).otherwise(some).cast("long")


def _with_host(docs: DataFrame) -> DataFrame:
    return with_row_key(docs).withColumn("__q_host", F.xxhash64(docs["source"]))


def base(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text, source): the row key, the counts of the base and its verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = _with_host(docs.select("doc_id", "text", "source")).withColumn("w", words(text))
    worded = F.filter(lines(text), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.select(
        *KEY,
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col("w"), lambda w: repeat_words(w)).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def line_verdicts(docs: DataFrame, share: float, least: int) -> DataFrame:
    """(__q_id, __q_row, __q_host, lost_words, drop): words in lines above their host's limit, and the sorted positions of these, of one of equal rows; rows
    without such lines are absent."""
    own = _with_host(docs.select("doc_id", "text", "source")).withColumn("host", F.col("__q_host"))
    keyed = F.array_distinct(F.filter(F.transform(lines(F.col("text")), line_key), lambda k: k != ""))
    sizes = own.groupBy("host").agg(F.count_distinct("__q_id").alias("host_docs"))
    held = own.select("host", "__q_id", F.explode(keyed).alias("line"))
    counts = held.groupBy("host", F.xxhash64("line").alias("h")).agg(F.count_distinct("__q_id").alias("n_docs")).where(F.col("n_docs") >= least)
    above = materialise(counts.join(sizes, "host").where(F.col("n_docs") > F.col("host_docs") * share).select("host", "h"), "host-lines")
    each = own.select(*KEY, "host", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    each = each.select(*KEY, "host", "at", F.xxhash64(line_key(F.col("line"))).alias("h"), "line")
    lost = each.join(above, ["host", "h"]).select(*KEY, "at", F.size(words(F.col("line"))).cast("long").alias("n"))
    return lost.distinct().groupBy(*KEY).agg(F.sum("n").alias("lost_words"), F.sort_array(F.collect_set("at")).alias("drop"))


def verdicts(docs: DataFrame, share: float = HOST_SHARE, least: int = HOST_DOCS, left: float = LEFT_SHARE) -> DataFrame:
    """Per row: the row key, doc_id, the base's counts, base_failed, left_words, kept, and the positions of the lines that go."""
    judged = base(docs).join(line_verdicts(docs, share, least), KEY, "left")
    judged = judged.withColumn("left_words", F.col("n_words") - F.coalesce("lost_words", F.lit(0)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("left_words") >= left * F.col("n_words"))).drop("lost_words")


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; ``text`` has lost the lines above its host's limit, and ``n_chars``, if there, is counted anew."""
    good = verdicts(docs, **parameters).where("kept").select(*KEY, "drop").dropDuplicates(KEY)
    rows = packed(docs).withColumn("__q_host", F.xxhash64(F.col(DOC)["source"]))
    return without_lines(rows.join(good, KEY), F.col("drop"))


def op5_quality_rules(spark, sf_dir):
    """doc_id, n_words, the four counts, base_failed, kept and left_words for each document."""
    out = verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")


ORACLE_SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as ls,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, hash(list_slice(w, i, i + {WINDOW - 1})::varchar) as h from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d)),
r as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i), {WINDOW}) as gap
      from (select doc_id, i, count(*) over (partition by doc_id, h) as n from g) where n > 1),
c as (select doc_id, sum(least(gap, {WINDOW}))::bigint as n_repeat_words from r group by doc_id),
l as (select doc_id, source, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from (select doc_id, source, unnest(ls) as line from d)),
s as (select source, count(*) as host_docs from d group by source),
a as (select l.source, k from l join s on l.source is not distinct from s.source where k <> '' group by l.source, k
      having count(distinct doc_id) >= {HOST_DOCS} and count(distinct doc_id) > any_value(host_docs) * {HOST_SHARE}::double),
x as (select doc_id, sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')))::bigint as lost
      from l join a on l.k = a.k and l.source is not distinct from a.source group by doc_id),
b as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
             (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, (len(w) - coalesce(lost, 0))::bigint as left_words
      from d left join c on d.doc_id = c.doc_id left join x on d.doc_id = x.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words) and left_words >= {LEFT_SHARE}::double * n_words as kept, left_words
from b
"""
