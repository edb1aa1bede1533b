"""Line dedup over levelled sorted runs of line hashes.

The documents are taken in batches of descending doc_id. A batch's lines are hashed to 128 bits and summed up to one row
per hash: how many documents hold the line, and the largest doc_id that does. A batch merge-anti-joins the runs: a hash
that a run already shows as held by enough documents, under a larger doc_id, can change nothing and is left out; the rest
becomes the batch's own sorted run of level 0. As soon as ``fan_in`` runs share a level, they are merged into one of the
next level, so there are never more than fan_in - 1 runs on each of log(batches) levels. At the end the runs name
the repeated lines, and each document loses its lines with such a hash, unless it is the largest doc_id that holds it.

Everything is DataFrame code: hot lines are summed before the shuffle, and joined by a sort-merge join with an
exchange on either side, which Spark splits where a key is hot (or a broadcast where the repeated lines are few
by Spark's own size check).

Cases: a null or empty text is one empty line, and never changes; rows with the same doc_id count as one document, so a
row given twice counts once; of rows that share the largest doc_id each keeps the line; rows with a null doc_id are one document that counts as smaller
than any other; a text of any length is split whole; an empty table gives an empty table; other columns, whatever their names, are passed through by ``drop_repeated_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import DOC, NO_ID, ROW, kept_lines, line_key, lines, packed, with_row_key, without_lines
from quillon.session import materialise, table

MIN_CHARS, MIN_DOCS, BATCHES, FAN_IN = 20, 3, 4, 2
KEY = ["h1", "h2"]


class LineRuns:
    """The sorted runs: (h1, h2, n_docs, last_doc), unique hashes in each run, a level for each run."""

    def __init__(self, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.min_docs, self.fan_in, self.levels = min_docs, fan_in, []

    def add(self, batch: DataFrame, min_chars: int = MIN_CHARS) -> None:
        """Merge-anti-join a batch of (doc_id, text) with the runs, and keep the rest as a run of its own. All rows of a doc_id must be in one batch."""
        held = F.array_distinct(F.filter(F.transform(lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars))
        rows = batch.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.explode(held).alias("line"))
        own = rows.groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("last_doc"))
        if self.levels:
            full = self._union([r for level in self.levels for r in level]).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", F.col("last_doc").alias("run_doc"))
            own = own.join(full, (own.h1 == full.h1) & (own.h2 == full.h2) & (full.run_doc >= own.last_doc), "left_anti")
        self._push(self._sorted(own), 0)

    def repeated(self) -> DataFrame:
        """(h1, h2, last_doc) of the lines that at least ``min_docs`` documents hold."""
        return self._merged([r for level in self.levels for r in level]).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc")

    def _push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            merged = self._sorted(self._merged(self.levels[level]))
            self.levels[level] = []
            self._push(merged, level + 1)

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return self._union(runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        return materialise(rows.sortWithinPartitions(*KEY), "line-run")


def id_batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` in ``n`` batches of descending doc_id, about equal in rows; nulls come last."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    cuts = docs.select(F.percentile_approx(doc, [i / n for i in range(n - 1, 0, -1)], 1000).alias("c")).first()["c"] or []
    cuts = list(dict.fromkeys(cuts))
    if not cuts:
        return [docs]
    return [docs.where(doc > cuts[0]), *(docs.where((doc <= a) & (doc > b)) for a, b in zip(cuts, cuts[1:])), docs.where(doc <= cuts[-1])]


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fan_in: int) -> DataFrame:
    """(__q_id, __q_row, __q_drop): the sorted positions, from 0, of the lines that a document loses."""
    bare = docs.select("doc_id", "text")
    runs = LineRuns(min_docs, fan_in)
    for batch in id_batches(bare, batches):
        runs.add(batch, min_chars)
    repeated = materialise(runs.repeated(), "lines")
    each = with_row_key(bare).select(*ROW, F.posexplode(lines(F.col("text"))).alias("pos", "line")).withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_chars)
    each = each.select(*ROW, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    lost = each.join(repeated, KEY).where(F.col("__q_id") < F.col("last_doc"))
    return lost.groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("__q_drop"))


def with_kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """``packed`` documents with __q_drop, null where nothing goes."""
    return packed(docs).join(dropped_positions(docs, min_chars, min_docs, batches, fan_in), ROW, "left")


def drop_repeated_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with every column; ``text`` has lost its repeated lines, and ``n_chars``, if there, is counted anew.
    A text that keeps all its lines, or is null, stays as it is."""
    return without_lines(with_kept_lines(docs, **parameters), F.col("__q_drop"))


def op3_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_dropped and kept_sha256 for each document."""
    out = with_kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    doc_id, text = F.col(DOC)["doc_id"], F.col(DOC)["text"]
    kept = F.array_join(kept_lines(text, F.col("__q_drop")), "\n")
    return out.select(doc_id.alias("doc_id"), F.size(lines(text)).cast("long").alias("n_lines"), F.coalesce(F.size("__q_drop"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with l as (
  select doc_id, u.pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d,
       lateral (select unnest(d.ls) as line, generate_subscripts(d.ls, 1) as pos) u),
r as (select k, max(doc_id) as last_doc from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
f as (select l.*, r.k is not null and l.doc_id < r.last_doc as gone from l left join r on l.k = r.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from f group by doc_id
"""
