"""The ordered cascade of filters over generated examples, as one plan of column expressions, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import citation_count, factoid_overlap, first_bad_citation, is_cited, strip, word_count

# Names and messages that results depend on.
NAMES = ["format", "citations", "citation_validity", "reasoning_length", "answer_format", "gold_answer_agreement"]
YESNO = ["yes", "no", "maybe", "insufficient evidence"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _insufficient() -> Column:
    return F.lower(_text("generated_answer")).contains("insufficient evidence")


def reason_format() -> Column:
    missing = F.col("generated_reasoning").isNull() | F.col("generated_answer").isNull()
    return F.when(missing, "Missing reasoning or answer fields")


def reason_citations() -> Column:
    return F.when(~(_insufficient() | is_cited(_text("generated_reasoning"))), "No valid citations found in reasoning")


def reason_citation_validity(strict: bool = False) -> Column:
    bad = first_bad_citation(_text("generated_reasoning"), strict)
    return F.when(bad.isNotNull(), F.concat(F.lit("Invalid citation [P"), bad, F.lit("] (must be P1-P5)")))


def reason_reasoning_length(low: int = 20, high: int = 200) -> Column:
    n = word_count(_text("generated_reasoning"))
    return F.when(n < low, F.format_string(f"Reasoning too short (%d words, need ≥{low})", n)).when(n > high, F.format_string(f"Reasoning too long (%d words, need ≤{high})", n))


def reason_answer_format(most: int = 30) -> Column:
    answer, kind, n = strip(_text("generated_answer")), _text("question_type"), word_count(_text("generated_answer"))
    return (
        F.when(answer == "", "Empty answer")
        .when((kind == "yesno") & ~F.lower(answer).isin(YESNO), F.concat(F.lit("Invalid yes/no answer: '"), answer, F.lit("'")))
        .when((kind == "factoid") & (n > most), F.format_string(f"Factoid answer too long (%d words, need ≤{most})", n))
        .when(~kind.isin("yesno", "factoid"), F.concat(F.lit("Unknown question type: "), kind))
    )


def reason_agreement(ascii_only: bool = False) -> Column:
    answer, gold, kind = strip(_text("generated_answer")), strip(_text("gold_answer")), _text("question_type")
    versus = F.concat(F.lit("generated='"), answer, F.lit("' vs gold='"), gold, F.lit("'"))
    hedged = (kind == "yesno") & (F.lower(answer) == "maybe")
    return (
        F.when((answer == "") | (gold == ""), "Missing generated or gold answer")
        .when(_insufficient(), F.lit(None))
        .when(hedged & is_cited(_text("generated_reasoning")), F.lit(None))
        .when(hedged, F.concat(F.lit("Maybe answer without citations: generated='"), answer, F.lit("'")))
        .when(kind == "yesno", F.when(F.lower(answer) != F.lower(gold), F.concat(F.lit("Yes/no mismatch: "), versus)))
        .when(kind == "factoid", F.when(~factoid_overlap(answer, gold, ascii_only), F.concat(F.lit("Factoid mismatch: "), versus)))
        .otherwise(F.concat(F.lit("Unknown question type: "), kind))
    )


def disagreement() -> Column:
    """Which way a cited "maybe" hedges against the gold answer; null for all other rows."""
    answer, gold = F.lower(strip(_text("generated_answer"))), F.lower(strip(_text("gold_answer")))
    hedged = (_text("question_type") == "yesno") & (answer == "maybe") & is_cited(_text("generated_reasoning"))
    return F.when(hedged & (gold == "yes"), "model_hedged_yes").when(hedged & (gold == "no"), "model_hedged_no")


def reasons(ascii_only: bool = False) -> dict[str, Column]:
    """The failure reason of each filter, null where it passes, in the order of the cascade."""
    return dict(zip(NAMES, (reason_format(), reason_citations(), reason_citation_validity(), reason_reasoning_length(), reason_answer_format(), reason_agreement(ascii_only))))


def apply_filters(examples: DataFrame, ascii_only: bool = False, compat: bool = False) -> DataFrame:
    """``examples`` with filter_passed, filter_failed_at, filter_failure_reason and gold_disagreement; old verdicts are replaced.

    Unless ``ascii_only``, the last filter needs a Python step for answers that are not ASCII; it gets a null for all others. ``compat`` keeps a gold_disagreement
    that the rows have, where the new verdict gives none."""
    verdict = ["filter_passed", "filter_failed_at", "filter_failure_reason"]
    kept = F.col("__old") if compat and "gold_disagreement" in examples.columns else F.lit(None).cast("string")
    out = examples.withColumnRenamed("gold_disagreement", "__old").drop(*verdict)
    found = reasons(ascii_only)
    failed = F.coalesce(*(F.when(r.isNotNull(), F.struct(F.lit(n).alias("at"), r.alias("why"))) for n, r in found.items()))
    out = out.withColumn("__failed", failed)
    out = out.withColumns({"filter_passed": F.col("__failed").isNull(), "filter_failed_at": F.col("__failed.at"), "filter_failure_reason": F.col("__failed.why")})
    return out.withColumn("gold_disagreement", F.coalesce(F.when(F.col("filter_passed"), disagreement()), kept)).drop("__failed", "__old")


def rejections(filtered: DataFrame) -> DataFrame:
    """(filter, n) for all six filters, zeros too."""
    every = filtered.sparkSession.createDataFrame(list(enumerate(NAMES)), "ord int, filter string")
    counts = filtered.where("not filter_passed").groupBy(F.col("filter_failed_at").alias("filter")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(counts), "filter", "left").select("filter", F.coalesce("n", F.lit(0)).alias("n"))


def pass_rates(filtered: DataFrame) -> DataFrame:
    """(kind, value, total, passed, rate) overall, by mode and by question type, in one pass."""
    rows = filtered.select("mode", "question_type", F.col("filter_passed").cast("int").alias("p"))
    rows = rows.groupingSets([[], ["mode"], ["question_type"]], "mode", "question_type").agg(F.grouping_id().alias("g"), F.count("*").alias("total"), F.sum("p").alias("passed"), F.round(F.avg("p"), 6).alias("rate"))
    kind = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "mode").otherwise("question_type")
    return rows.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("mode")).when(F.col("g") == 2, F.col("question_type")).otherwise("all").alias("value"), "total", "passed", "rate")


def crosstab(rows: DataFrame) -> DataFrame:
    """(mode, factoid, yesno, unknown, total); a missing mode or type is unknown."""
    kind = F.coalesce(F.nullif("question_type", F.lit("")), F.lit("unknown"))
    counted = [F.count_if(kind == t).alias(t) for t in ("factoid", "yesno", "unknown")]
    return rows.groupBy(F.coalesce("mode", F.lit("unknown")).alias("mode")).agg(*counted, F.count("*").alias("total"))


def citation_histogram(filtered: DataFrame) -> DataFrame:
    """(n_citations, bucket, n, share) of the rows that pass."""
    counts = filtered.where("filter_passed").groupBy(citation_count(F.col("generated_reasoning"), "[0-9]").cast("long").alias("n_citations")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    bucket = F.when(F.col("n_citations") >= 3, "3+").when(F.col("n_citations") > 0, F.col("n_citations").cast("string"))
    return counts.join(F.broadcast(total)).select("n_citations", F.coalesce(bucket, F.lit("none")).alias("bucket"), "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share): counts with the share of all."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def not_one_gold(examples: DataFrame) -> DataFrame:
    """Easy examples whose passages do not have exactly one gold."""
    return examples.where((F.col("mode") == "easy") & (F.size(F.filter("passages", lambda p: p["is_gold"])) != 1))
