"""Answer statistics over predictions (example_id, model, retrieval, seed, predicted, gold, confidence)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.order_statistics import with_rank
from quillon.functions.text import bound, hash_number, held_words, words

CELL = ["model", "retrieval", "seed"]
MODELS, RETRIEVALS, SEEDS = ("base", "lora_a", "lora_a_prime", "lora_b"), ("none", "strong", "oracle"), (42, 123, 456)


def cells(spark) -> DataFrame:
    """Every (model, retrieval, seed, cell): the base model is deterministic and has one run, without a seed in its name."""
    rows = [(m, r, None if m == "base" else s) for m in MODELS for r in RETRIEVALS for s in (SEEDS[:1] if m == "base" else SEEDS)]
    df = spark.createDataFrame(rows, "model string, retrieval string, seed int")
    return df.withColumn("cell", cell_name(F.col("model"), F.col("retrieval"), F.col("seed")))


def cells_found(pred: DataFrame) -> DataFrame:
    """Every cell of the grid with the number of its predictions, 0 where it was not run; runs of the base model count for its one cell, whatever their seed."""
    seed = F.when(F.col("model") != "base", F.col("seed")).cast("int")
    n = pred.groupBy("model", "retrieval", seed.alias("seed")).agg(F.count("*").alias("n"))
    out = cells(pred.sparkSession).alias("c").join(n.alias("n"), _same("c", "n", ["model", "retrieval", "seed"]), "left")
    return out.select("c.*", F.coalesce("n.n", F.lit(0)).alias("n"))


def cell_name(model: Column, retrieval: Column, seed: Column) -> Column:
    return F.concat_ws("_", model, retrieval, F.when(seed.isNotNull(), F.concat(F.lit("seed"), seed.cast("string"))))


def accuracy(pred: DataFrame, *by: str) -> DataFrame:
    return pred.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("gold")).cast("int")), 6).alias("accuracy"))


def per_class(pred: DataFrame, *by: str) -> DataFrame:
    """(by, label, precision, recall, f1) over all labels that occur as prediction or gold; 0 where a share has no rows."""
    rows = pred.select(*by, F.explode(F.array_distinct(F.array("predicted", "gold"))).alias("label"), "predicted", "gold")
    p, g = F.col("predicted") == F.col("label"), F.col("gold") == F.col("label")
    out = rows.groupBy(*by, "label").agg(F.count_if(p & g).alias("tp"), F.count_if(p).alias("n_predicted"), F.count_if(g).alias("n_gold"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return out.select(*by, "label", "n_gold", F.round(ratio(F.col("tp"), F.col("n_predicted")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("n_gold")), 6).alias("recall"), F.round(ratio(2 * F.col("tp"), F.col("n_predicted") + F.col("n_gold")), 6).alias("f1"))


def macro_f1(pred: DataFrame, *by: str) -> DataFrame:
    return per_class(pred, *by).groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def calibration_error(pred: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, open below and closed above."""
    b = F.greatest(F.lit(1), F.ceil(F.col("confidence") * bins)).cast("int")
    per = pred.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("gold")).cast("int")).alias("acc"), F.avg("confidence").alias("conf"))
    return per.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def all_metrics(pred: DataFrame, *by: str) -> DataFrame:
    return accuracy(pred, *by).join(macro_f1(pred, *by), [*by]).join(calibration_error(pred, *by), [*by])


def cohens_h(a: Column, b: Column) -> Column:
    return 2 * F.asin(F.sqrt(a)) - 2 * F.asin(F.sqrt(b))


def effect_name(h: Column) -> Column:
    h = F.abs(h)
    return F.when(h < 0.2, "negligible").when(h < 0.5, "small").when(h < 0.8, "medium").otherwise("large")


def across_seeds(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and sample deviation; 0 for a single run."""
    return values.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"))


def gains(pred: DataFrame, baseline: str = "base") -> DataFrame:
    """(model, retrieval, n_seeds, mean, std) of the accuracy over the baseline with the same retrieval."""
    acc = pred.groupBy(*CELL).agg(F.avg((F.col("predicted") == F.col("gold")).cast("int")).alias("acc"))
    base = acc.where(F.col("model") == baseline).groupBy("retrieval").agg(F.avg("acc").alias("base"))
    return across_seeds(acc.where(F.col("model") != baseline).join(F.broadcast(base), "retrieval").withColumn("gain", F.col("acc") - F.col("base")), "gain", "model", "retrieval")


#: Distinct values of a group up to which a draw is looked up in a list of them; beyond it, draws are joined with the ranked rows.
FEW = 4096


def _drawn(groups: DataFrame, by: list[str], resamples: int, seed: int, *more: str) -> DataFrame:
    """``groups`` (by, n, more) with a row for each draw: (by, n, more, b, r), r the place, from 0, that draw d of resample b takes: hash(seed|by|b|d) mod n.

    What the draws of a resample share of their key is made once for all of them."""
    spread = groups.select(*by, "n", *more, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    shared = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in [*by, "b"]), F.lit(""))
    spread = spread.withColumn("__key", shared).repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = spread.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 65536"))))
    spread = spread.withColumn("d", F.explode(F.sequence(F.col("__c") * 65536, F.least(F.col("n"), (F.col("__c") + 1) * 65536) - 1)))
    return spread.select(*by, "n", *more, "b", (hash_number(F.concat("__key", F.col("d").cast("string"))) % F.col("n")).alias("r"))


def _counted_upto(rows: DataFrame, name: str, totals: str, most: int, value: str) -> DataFrame:
    """``rows`` with how many of the rising ``totals``, an array of at most ``most``, are not above ``value``: by halving, each step a plain column, so the cost is the logarithm of ``most`` and no lambda runs."""
    rows = rows.withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(most.bit_length()))):
        rows = rows.withColumn(name, F.when(F.get(totals, F.col(name) + (step - 1)) <= F.col(value), F.col(name) + step).otherwise(F.col(name)))
    return rows


def resampled_means(rows: DataFrame, value: str, by: list[str], resamples: int, seed: int, few: int = FEW) -> DataFrame:
    """(by, b, m): the mean of each resample of each group of ``rows``.

    A draw is a place among the group's sorted values, so a resample is a multinomial count over the distinct values: these are counted once, and a
    draw finds its value by the running totals. Nothing is joined, and a sum a resample and task is shuffled."""
    values = rows.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    counts = values.groupBy(*by, "v").agg(F.count("*").alias("c"))
    most = counts.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k").alias("k")).first()["k"] or 0
    if most > few:
        ranked = with_rank(values, "i", *by, "v")
        groups = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.min("i").alias("first"))
        places = _drawn(groups, by, resamples, seed, "first").select(*by, "n", "b", (F.col("first") + F.col("r")).alias("i"))
        return places.join(ranked.select("i", "v"), "i").groupBy(*by, "b").agg((F.sum("v") / F.first("n")).alias("m"))
    running = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("v")))  # few rows a group
    groups = running.groupBy(*by).agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("upto", "v"))).alias("vs")).select(*by, "n", F.col("vs.upto").alias("upto"), F.col("vs.v").alias("v"))
    drawn = _counted_upto(_drawn(groups, by, resamples, seed, "upto", "v"), "__at", "upto", most, "r")
    return drawn.select(*by, "n", "b", F.get("v", F.col("__at")).alias("v")).groupBy(*by, "b").agg((F.sum("v") / F.first("n")).alias("m"))


def grouped_bootstrap(rows: DataFrame, value: str, *by: str, resamples: int = 1000, seed: int = 42, level: float = 0.95, few: int = FEW) -> DataFrame:
    """(by, n, mean_diff, ci_lower, ci_upper, p_value) of the mean of ``value`` in each group, all groups in one plan; the draws are hashes of group, resample and place, so the
    result is the same on any cluster. Rows without a value don't count; a group without any has no row."""
    by_ = list(by)
    low, high = math.floor((1 - level) / 2 * resamples), min(resamples - 1, math.floor((1 + level) / 2 * resamples))
    means = resampled_means(rows, value, by_, resamples, seed, few)
    m = F.round("m", 9)
    ordered = means.groupBy(*by_).agg(F.array_sort(F.collect_list(m)).alias("ms"), F.avg((m <= 0).cast("int")).alias("le"), F.avg((m >= 0).cast("int")).alias("ge"))
    mean = rows.groupBy(*by_).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    out = ordered.join(F.broadcast(mean)) if not by_ else ordered.alias("o").join(mean.alias("m"), _same("o", "m", by_)).select(*(F.col(f"o.{c}").alias(c) for c in by_), "ms", "le", "ge", "n", "mean")
    p = F.least(F.lit(1.0), 2 * F.least("le", "ge"))
    return out.select(*by_, "n", F.round("mean", 6).alias("mean_diff"), F.round(F.get("ms", low), 6).alias("ci_lower"), F.round(F.get("ms", high), 6).alias("ci_upper"), F.round(p, 6).alias("p_value"))


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equality of the columns of two aliased tables, where a null equals a null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def bootstrap(pairs: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(mean_diff, ci_lower, ci_upper, p_value) of the mean of ``value`` (one row a key, such as a paired difference), by draws of rows in the order of the key: its seeded results are fixed. ``grouped_bootstrap``
    draws from counts of values, and joins nothing.

    Draw i of resample b is row hash(seed|b|i) mod n, so the result is the same on any cluster. Draws are made where they are summed: Spark
    broadcasts the values where its own size check allows, and then only a sum a resample and task is shuffled."""
    n = pairs.count()
    spark = pairs.sparkSession
    ranked = with_rank(pairs.select(key, F.col(value).cast("double").alias("v")), "i", key).select("v", "i")
    draws = spark.range(n * resamples).select(F.expr(f"id div {max(n, 1)}").alias("b"), F.expr(f"id % {max(n, 1)}").alias("d"))
    draws = draws.select("b", (hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("d").cast("string"))) % max(n, 1)).alias("i"))
    means = draws.join(ranked, "i").groupBy("b").agg((F.sum("v") / n).alias("m"))
    low, high = math.floor((1 - level) / 2 * resamples), min(resamples - 1, math.floor((1 + level) / 2 * resamples))
    ordered = means.agg(F.array_sort(F.collect_list(F.round("m", 9))).alias("ms"), F.avg((F.round("m", 9) <= 0).cast("int")).alias("le"), F.avg((F.round("m", 9) >= 0).cast("int")).alias("ge"))
    mean = pairs.agg(F.avg(F.col(value).cast("double")).alias("mean"))
    p = F.least(F.lit(1.0), 2 * F.least("le", "ge"))
    return ordered.join(F.broadcast(mean)).select(F.round("mean", 6).alias("mean_diff"), F.round(F.get("ms", low), 6).alias("ci_lower"), F.round(F.get("ms", high), 6).alias("ci_upper"), F.round(p, 6).alias("p_value"))


def paired(pred: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """(example_id, diff): correctness in cell a less that in cell b, for examples that both have."""

    def one(cell: tuple, name: str) -> DataFrame:
        return pred.where((F.col("model") == cell[0]) & (F.col("retrieval") == cell[1]) & (F.col("seed") == cell[2])).select("example_id", (F.col("predicted") == F.col("gold")).cast("int").alias(name))

    return one(a, "a").hint("merge").join(one(b, "b"), "example_id").select("example_id", (F.col("a") - F.col("b")).alias("diff"))


def interaction_pairs(pred: DataFrame, treated: str = "lora_b", control: str = "lora_a_prime") -> DataFrame:
    """(example_id, diff): (oracle - none) of the treated model less that of the control, each averaged over seeds; the baseline cancels."""
    sign = F.when(F.col("model") == treated, 1).otherwise(-1) * F.when(F.col("retrieval") == "oracle", 1).otherwise(-1)
    rows = pred.where(F.col("model").isin(treated, control) & F.col("retrieval").isin("oracle", "none"))
    n = rows.select("seed").distinct().count()
    return rows.groupBy("example_id").agg((F.sum(sign * (F.col("predicted") == F.col("gold")).cast("int")) / n).alias("diff"))


def interaction_effect(pred: DataFrame, treated: str = "lora_b", control: str = "lora_a_prime", resamples: int = 1000, strata: DataFrame | None = None) -> DataFrame:
    """The interaction (gain at oracle less gain at none) of both models, their difference with its interval and p, the effect size (Cohen's h of
    treated against control at oracle, less that at none) and what it says.

    One row; with ``strata`` (example_id, kind, stratum) one row, and n, for each stratum of each kind of stratum, all in one plan. An example without a stratum of a kind doesn't count in it."""
    by = [] if strata is None else ["kind", "stratum"]
    acc = pred.where(F.col("model").isin(treated, control, "base") & F.col("retrieval").isin("oracle", "none"))
    diffs = interaction_pairs(pred, treated, control)
    if strata is not None:
        acc, diffs = (df.hint("merge").join(strata.select("example_id", *by), "example_id") for df in (acc, diffs))  # never broadcast, as in ``analysis.stratified``
    acc = acc.groupBy(*by, "model", "retrieval").agg(F.avg((F.col("predicted") == F.col("gold")).cast("int")).alias("acc"))

    def at(model: str, retrieval: str) -> Column:
        return F.max(F.when((F.col("model") == model) & (F.col("retrieval") == retrieval), F.col("acc")))

    base = at("base", "oracle") - at("base", "none")
    one = acc.groupBy(*by).agg(
        F.round(at(treated, "oracle") - at(treated, "none") - base, 6).alias("treated_interaction"),
        F.round(at(control, "oracle") - at(control, "none") - base, 6).alias("control_interaction"),
        F.round(cohens_h(at(treated, "oracle"), at(control, "oracle")) - cohens_h(at(treated, "none"), at(control, "none")), 6).alias("effect_size"),
    )
    tested = (grouped_bootstrap(diffs, "diff", *by, resamples=resamples) if by else bootstrap(diffs, "example_id", "diff", resamples)).withColumnRenamed("mean_diff", "difference")
    if by:
        out = one.alias("a").join(tested.alias("b"), _same("a", "b", by)).select(*(F.col(f"a.{c}").alias(c) for c in by), *(c for c in [*one.columns, *tested.columns] if c not in by))
    else:
        out = one.join(F.broadcast(tested))  # single rows
    return out.withColumn("interpretation", F.concat(decision(F.col("p_value"), F.col("difference"), F.col("effect_size")), F.lit(", "), effect_name(F.col("effect_size")), F.lit(" effect")))


def decision(p: Column, difference: Column, h: Column, consistent: Column | None = None) -> Column:
    """strong, moderate or null support; ``consistent``: the share of the other sources with the same direction, where it is known."""
    share = F.lit(1.0) if consistent is None else consistent
    return F.when((p < 0.05) & (difference > 0) & (h > 0.3) & (share >= 1.0), "strong").when((p < 0.10) & (difference > 0) & (share >= 2 / 3), "moderate").otherwise("null")


def four_way(pred: DataFrame, answer: str = "answer") -> Column:
    """"Insufficient evidence" counted as maybe, for accuracy over three labels."""
    return F.when(F.lower(F.col(answer)) == "insufficient evidence", "maybe").otherwise(F.lower(F.col(answer)))


def bonferroni(p: Column, tests: int) -> Column:
    return F.least(F.lit(1.0), p * tests)


def lexical_overlap(reasoning: Column, passages: Column) -> Column:
    """The share of the reasoning's words that the passages' text has; 0 without words."""
    return bound(words(F.lower(reasoning)), lambda r: F.round(held_words(r, words(F.lower(passages))) / F.greatest(F.size(r), F.lit(1)), 6))


# The rational approximation of the error function by Abramowitz and Stegun, 7.1.26, right to 1.5e-7.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: End of fixed values.


def erfc(x: Column) -> Column:
    """The complementary error function of a column that is not negative."""
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for c in reversed(ERF_A):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def power(spark, effects=(3, 5, 8), n: int = 500, seeds: int = 3, simulations: int = 1000, alpha: float = 0.05, base: float = 0.6, seed: int = 42) -> DataFrame:
    """(effect, power, mean_p, false_negative_rate): simulated paired experiments of ``n`` examples and ``seeds`` runs each, tested by the mean difference."""
    one = spark.range(1).select(F.lit(base).alias("base"))
    return power_from(one, "base", effects=effects, n=n, seeds=seeds, simulations=simulations, alpha=alpha, seed=seed)


def power_from(groups: DataFrame, base: str, *by: str, effects=(3, 5, 8), n: int = 500, seeds: int = 3, simulations: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``power`` for each of a few groups (``by``) with its own accuracy ``base`` to start from, as it was measured.

    A draw is the hash of its place in the grid, so the result is the same on any cluster and all groups share the draws; the grid is one range, and only sums of an experiment are shuffled."""
    grid = groups.sparkSession.range(len(effects) * simulations * n).select(F.element_at(F.array(*map(F.lit, effects)), (F.expr(f"id div {simulations * n}") + 1).cast("int")).alias("effect"), F.expr(f"(id div {n}) % {simulations}").alias("sim"), F.expr(f"id % {n}").alias("i"))

    def draw(arm: int, run: int) -> Column:
        return hash_number(F.concat_ws("|", F.lit(seed), "effect", "sim", "i", F.lit(run), F.lit(arm))) / 2.0**32

    drawn = grid.select("effect", "sim", *(draw(arm, r).alias(f"u{arm}_{r}") for arm in range(2) for r in range(seeds)))
    few = groups.agg(F.collect_list(F.struct(*by, F.col(base).cast("double").alias("__base"))).alias("__few"))
    rows = drawn.join(F.broadcast(few)).withColumn("__g", F.explode("__few"))  # one row
    start = F.col("__g.__base")
    d = sum(((F.col(f"u1_{r}") < start + F.col("effect") / 100).cast("int") - (F.col(f"u0_{r}") < start).cast("int") for r in range(seeds)), F.lit(0)) / seeds
    keys = [F.col(f"__g.{c}").alias(c) for c in by]
    each = rows.select(*keys, "effect", "sim", d.alias("d")).groupBy(*by, "effect", "sim").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    z = F.abs("m") / F.greatest(F.col("sd") / math.sqrt(n), F.lit(1e-12))
    tested = each.select(*by, "effect", erfc(z / math.sqrt(2)).alias("p"))
    hit = (F.col("p") < alpha).cast("int")
    return tested.groupBy(*by, "effect").agg(F.round(F.avg(hit), 6).alias("power"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(1 - F.avg(hit), 6).alias("false_negative_rate"))


def mean_std(mean: float, std: float, precision: int = 1) -> str:
    return f"${mean:.{precision}f} \\pm {std:.{precision}f}$"


def mean_std_text(mean: Column, std: Column, precision: int = 1) -> Column:
    return F.format_string(f"$%.{precision}f \\pm %.{precision}f$", mean, std)


def interaction_text(difference: float, low: float, high: float, p: float) -> str:
    """The result of the interaction test as a report prints it."""
    return f"$\\Delta = {difference:.3f}$ (95\\% CI $[{low:.3f}, {high:.3f}]$, {p_text(p)})"


def p_text(p: float) -> str:
    return "$p < 0.001$" if p < 0.001 else f"$p = {p:.{3 if p < 0.01 else 2}f}$"
