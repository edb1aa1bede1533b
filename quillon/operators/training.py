"""Training-set construction: prompts, aligned recipes, work lists with resume and budget, generation, masking."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import answer_label, bracket_citations, citation_count, parse_response, seeded
from quillon.sources.ledger import CallLedger

# Prompts must be byte-identical to what a trained model expects.
BEGIN, END = "<|begin_of_text|>", "<|eot_id|>"
HEADER = "<|start_header_id|>%s<|end_header_id|>\n\n"
DIRECT = "You are a biomedical question answering system. Answer the following question based on your knowledge."
GROUNDED = (
    "You are a biomedical question answering system. Answer the following question based on the provided passages. "
    "Show your reasoning step by step, citing specific passages by their marker (e.g., [P1], [P3]). "
    "If the passages do not contain enough information to answer, respond with 'Insufficient evidence'."
)
#: End of fixed values.

#: Dollars for a million input and output tokens.
INPUT_PRICE, OUTPUT_PRICE = 1.00, 5.00
RECIPES = ("a", "a_prime", "b")


def _prompt(instruction: str, user: Column) -> Column:
    head = BEGIN + HEADER % "system" + instruction + END + HEADER % "user"
    return F.concat(F.lit(head), user, F.lit(END + HEADER % "assistant"))


def passage_block(passages: Column) -> Column:
    """"Passage [P1]: ..." for each passage by position, with blank lines between."""
    ordered = F.array_sort(F.transform(passages, lambda p: F.struct(p["position"], p["text"])))
    return F.array_join(F.transform(ordered, lambda p: F.concat(F.lit("Passage [P"), p["position"].cast("string"), F.lit("]: "), p["text"])), "\n\n")


def recipes(examples: DataFrame, *more: str) -> DataFrame:
    """Three records an example, with its columns ``more``: question to label, question and passages to label, and to reasoning with label.

    The second and third share one prompt, computed once."""
    label = answer_label(F.col("question_type"), F.col("generated_answer"))
    q = F.concat(F.lit("Question: "), F.col("question"))
    rows = examples.select(
        "*",
        _prompt(DIRECT, q).alias("__direct"),
        _prompt(GROUNDED, F.concat(q, F.lit("\n\n"), passage_block(F.col("passages")))).alias("__grounded"),
        F.concat(F.lit("Answer: "), label, F.lit(END)).alias("__label"),
    )
    reasoned = F.concat(bracket_citations(F.col("generated_reasoning")), F.lit("\n\n"), F.col("__label"))
    kept = F.col("gold_disagreement") if "gold_disagreement" in examples.columns else F.lit(None).cast("string")
    meta = F.struct("mode", "question_type", kept.alias("gold_disagreement"), F.col("gold_answer"), "generated_answer")
    three = F.array(*(F.struct(F.lit(n).alias("recipe"), F.col(p).alias("prompt"), t.alias("target")) for n, p, t in zip(RECIPES, ("__direct", "__grounded", "__grounded"), (F.col("__label"), F.col("__label"), reasoned))))
    return rows.select(F.col("question_id").alias("example_id"), meta.alias("metadata"), *more, F.explode(three).alias("r")).select("r.recipe", "example_id", "r.prompt", "r.target", "metadata", *more)


def recipe_stats(records: DataFrame) -> DataFrame:
    """(recipe, n, avg_prompt_chars, avg_target_chars, cited_rate)."""
    return records.groupBy("recipe").agg(F.count("*").alias("n"), F.round(F.avg(F.length("prompt")), 6).alias("avg_prompt_chars"), F.round(F.avg(F.length("target")), 6).alias("avg_target_chars"), F.round(F.avg((citation_count(F.col("target")) > 0).cast("int")), 6).alias("cited_rate"))


def misaligned(records: DataFrame) -> DataFrame:
    """Example ids that lack a recipe, or whose grounded prompts differ; the prompts are compared by SHA-256, so that no text is shuffled."""
    rows = records.groupBy("example_id").agg(F.countDistinct("recipe").alias("n"), F.countDistinct(F.when(F.col("recipe") != "a", F.sha2("prompt", 256))).alias("prompts"))
    return rows.where((F.col("n") != len(RECIPES)) | (F.col("prompts") != 1))


# -- generation ----------------------------------------------------------------------------------------------------------
def cost(inputs: Column, outputs: Column) -> Column:
    return inputs / 1e6 * INPUT_PRICE + outputs / 1e6 * OUTPUT_PRICE


def work_items(questions: DataFrame, done: DataFrame, modes: tuple[str, ...] = ("easy", "hard")) -> DataFrame:
    """(question_id, mode) still to do: every question in every mode, without what is done."""
    every = questions.select("question_id", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return every.join(done.select("question_id", "mode").distinct(), ["question_id", "mode"], "left_anti")


def within_budget(rows: DataFrame, order: str, price: str, dollars: float, most: int | None = None) -> DataFrame:
    """The first rows by ``order`` for which the cost before them is under ``dollars``, and at most ``most`` of them.

    A running sum over range partitions: sums by partition, their running total, and a window within each partition."""
    spread = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    from quillon.session import materialise

    spread = materialise(spread, "budget")
    sums = spread.groupBy("__part").agg(F.sum(price).alias("s"), F.count("*").alias("c"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("__c"))
    inside = Window.partitionBy("__part").orderBy(order)
    before = F.coalesce(F.sum(price).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("__s")
    out = spread.join(F.broadcast(sums), "__part").withColumn("spent_before", before).withColumn("__nth", F.row_number().over(inside) + F.col("__c"))
    keep = F.col("spent_before") < dollars
    return out.where(keep if most is None else keep & (F.col("__nth") <= most)).drop("__part", "__s", "__c", "__nth")


def cost_summary(rows: DataFrame, scale: int = 5000) -> DataFrame:
    """Token and cost totals, the mean, the projection to ``scale`` rows, and a verdict in three bands."""
    out = rows.agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.min("cost_estimate").alias("lo"), F.max("cost_estimate").alias("hi"), F.avg("cost_estimate").alias("mean"))
    projected = F.col("mean") * scale
    verdict = F.when(projected < 10, "under").when(projected < 20, "near").otherwise("over")
    return out.select("n", "input_tokens", "output_tokens", *(F.round(c, 8).alias(f"{c}_cost") for c in ("lo", "hi", "mean")), F.round(projected, 6).alias("projected_cost"), verdict.alias("verdict"))


def arrange(gold: DataFrame, distractors: DataFrame, seed: int = 42) -> DataFrame:
    """(qid, pid, is_gold, position): one seeded gold passage of each query with its distractors, in seeded order."""
    one = gold.groupBy("qid").agg(F.min_by("pid", F.struct(seeded(seed, F.col("qid"), F.col("pid")), F.col("pid"))).alias("pid")).withColumn("is_gold", F.lit(True))
    rows = one.unionByName(distractors.select("qid", "pid").withColumn("is_gold", F.lit(False)))
    w = Window.partitionBy("qid").orderBy(seeded(f"{seed}o", F.col("qid"), F.col("pid")), "pid")
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


ANSWER = "response string, input_tokens int, output_tokens int, status string, error string"


def _answered(out: DataFrame) -> DataFrame:
    reasoning, answer = parse_response(F.col("response"))
    return out.withColumns({"generated_reasoning": reasoning, "generated_answer": answer, "cost_estimate": cost(F.col("input_tokens"), F.col("output_tokens"))})


#: Prompts, and records to tokenise, that a worker holds as Python objects at once (about).
HELD = 256


def _with_answers(prompts: DataFrame, workers: int, answer: Callable[[Callable, list[str], Callable[[str], list]], list[tuple]], factory, batch: int = 1) -> DataFrame:
    """``answer`` gets a client, the prompts of some ``HELD`` rows, a multiple of ``batch``, and a function from a column's name to its values."""
    size = batch * max(1, HELD // batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory()
        for p in (b.slice(a, size) for b in batches for a in range(0, b.num_rows, size)):
            rows = answer(call, p["prompt"].to_pylist(), lambda name: p[name].to_pylist())
            new = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*p.columns, *new], names=[*p.schema.names, *(x.split()[0] for x in ANSWER.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", " + ANSWER
    return _answered(prompts.repartition(workers).mapInArrow(run, schema))


def generate(prompts: DataFrame, factory, workers: int = 10, retries: int = 2, ledger: str | None = None, key: tuple[str, ...] = ("question_id", "mode"), attempt: int = 0) -> DataFrame:
    """``prompts`` (with column prompt) plus generated_reasoning, generated_answer, tokens, cost, status and error.

    ``factory()`` makes a worker's client: a function from a prompt to (text, input tokens, output tokens). A connection or time fault is tried again; a call that
    still fails gives a row with status error, never a failed job. ``workers`` bounds the calls at a time. With the path of a ``ledger`` each answer is kept there, under ``key`` and ``attempt``, as soon
    as it is there, and a call whose answer the ledger has is not made: a task that is run again pays for no call twice. Errors are not kept."""

    def called(call, prompt: str) -> tuple:
        for left in range(retries, -1, -1):
            try:
                return (*call(prompt), "success", None)
            except (ConnectionError, TimeoutError) as e:
                if not left:
                    return None, 0, 0, "error", str(e)
            except Exception as e:  # the row says so
                return None, 0, 0, "error", str(e)

    def answer(call, texts: list[str], column: Callable[[str], list]) -> list[tuple]:
        if ledger is None:
            return [called(call, prompt) for prompt in texts]
        kept, rows = CallLedger(ledger), []
        for prompt, *parts in zip(texts, *(column(k) for k in key)):
            digest = kept.digest((*parts, attempt))
            row = kept.get(digest)
            if row is None:
                row = called(call, prompt)
                if row[3] == "success":
                    kept.put(digest, list(row))
            rows.append(tuple(row))
        return rows

    return _with_answers(prompts, workers, answer, factory)


def generate_batches(prompts: DataFrame, factory, batch: int = 8, workers: int = 10) -> DataFrame:
    """As ``generate``, for a model that answers a list of prompts at once: ``factory()`` makes a function from at most ``batch`` prompts to as many
    (text, input tokens, output tokens)."""

    def answer(call, texts: list[str], column: Callable[[str], list]) -> list[tuple]:
        rows = []
        for a in range(0, len(texts), batch):
            some = texts[a : a + batch]
            try:
                rows += [(*x, "success", None) for x in call(some)]
            except Exception as e:  # the rows say so
                rows += [(None, 0, 0, "error", str(e))] * len(some)
        return rows

    return _with_answers(prompts, workers, answer, factory, batch)


def masked_labels(ids: Column, prompt_length: Column) -> Column:
    """The token ids with those of the prompt replaced by -100; never longer than the ids."""
    p = F.least(prompt_length, F.size(ids))
    return F.concat(F.array_repeat(F.lit(-100), p), F.slice(ids, p + 1, F.greatest(F.size(ids) - p, F.lit(0))))


def tokenised(records: DataFrame, factory, max_length: int) -> DataFrame:
    """input_ids, attention_mask and labels from prompt + target; ``factory()`` makes a worker's tokenizer: text to list of ids.

    Ids are made and given back for some dozens of records at a time: whole prompts have many."""

    size = max(1, HELD // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = factory()
        for b in (batch.slice(a, size) for batch in batches for a in range(0, batch.num_rows, size)):
            prompts, targets = b["prompt"].to_pylist(), b["target"].to_pylist()
            ids = pa.array([encode(p + t)[:max_length] for p, t in zip(prompts, targets)], pa.list_(pa.int32()))
            lengths = pa.array([min(len(encode(p)), max_length) for p in prompts], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, ids, lengths], names=[*b.schema.names, "input_ids", "__p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", input_ids array<int>, __p int"
    out = records.mapInArrow(run, schema)
    return out.withColumn("labels", masked_labels(F.col("input_ids"), F.col("__p"))).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).drop("__p")
