"""Named queries over the driver tables, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import analysis, audit, corpus, evaluation, pruned, quality, retrieval, splits, statistics, training
from quillon.plans.fixtures import EX, GOLD, KNN, PRED, QUERIES as Q_SQL, corpus as passages, examples, gold, predictions, queries, retrieved, retrieved_text, sql_words, vectors, with_passages
from quillon.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from quillon.session import materialise, table

STRIP = r"regexp_replace(regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ''), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


# -- retrieval -----------------------------------------------------------------------------------------------------------
@query("knn_top20", f"with {KNN} select qid, pid, rank, score from knn")
def knn_top20(spark, d):
    return retrieved(spark, d)


@query("knn_pruned", f"with {KNN} select qid, pid, rank, score from knn")
def knn_pruned(spark, d):
    """The same rows by blocks with bounds: no block that can't hold one of the best is scored."""
    blocks = pruned.Blocks(vectors(spark, d).select("pid", "embedding"))
    return pruned.nearest_pruned(queries(spark, d).select("qid", "embedding"), blocks, 20, exclude_same=True)[0].select("qid", "pid", "rank", "score")


@query("retrieve_left_text", f"with {KNN} select qid, pid, rank, length(coalesce(text, '')) as n_chars, coalesce(source, '') as source from knn left join documents on doc_id = pid")
def retrieve_left_text(spark, d):
    return retrieved_text(spark, d).select("qid", "pid", "rank", F.length("text").cast("long").alias("n_chars"), "source")


RERANK = f"""{Q_SQL}, {KNN}, rr as (select *, row_number() over (partition by qid order by rerank_score desc, dense_rank) as rank from (
  select knn.qid, pid, knn.rank as dense_rank, score as dense_score,
    round(len(list_intersect(list_distinct({sql_words("lower(question)")}), list_distinct({sql_words("lower(d.text)")})))
      / greatest(len(list_distinct({sql_words("lower(question)")})), 1)::double, 9) as rerank_score
  from knn join q on q.qid = knn.qid left join documents d on d.doc_id = pid))"""


def _reranked(spark, d, k=5):
    return retrieval.lexical_rerank(retrieved(spark, d), queries(spark, d), passages(spark, d), k)


@query("rerank_top5", f"with {RERANK} select qid, pid, rank, dense_rank, dense_score, rerank_score from rr where rank <= 5")
def rerank_top5(spark, d):
    return _reranked(spark, d).select("qid", "pid", "rank", "dense_rank", "dense_score", "rerank_score")


ORACLE = f"""{GOLD}, {RERANK}, g as (select qid, pid, row_number() over (partition by qid order by pos) as rank from gold where pid in (select doc_id from documents)),
c as (select qid, count(*) as n from g group by qid),
pad as (select rr.qid, rr.pid, coalesce(n, 0) + row_number() over (partition by rr.qid order by rr.rank) as rank from rr left join c on c.qid = rr.qid
  where not exists (select 1 from gold where gold.qid = rr.qid and gold.pid = rr.pid)),
orc as (select qid, pid, rank, true as is_gold from g where rank <= 5 union all select qid, pid, rank, false from pad where rank <= 5)"""


@query("oracle_top5", f"with {ORACLE} select qid, pid, rank, is_gold from orc")
def oracle_top5(spark, d):
    ranked = _reranked(spark, d, 20).withColumnRenamed("dense_score", "score")
    return retrieval.oracle(gold(spark, d), passages(spark, d), ranked).select("qid", "pid", "rank", "is_gold")


@query("none_condition", "select vec_id as qid, 0::bigint as n_passages from embeddings where vec_id % 5 = 0")
def none_condition(spark, d):
    return retrieval.closed_book(queries(spark, d)).select("qid", "n_passages")


for _mode, _need in (("easy", 4), ("hard", 5)):
    query(
        f"distractors_{_mode}",
        f"""with {GOLD}, {RERANK}, r as (select qid, pid, row_number() over (partition by qid order by rank) as position from rr
        where not exists (select 1 from gold where gold.qid = rr.qid and gold.pid = rr.pid)), t as (select *, count(*) over (partition by qid) as n from r where position <= {_need})
        select distinct qid, case when n >= {_need} then pid end as pid, case when n >= {_need} then position else 0 end as position from t""",
    )(lambda spark, d, mode=_mode: retrieval.distractors(_reranked(spark, d, 20), gold(spark, d), mode))


# -- evaluation ----------------------------------------------------------------------------------------------------------
METRICS = f"""{RERANK}, {GOLD},
n as (select qid, count(*) as n_gold from gold group by qid),
h as (select rr.qid, count(*) as n_hit, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from rr join gold on gold.qid = rr.qid and gold.pid = rr.pid where rank <= 5 group by rr.qid),
len as (select gold.qid, avg(len({sql_words("text")})) as words from gold join documents on doc_id = gold.pid group by gold.qid),
m0 as (select n.qid, n_gold, answer, coalesce(nullif(question_type, ''), 'unknown') as question_type, coalesce(words, 0) as words,
  case when n_hit > 0 then 1.0 else 0.0 end as hit, coalesce(n_hit, 0) / n_gold as recall, coalesce(1.0 / first, 0) as mrr,
  coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1 / log2(i + 1))) as ndcg,
  case when n_gold <= 5 then 'low (1-5)' when n_gold <= 10 then 'medium (6-10)' else 'high (11+)' end as n_gold_bucket
  from n join q on q.qid = n.qid left join h on h.qid = n.qid left join len on len.qid = n.qid),
m as (select *, case when r <= c // 3 then 'short' when r <= 2 * (c // 3) then 'medium' else 'long' end as tercile
  from (select *, row_number() over (order by words, qid) as r, count(*) over () as c from m0))"""
FIGURES = "round(avg(hit), 6) as hit_5, round(avg(recall), 6) as recall_5, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg_5, count(*) as n"


def _metrics(spark, d):
    asked, wanted = queries(spark, d), gold(spark, d)
    per = evaluation.query_metrics(_reranked(spark, d), wanted)
    counted = wanted.join(passages(spark, d).select(F.col("id").alias("pid"), T.word_count(F.col("text")).alias("w")), "pid").groupBy("qid").agg(F.avg("w").alias("words"))
    rows = per.join(asked.select("qid", "answer", "question_type"), "qid").join(counted, "qid", "left").withColumn("words", F.coalesce("words", F.lit(0.0)))
    rows = rows.withColumn("question_type", F.coalesce(F.nullif("question_type", F.lit("")), F.lit("unknown"))).withColumn("n_gold_bucket", evaluation.gold_bucket(F.col("n_gold")))
    return evaluation.length_terciles(materialise(rows, "metrics"), "words", "qid")


@query("retrieval_eval_overall", f"with {METRICS} select {FIGURES} from m")
def retrieval_eval_overall(spark, d):
    return evaluation.overall(evaluation.query_metrics(_reranked(spark, d), gold(spark, d)))


@query("retrieval_eval_by_answer", f"with {METRICS} select answer as stratum, {FIGURES} from m group by answer")
def retrieval_eval_by_answer(spark, d):
    return evaluation.by(_metrics(spark, d), "answer")


@query("retrieval_eval_by_question_type", f"with {METRICS} select question_type as stratum, {FIGURES} from m group by question_type")
def retrieval_eval_by_question_type(spark, d):
    return evaluation.by(_metrics(spark, d), "question_type")


@query("retrieval_eval_by_length_tercile", f"with {METRICS} select tercile as stratum, {FIGURES}, min(words)::double as range_low, max(words)::double as range_high from m group by tercile")
def retrieval_eval_by_length_tercile(spark, d):
    return evaluation.by(_metrics(spark, d), "tercile", value="words")


@query("retrieval_eval_by_n_gold", f"with {METRICS} select stratum, coalesce(hit_5, 0) as hit_5, coalesce(recall_5, 0) as recall_5, coalesce(mrr, 0) as mrr, coalesce(ndcg_5, 0) as ndcg_5, coalesce(n, 0) as n, coalesce(range_low, 0)::double as range_low, coalesce(range_high, 0)::double as range_high from (values ('low (1-5)'), ('medium (6-10)'), ('high (11+)')) s(stratum) left join (select n_gold_bucket, {FIGURES}, min(n_gold) as range_low, max(n_gold) as range_high from m group by n_gold_bucket) on n_gold_bucket = stratum")
def retrieval_eval_by_n_gold(spark, d):
    return evaluation.by_n_gold(_metrics(spark, d))


_STRATA = ["answer", "tercile", "question_type", "n_gold_bucket"]


@query("retrieval_eval_grouping_sets", f"with {METRICS} select 'overall' as kind, 'all' as stratum, {FIGURES} from m " + " ".join(f"union all select '{c}', {c}, {FIGURES} from m group by {c}" for c in _STRATA))
def retrieval_eval_grouping_sets(spark, d):
    return evaluation.all_strata(_metrics(spark, d), _STRATA)


# -- corpus and audits ---------------------------------------------------------------------------------------------------
@query(
    "corpus_union_dedup",
    f"""with u as (select doc_id::varchar as id, text, source, 0 as part, doc_id as ord from documents union all select 'bench_' || item_id, text, 'benchmark', 1, item_id from benchmark)
    select id, source, length(text) as n_chars from (select *, row_number() over (partition by lower({_strip("text")}) order by part, ord) as r from u) where r = 1""",
)
def corpus_union_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.col("doc_id").alias("ord"))
    bench = table(spark, d, "benchmark").select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("id"), "text", F.lit("benchmark").alias("source"), F.col("item_id").alias("ord"))
    return corpus.build_corpus(docs, bench).select("id", "source", F.length("text").cast("long").alias("n_chars"))


@query(
    "corpus_stats",
    f"""with w as (select len({sql_words("text")})::bigint as n from documents), s as (select list_sort(list(n)) as l, count(*) as c from w)
    select c as n_passages, l[1] as min_words, l[c] as max_words, round(list_avg(l), 6) as mean_words, l[c // 4 + 1] as p25_words, l[c // 2 + 1] as median_words, l[3 * c // 4 + 1] as p75_words from s""",
)
def corpus_stats(spark, d):
    return corpus.corpus_stats(table(spark, d, "documents"))


query("label_distribution", "select quality, toxic, count(*) as n from labels group by quality, toxic")(lambda spark, d: audit.distribution(table(spark, d, "labels"), "quality", "toxic"))
query("source_distribution", "select source, count(*) as n from documents group by source")(lambda spark, d: audit.distribution(table(spark, d, "documents"), "source"))


@query(
    "per_source_stats",
    f"""with w as (select source, lang, len({sql_words("text")}) as n from documents)
    select 'all' as level, null as grp, count(*) as n_rows, count(distinct coalesce(lang, '')) as n_distinct, round(avg(n), 6) as mean_words from w
    union all select 'group', source, count(*), count(distinct coalesce(lang, '')), round(avg(n), 6) from w group by source""",
)
def per_source_stats(spark, d):
    return corpus.per_source_stats(table(spark, d, "documents"), "source", "lang", "text")


@query("length_audit", f"select lang, count(*) as n, min(len({sql_words('text')}))::bigint as min_words, max(len({sql_words('text')}))::bigint as max_words, round(avg(len({sql_words('text')})), 6) as mean_words from documents group by lang")
def length_audit(spark, d):
    return audit.length_table(table(spark, d, "documents"), "text", "lang")


@query("contamination_gold", "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def contamination_gold(spark, d):
    """Benchmark items found word for word."""
    return audit.containing(table(spark, d, "documents"), table(spark, d, "benchmark"))


# -- splits --------------------------------------------------------------------------------------------------------------
RANK = "row_number() over (partition by {by} order by md5('{seed}|' || doc_id), doc_id)"


@query("permutation_split", f"select doc_id, case when r <= 50 then 'dev' when r <= 150 then 'test' else 'train' end as split from (select doc_id, {RANK.format(by='1', seed=42)} as r from documents)")
def permutation_split(spark, d):
    return splits.permutation_split(table(spark, d, "documents").select("doc_id"), "doc_id", 42, {"dev": 50, "test": 100}, "train")


@query(
    "stratified_split",
    f"""with {EX}, p as (select avg((question_type = 'factoid')::int) as p from ex),
    r as (select question_id, question_type, row_number() over (partition by question_type order by md5('42|' || question_id), question_id) as r from ex)
    select question_id, question_type, case when r <= t then 'test' when r <= t + v then 'dev' else 'train' end as split from (
      select r.*, case when question_type = 'factoid' then floor(60 * p)::int else 60 - floor(60 * p)::int end as t, case when question_type = 'factoid' then floor(30 * p)::int else 30 - floor(30 * p)::int end as v from r, p)""",
)
def stratified_split(spark, d):
    return splits.stratified_split(examples(spark, d).select("question_id", "question_type"), "question_id", "question_type", "factoid", 42, 60, 30)


@query(
    "quota_subset",
    f"""with r as (select doc_id, lang, {RANK.format(by="lang", seed=7)} as r from documents), m as (select greatest(120 - sum(n), 0) as missing from (select least(count(*), 25) as n from documents group by lang))
    select doc_id, lang, row_number() over (order by md5('7o|' || doc_id), doc_id) as position from r, m where r <= 25 + case when lang = 'en' then missing else 0 end""",
)
def quota_subset(spark, d):
    return splits.quota_subset(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 7, 25, 120, "en")


@query("sample_k", f"select doc_id from (select doc_id, {RANK.format(by='1', seed=3)} as r from documents) where r <= 50")
def sample_k(spark, d):
    return splits.least(table(spark, d, "documents").select("doc_id"), "doc_id", 3, 50)


@query("split_overlap_intersect", "select distinct text from documents intersect select text from benchmark")
def split_overlap_intersect(spark, d):
    return table(spark, d, "documents").select("text").intersect(table(spark, d, "benchmark").select("text"))


query("split_semi", "select distinct doc_id from documents where doc_id in (select doc_id from labels)")(lambda spark, d: splits.overlap(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id"))
query("split_anti", "select doc_id from documents where doc_id not in (select doc_id from labels)")(lambda spark, d: table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti"))


@query("test_hash", """select sha256('[' || string_agg('{"doc_id": "' || doc_id || '", "quality": "' || quality || '"}', ', ' order by doc_id::varchar) || ']') as hash, count(*) as size from labels""")
def test_hash(spark, d):
    return splits.test_hash(table(spark, d, "labels"), "doc_id", "doc_id", "quality")


# -- filters -------------------------------------------------------------------------------------------------------------
CITED = r"(regexp_matches(coalesce(generated_reasoning, ''), '\[P[1-5]') or regexp_matches(coalesce(generated_reasoning, ''), '(^|[^\p{L}\p{N}_])P[1-5]($|[^\p{L}\p{N}_])'))"
N_WORDS, N_ANSWER = f"len({sql_words('generated_reasoning')})", f"len({sql_words('generated_answer')})"
INSUFFICIENT = "contains(lower(coalesce(generated_answer, '')), 'insufficient evidence')"
A, G = "coalesce(generated_answer, '')", "gold_answer"
BAD = r"list_filter(regexp_extract_all(coalesce(generated_reasoning, ''), '\[P([0-9]+)\]', 1), lambda c: not regexp_full_match(c, '0*[1-5]'))[1]"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_NUM = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.NUMBER_WORDS.items()) + "}"


def _tokens(x: str) -> str:
    plain = rf"regexp_replace(lower(coalesce({x}, '')), '[^\w\s]', ' ', 'g')"
    kept = f"list_filter({sql_words(plain)}, lambda w: not list_contains({_STOP}, w))"
    return f"list_filter(list_transform({kept}, lambda w: coalesce({_NUM}[w], w)), lambda w: length(w) > 1 or regexp_full_match(w, '[0-9]'))"


OVERLAP = f"list_has_any({_tokens('generated_answer')}, {_tokens('gold_answer')})"
VERSUS = f"'generated=''' || {A} || ''' vs gold=''' || {G} || ''''"
# The messages of the filters, which results depend on.
REASONS = {
    "format": "case when generated_reasoning is null or generated_answer is null then 'Missing reasoning or answer fields' end",
    "citations": f"case when not ({INSUFFICIENT} or {CITED}) then 'No valid citations found in reasoning' end",
    "citation_validity": f"'Invalid citation [P' || {BAD} || '] (must be P1-P5)'",
    "reasoning_length": f"case when {N_WORDS} < 20 then 'Reasoning too short (' || {N_WORDS} || ' words, need ≥20)' when {N_WORDS} > 200 then 'Reasoning too long (' || {N_WORDS} || ' words, need ≤200)' end",
    "answer_format": f"""case when {A} = '' then 'Empty answer' when question_type = 'yesno' and lower({A}) not in ('yes', 'no', 'maybe', 'insufficient evidence') then 'Invalid yes/no answer: ''' || {A} || ''''
      when question_type = 'factoid' and {N_ANSWER} > 30 then 'Factoid answer too long (' || {N_ANSWER} || ' words, need ≤30)' end""",
    "gold_answer_agreement": f"""case when {A} = '' or {G} = '' then 'Missing generated or gold answer' when {INSUFFICIENT} then null
      when question_type = 'yesno' and lower({A}) = 'maybe' then case when {CITED} then null else 'Maybe answer without citations: generated=''' || {A} || '''' end
      when question_type = 'yesno' then case when lower({A}) <> lower({G}) then 'Yes/no mismatch: ' || {VERSUS} end
      when not {OVERLAP} then 'Factoid mismatch: ' || {VERSUS} end""",
}
#: End of fixed values.
FILTERED = f"{EX}, rs as (select *, " + ", ".join(f"{sql} as r_{n}" for n, sql in REASONS.items()) + " from ex), fl as (select *, coalesce(" + ", ".join(f"r_{n}" for n in REASONS) + ") is null as filter_passed, case " + " ".join(f"when r_{n} is not null then '{n}'" for n in REASONS) + " end as filter_failed_at, coalesce(" + ", ".join(f"r_{n}" for n in REASONS) + ") as filter_failure_reason from rs)"

for _name in quality.NAMES:
    query(f"filter_{_name}", f"with {EX} select question_id, {REASONS[_name]} as reason from ex")(lambda spark, d, name=_name: examples(spark, d).select("question_id", quality.reasons(ascii_only=True)[name].alias("reason")))


def _filtered(spark, d):
    return quality.apply_filters(examples(spark, d), ascii_only=True)


@query(
    "filter_cascade",
    f"""with {FILTERED} select question_id, filter_passed, filter_failed_at, filter_failure_reason,
    case when filter_passed and question_type = 'yesno' and lower({A}) = 'maybe' and {CITED} and lower({G}) in ('yes', 'no') then 'model_hedged_' || lower({G}) end as gold_disagreement from fl""",
)
def filter_cascade(spark, d):
    return _filtered(spark, d).select("question_id", "filter_passed", "filter_failed_at", "filter_failure_reason", "gold_disagreement")


@query("filter_cascade_unicode", f"with {FILTERED} select question_id, filter_passed, filter_failed_at from fl")
def filter_cascade_unicode(spark, d):
    """The cascade with the full decomposition of factoid answers; ``factoid_tokens`` has it on text with accents."""
    return quality.apply_filters(examples(spark, d)).select("question_id", "filter_passed", "filter_failed_at")


_NAMES_SQL = ", ".join(f"('{n}')" for n in quality.NAMES)
query("filter_rejections", f"with {FILTERED} select filter, count(filter_failed_at) as n from (values {_NAMES_SQL}) v(filter) left join fl on filter = filter_failed_at group by filter")(lambda spark, d: quality.rejections(_filtered(spark, d)))
_RATE = "count(*) as total, count_if(filter_passed)::bigint as passed, round(avg(filter_passed::int), 6) as rate from fl"
query("pass_rates", f"with {FILTERED} select 'overall' as kind, 'all' as value, {_RATE} union all select 'mode', mode, {_RATE} group by mode union all select 'question_type', question_type, {_RATE} group by question_type")(lambda spark, d: quality.pass_rates(_filtered(spark, d)))
query("insufficient_crosstab", f"with {EX} select mode, count_if(question_type = 'factoid')::bigint as factoid, count_if(question_type = 'yesno')::bigint as yesno, count_if(question_type is null)::bigint as unknown, count(*) as total from ex where {INSUFFICIENT} group by mode")(lambda spark, d: quality.crosstab(examples(spark, d).where(F.lower("generated_answer").contains("insufficient evidence"))))
query("type_pivot", f"with {EX} select mode, count_if(question_type = 'factoid')::bigint as factoid, count_if(question_type = 'yesno')::bigint as yesno, count_if(question_type is null)::bigint as unknown, count(*) as total from ex group by mode")(lambda spark, d: quality.crosstab(examples(spark, d)))
query(
    "citation_histogram",
    rf"""with {FILTERED}, c as (select len(regexp_extract_all(generated_reasoning, '\[P[0-9]\]'))::bigint as n_citations, count(*) as n from fl where filter_passed group by 1)
    select n_citations, case when n_citations >= 3 then '3+' when n_citations > 0 then n_citations::varchar else 'none' end as bucket, n, round(n / sum(n) over (), 6) as share from c""",
)(lambda spark, d: quality.citation_histogram(_filtered(spark, d)))
query("gold_answer_share", f"with {EX} select gold_answer as value, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from ex where {INSUFFICIENT} group by gold_answer")(lambda spark, d: quality.shares(examples(spark, d).where(F.lower("generated_answer").contains("insufficient evidence")), "gold_answer"))
query("factoid_overlap", f"with {EX} select question_id, {OVERLAP} as overlap from ex where question_type = 'factoid' and generated_answer is not null")(lambda spark, d: examples(spark, d).where("question_type = 'factoid' and generated_answer is not null").select("question_id", T.factoid_overlap(F.col("generated_answer"), F.col("gold_answer"), True).alias("overlap")))

# -- text ----------------------------------------------------------------------------------------------------------------
RESPONSE = "case when question_id % 3 = 0 then 'Reasoning: ' || generated_reasoning || ' ' || chr(10) || chr(10) || 'Answer: ' || generated_answer when question_id % 3 = 1 then generated_reasoning || ' Answer: ' || generated_answer || ' Answer: x' else generated_reasoning end"


@query(
    "parse_response",
    f"""with {EX}, t as (select question_id, {RESPONSE} as t from ex where generated_reasoning is not null), p as (select question_id, t, position('Answer:' in t) as place from t),
    s as (select question_id, case when place > 0 then {_strip("substr(t, 1, place - 1)")} end as r, case when place > 0 then {_strip("substr(t, place + 7)")} end as answer from p)
    select question_id, case when starts_with(r, 'Reasoning:') then {_strip("substr(r, 11)")} else r end as reasoning, answer from s""",
)
def parse_response(spark, d):
    rows = examples(spark, d).where("generated_reasoning is not null").select("question_id", F.expr(RESPONSE.replace("chr(10)", "'\\n'")).alias("t"))
    r, a = T.parse_response(F.col("t"))
    return rows.select("question_id", r.alias("reasoning"), a.alias("answer"))


@query(
    "citation_variants",
    rf"""with {EX} select question_id, len(regexp_extract_all(generated_reasoning, '\[P[1-5]\]'))::bigint as valid, len(regexp_extract_all(generated_reasoning, '\[P[0-9]\]'))::bigint as digit,
    array_to_string(regexp_extract_all(generated_reasoning, '\[P([0-9]+)\]', 1), ',') as numbers, {CITED} as cited from ex where generated_reasoning is not null""",
)
def citation_variants(spark, d):
    r = F.col("generated_reasoning")
    return examples(spark, d).where(r.isNotNull()).select("question_id", T.citation_count(r).cast("long").alias("valid"), T.citation_count(r, "[0-9]").cast("long").alias("digit"), F.array_join(T.citation_numbers(r), ",").alias("numbers"), T.is_cited(r).alias("cited"))


# without lookaround in SQL: bare markers stand for themselves there, as the fixture has none next to a bracket but in groups
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(generated_reasoning, '(^|[^\p{L}\p{N}_\[])P([1-5])($|[^\p{L}\p{N}_\]])', '\1[P\2]\3', 'g'), '\x01', '', 'g'), '\x02', '', 'g')"


@query("normalize_citations", f"with {EX} select question_id, {NORMAL} as reasoning from ex where generated_reasoning is not null")
def normalize_citations(spark, d):
    return examples(spark, d).where("generated_reasoning is not null").select("question_id", T.bracket_citations(F.col("generated_reasoning")).alias("reasoning"))


# -- training sets -------------------------------------------------------------------------------------------------------
def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_prompt(instruction: str, user: str) -> str:
    return _sql_text(training.BEGIN + training.HEADER % "system" + instruction + training.END + training.HEADER % "user") + f" || {user} || " + _sql_text(training.END + training.HEADER % "assistant")


_LABEL = f"'Answer: ' || case when question_type = 'yesno' then lower(generated_answer) else generated_answer end || '{training.END}'"
_BLOCK = "array_to_string(list_transform(range(0, 5), lambda i: 'Passage [P' || (i + 1) || ']: ' || x.ts[i + 1]), chr(10) || chr(10))"
PASSAGES = "pt as (select ex.question_id, list(d.text order by i) as ts from ex, range(0, 5) r(i), documents d where d.doc_id = (ex.question_id + i) % (select count(*) from documents) group by ex.question_id)"
RECORDS = f"""{EX}, {PASSAGES}, rec as (select ex.question_id as example_id, n.recipe,
  case when n.recipe = 'a' then {_sql_prompt(training.DIRECT, "'Question: ' || question")} else {_sql_prompt(training.GROUNDED, f"'Question: ' || question || chr(10) || chr(10) || {_BLOCK}")} end as prompt,
  case when n.recipe = 'b' then {NORMAL} || chr(10) || chr(10) || {_LABEL} else {_LABEL} end as target
  from ex join pt x on x.question_id = ex.question_id, (values ('a'), ('a_prime'), ('b')) n(recipe) where generated_reasoning is not null)"""


def _records(spark, d):
    return training.recipes(with_passages(examples(spark, d).where("generated_reasoning is not null"), spark, d))


for _recipe in training.RECIPES:
    query(f"materialize_{_recipe}", f"with {RECORDS} select example_id, prompt, target from rec where recipe = '{_recipe}'")(lambda spark, d, r=_recipe: _records(spark, d).where(F.col("recipe") == r).select("example_id", "prompt", "target"))
query("ablation_check", f"with {RECORDS} select example_id, count(distinct recipe) as n, count(distinct case when recipe <> 'a' then prompt end) as prompts from rec group by example_id having n <> 3 or prompts <> 1")(lambda spark, d: training.misaligned(_records(spark, d)))
query("materialize_stats", rf"with {RECORDS} select recipe, count(*) as n, round(avg(length(prompt)), 6) as avg_prompt_chars, round(avg(length(target)), 6) as avg_target_chars, round(avg(regexp_matches(target, '\[P[1-5]\]')::int), 6) as cited_rate from rec group by recipe")(lambda spark, d: training.recipe_stats(_records(spark, d)))

COST = "(input_tokens / 1e6::double * 1.0 + output_tokens / 1e6::double * 5.0)"


def _priced(spark, d):
    return examples(spark, d).withColumn("cost_estimate", training.cost(F.col("input_tokens"), F.col("output_tokens")))


query(
    "cost_summary",
    f"""with {EX}, c as (select *, {COST} as c from ex) select count(*) as n, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(min(c), 8) as lo_cost, round(max(c), 8) as hi_cost,
    round(avg(c), 8) as mean_cost, round(avg(c) * 5000, 6) as projected_cost, case when avg(c) * 5000 < 10 then 'under' when avg(c) * 5000 < 20 then 'near' else 'over' end as verdict from c""",
)(lambda spark, d: training.cost_summary(_priced(spark, d)))
query(
    "budget_cutoff",
    f"""with {EX}, c as (select question_id, {COST} as c from ex), b as (select *, coalesce(sum(c) over (order by question_id rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (order by question_id) as r from c)
    select question_id, round(before, 6) as spent_before from b where before < 0.35 and r <= 900""",
)(lambda spark, d: training.within_budget(_priced(spark, d).select("question_id", "cost_estimate"), "question_id", "cost_estimate", 0.35, 900).select("question_id", F.round("spent_before", 6).alias("spent_before")))
_DONE = "question_id % 3 = 0"
query("work_items", f"with {EX} select question_id, m.mode from ex, (values ('easy'), ('hard')) m(mode)")(lambda spark, d: training.work_items(examples(spark, d), examples(spark, d).where("false")))
query("resume_anti", f"with {EX} select question_id, m.mode from ex, (values ('easy'), ('hard')) m(mode) where not ({_DONE} and ex.mode = m.mode)")(lambda spark, d: training.work_items(examples(spark, d), examples(spark, d).where(_DONE)))


@query(
    "mcq_options",
    """with x as (select doc_id, [lang, source, doc_id::varchar, text] as w, doc_id % 6 as cop from documents)
    select 'medmcqa_' || doc_id as id, (['A','B','C','D'])[cop + 1] as answer, list_transform(range(1, 5), lambda i: coalesce(w[i], ''))::varchar[] as texts from x where cop between 0 and 3""",
)
def mcq_options(spark, d):
    from quillon.sources.questions import choice_columns

    w = F.array("lang", "source", F.col("doc_id").cast("string"), "text")
    raw = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), *(F.get(w, i).alias(c) for i, c in enumerate(("opa", "opb", "opc", "opd"))), F.expr("int(doc_id % 6)").alias("cop"), F.lit("s").alias("subject_name"))
    return choice_columns(raw).select("id", "answer", F.transform("options", lambda o: o["text"]).alias("texts"))


@query("masked_labels", f"with {EX} select question_id, list_sum(list_transform(range(0, 8), lambda i: case when i < least(question_id % 12, 8) then -100 else i end))::bigint as total from ex")
def masked_labels(spark, d):
    ids = F.array(*map(F.lit, range(8)))
    return examples(spark, d).select("question_id", F.aggregate(training.masked_labels(ids, F.expr("int(question_id % 12)")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# -- statistics ----------------------------------------------------------------------------------------------------------
CELL = "model, retrieval, seed"
OK = "(predicted = gold)::int"
query("accuracy_cells", f"with {PRED} select {CELL}, count(*) as n, round(avg({OK}), 6) as accuracy from pred group by {CELL}")(lambda spark, d: statistics.accuracy(predictions(spark, d), *statistics.CELL))
CLASSES = f"""cl as (select {CELL}, label, count(*) filter (where gold = label) as n_gold, count(*) filter (where predicted = label) as n_predicted, count(*) filter (where predicted = label and gold = label) as tp
  from pred, (values ('yes'), ('no'), ('maybe')) l(label) where predicted = label or gold = label group by {CELL}, label),
pc as (select {CELL}, label, n_gold, round(case when n_predicted > 0 then tp / n_predicted else 0 end, 6) as precision, round(case when n_gold > 0 then tp / n_gold else 0 end, 6) as recall, round(2 * tp / (n_predicted + n_gold), 6) as f1 from cl)"""
query("per_class", f"with {PRED}, {CLASSES} select * from pc")(lambda spark, d: statistics.per_class(predictions(spark, d), *statistics.CELL))
query("macro_f1", f"with {PRED}, {CLASSES} select {CELL}, round(avg(f1), 6) as macro_f1 from pc group by {CELL}")(lambda spark, d: statistics.macro_f1(predictions(spark, d), *statistics.CELL))
query("ece", f"with {PRED}, b as (select {CELL}, greatest(1, ceil(confidence * 10)) as bin, count(*) as n, avg({OK}) as acc, avg(confidence) as conf from pred group by all) select {CELL}, round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from b group by {CELL}")(lambda spark, d: statistics.calibration_error(predictions(spark, d), *statistics.CELL))
BY_MODEL = f"bm as (select model, retrieval, avg({OK}) as acc from pred group by model, retrieval)"


@query("cohens_h", f"with {PRED}, {BY_MODEL} select a.model, a.retrieval, round(2 * asin(sqrt(a.acc)) - 2 * asin(sqrt(b.acc)), 6) as h from bm a join bm b on a.retrieval = b.retrieval and b.model = 'base' where a.model <> 'base'")
def cohens_h(spark, d):
    acc = predictions(spark, d).groupBy("model", "retrieval").agg(F.avg((F.col("predicted") == F.col("gold")).cast("int")).alias("acc"))
    base = acc.where("model = 'base'").select("retrieval", F.col("acc").alias("b"))
    return acc.where("model <> 'base'").join(base, "retrieval").select("model", "retrieval", F.round(statistics.cohens_h(F.col("acc"), F.col("b")), 6).alias("h"))


SEEDED = f"sd as (select {CELL}, avg({OK}) as acc from pred group by {CELL})"
query("seed_mean_std", f"with {PRED}, {SEEDED} select model, retrieval, count(*) as n_seeds, round(avg(acc), 6) as mean, round(coalesce(stddev_samp(acc), 0), 6) as std from sd group by model, retrieval")(lambda spark, d: statistics.across_seeds(predictions(spark, d).groupBy(*statistics.CELL).agg(F.avg((F.col("predicted") == F.col("gold")).cast("int")).alias("acc")), "acc", "model", "retrieval"))
query("gain", f"with {PRED}, {SEEDED}, b as (select retrieval, avg(acc) as base from sd where model = 'base' group by retrieval) select model, retrieval, count(*) as n_seeds, round(avg(acc - base), 6) as mean, round(coalesce(stddev_samp(acc - base), 0), 6) as std from sd join b using (retrieval) where model <> 'base' group by model, retrieval")(lambda spark, d: statistics.gains(predictions(spark, d)))
RESAMPLES = 1000


def _bootstrap_sql(pairs: str, order: str = "example_id") -> str:
    return f"""{pairs}, v as (select diff::double as v, row_number() over (order by {order}) - 1 as i from pairs), n as (select count(*) as n from pairs),
    dr as (select b, ('0x' || substr(md5('42|' || b || '|' || d), 1, 8))::bigint % n as i from n, range(0, {RESAMPLES}) x(b), lateral (select unnest(range(0, n.n)) as d)),
    me as (select b, round(sum(v) / any_value(n.n), 9) as m from dr join v using (i), n group by b), s as (select list_sort(list(m)) as ms, avg((m <= 0)::int) as le, avg((m >= 0)::int) as ge from me)
    select round((select avg(v) from v), 6) as mean_diff, round(ms[{int(0.025 * RESAMPLES) + 1}], 6) as ci_lower, round(ms[{min(RESAMPLES - 1, int(0.975 * RESAMPLES)) + 1}], 6) as ci_upper, round(least(1, 2 * least(le, ge)), 6) as p_value from s"""


query(
    "bootstrap_ci",
    f"with {PRED}, " + _bootstrap_sql("pairs as (select a.example_id, (a.predicted = a.gold)::int - (b.predicted = b.gold)::int as diff from pred a join pred b using (example_id) where a.model = 'lora_b' and a.retrieval = 'oracle' and a.seed = 42 and b.model = 'base' and b.retrieval = 'oracle')"),
)(lambda spark, d: statistics.bootstrap(statistics.paired(predictions(spark, d), ("lora_b", "oracle", 42), ("base", "oracle", 42)), "example_id", "diff", RESAMPLES))
query(
    "bootstrap_by_values",
    f"with {PRED}, " + _bootstrap_sql("pairs as (select a.example_id, (a.predicted = a.gold)::int - (b.predicted = b.gold)::int as diff from pred a join pred b using (example_id) where a.model = 'lora_b' and a.retrieval = 'oracle' and a.seed = 42 and b.model = 'base' and b.retrieval = 'oracle')", "diff"),
)(lambda spark, d: statistics.grouped_bootstrap(statistics.paired(predictions(spark, d), ("lora_b", "oracle", 42), ("base", "oracle", 42)), "diff", resamples=RESAMPLES).drop("n"))
query(
    "interaction",
    f"with {PRED}, " + _bootstrap_sql(f"pairs as (select example_id, sum((case model when 'lora_b' then 1 else -1 end) * (case retrieval when 'oracle' then 1 else -1 end) * {OK}) / 3.0 as diff from pred where model in ('lora_b', 'lora_a_prime') and retrieval in ('oracle', 'none') group by example_id)"),
)(lambda spark, d: statistics.bootstrap(statistics.interaction_pairs(predictions(spark, d)), "example_id", "diff", RESAMPLES))
query(
    "three_vs_four_way",
    f"with {EX}, x as (select lower(generated_answer) as a, gold_answer as g from ex where question_type = 'yesno' and generated_answer is not null) select count(*) as n, round(avg((a = g)::int), 6) as four_way, round(avg((case when a = 'insufficient evidence' then 'maybe' else a end = g)::int), 6) as three_way from x",
)(
    lambda spark, d: examples(spark, d)
    .where("question_type = 'yesno' and generated_answer is not null")
    .agg(F.count("*").alias("n"), F.round(F.avg((F.lower("generated_answer") == F.col("gold_answer")).cast("int")), 6).alias("four_way"), F.round(F.avg((statistics.four_way(None, "generated_answer") == F.col("gold_answer")).cast("int")), 6).alias("three_way"))
)
query(
    "lexical_overlap",
    f"with {EX}, x as (select question_id, {sql_words('lower(generated_reasoning)')} as r, list_distinct({sql_words('lower(text)')}) as p from ex join documents on doc_id = question_id where generated_reasoning is not null) select question_id, round(len(list_filter(r, lambda w: list_contains(p, w))) / greatest(len(r), 1)::double, 6) as overlap from x",
)(lambda spark, d: examples(spark, d).where("generated_reasoning is not null").join(table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "text"), "question_id").select("question_id", statistics.lexical_overlap(F.col("generated_reasoning"), F.col("text")).alias("overlap")))
_POLY = "0.0::double"
for _c in reversed(statistics.ERF_A):
    _POLY = f"(({_POLY} + ({_c})::double) * t)"
_DRAW = "('0x' || substr(md5('42|' || e || '|' || s || '|' || i || '|' || r || '|{arm}'), 1, 8))::bigint / 4294967296.0::double"
query(
    "power_simulation",
    f"""with {PRED}, bs as (select retrieval, round(avg({OK}), 6) as base from pred where model = 'base' group by retrieval),
    u as (select e, s, i, r, {_DRAW.format(arm=1)} as u1, {_DRAW.format(arm=0)} as u0 from (values (3), (5), (8)) x(e), range(0, 1000) y(s), range(0, 500) z(i), range(0, 3) w(r)),
    g as (select retrieval, e, s, i, avg((u1 < base + e / 100.0::double)::int - (u0 < base)::int) as d from u, bs group by all),
    m as (select retrieval, e, s, abs(avg(d)) / greatest(stddev_samp(d) / sqrt(500), 1e-12) / sqrt(2) as x from g group by all), t as (select retrieval, e, x, 1 / (1 + {statistics.ERF_P}::double * x) as t from m), p as (select retrieval, e, {_POLY} * exp(-x * x) as p from t)
    select retrieval, e as effect, round(avg((p < 0.05)::int), 6) as power, round(avg(p), 6) as mean_p, round(1 - avg((p < 0.05)::int), 6) as false_negative_rate from p group by retrieval, e""",
)(lambda spark, d: statistics.power_from(statistics.accuracy(predictions(spark, d).where("model = 'base'"), "retrieval"), "accuracy", "retrieval"))
query("cell_grid", f"""with {PRED}, g as (select model, retrieval, s.seed, model || '_' || retrieval || coalesce('_seed' || s.seed, '') as cell from (values ('base'), ('lora_a'), ('lora_a_prime'), ('lora_b')) m(model), (values ('none'), ('strong'), ('oracle')) r(retrieval), (values (42), (123), (456), (null)) s(seed) where (model = 'base') = (s.seed is null)),
    n as (select model, retrieval, case when model <> 'base' then seed end as seed, count(*) as n from pred group by all) select g.model, g.retrieval, g.seed, g.cell, coalesce(n, 0) as n from g left join n on g.model = n.model and g.retrieval = n.retrieval and g.seed is not distinct from n.seed""")(lambda spark, d: statistics.cells_found(predictions(spark, d)))


# -- analysis ------------------------------------------------------------------------------------------------------------
@query("main_table", f"with {PRED}, a as (select model, retrieval, avg({OK}) as acc from pred group by model, retrieval) select model, " + ", ".join(f"round(max(acc) filter (where retrieval = '{r}'), 6) as {r}" for r in statistics.RETRIEVALS) + " from a group by model")
def main_table(spark, d):
    acc = predictions(spark, d).groupBy("model").pivot("retrieval", list(statistics.RETRIEVALS)).agg(F.round(F.avg((F.col("predicted") == F.col("gold")).cast("int")), 6))
    return acc.select("model", *statistics.RETRIEVALS)


@query(
    "citation_support",
    f"""with {EX}, {PASSAGES}, s as (select question_id, unnest(string_split_regex(generated_reasoning, '[.!?]\\s+')) as sentence from ex where generated_reasoning is not null),
    c as (select question_id, sentence, unnest(list_distinct(regexp_extract_all(sentence, 'P([1-5])([^0-9]|$)', 1)))::int as position from s),
    w as (select c.question_id, {sql_words("lower(regexp_replace(sentence, '" + "[[]?P[1-5](, P[1-5])*[]]?" + "', '', 'g'))")} as s, list_distinct({sql_words("lower(ts[position])")}) as p from c join pt on pt.question_id = c.question_id)
    select question_id, count(*) as n_citations, count_if(len(list_filter(s, lambda x: list_contains(p, x))) >= {analysis.SUPPORT}::double * len(s) and len(s) > 0)::bigint as n_supported from w group by question_id""",
)
def citation_support(spark, d):
    return analysis.citation_support(with_passages(examples(spark, d).where("generated_reasoning is not null"), spark, d))


@query("stratified_accuracy", f"with {PRED} select model, retrieval, lang as stratum, count(*) as n, round(avg({OK}), 6) as accuracy from pred join documents on doc_id = example_id group by model, retrieval, lang")
def stratified_accuracy(spark, d):
    return analysis.stratified(predictions(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("example_id"), F.col("lang").alias("stratum")), "model", "retrieval")


@query("synthetic_filter_drops", rf"""with {EX}, r as (select case when floor(len({sql_words("generated_reasoning")}) * 1.3::double) < 50 then 'too_short' when not regexp_matches(coalesce(generated_reasoning, ''), '\[P[1-5]\]') then 'no_citation'
    when not coalesce(lower(generated_answer) = lower(gold_answer), false) then 'label_mismatch' end as reason from ex) select reason, count(*) as n from r where reason is not null group by reason""")
def synthetic_filter_drops(spark, d):
    return analysis.synthetic_filter(examples(spark, d))[1]


@query("event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_windows(spark, d):
    from quillon.streaming.progress import event_counts

    return event_counts(table(spark, d, "events"))
