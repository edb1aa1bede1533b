"""URL filters: rules by address, and for addresses without a rule a naive Bayes score of the words that their names are made of.

A name is a run of letters of an address, in lower case. Names that are put together (``cheappills``) are taken apart by a unigram Viterbi: of all splits the one of the largest probability, where
a word has its share of all words of a corpus, and a string that is no known word a share that falls tenfold with each letter. The words of the corpus are counted by Spark and
never brought together: the substrings of each distinct name are joined with the counts, and each name is then split alone, with the few counts that concern it.

Multinomial naive Bayes is trained on the addresses themselves, by a lexicon: an address one of whose words is in it is an example of what is blocked, any other that no rule blocks is one of
what is allowed (a rule judges an address, not its words, so what it blocks is no example). Counts are whole, over all pages. A page is blocked if its words, with their counts, are
likelier under the blocked examples. Log-odds are whole numbers of 2^-20, so that sums do not depend on their order.

Pages that differ in digits only have the same names and are handled as one; joins by a name that more than one in 1,000 rows hold, so 1,000 names at most, are broadcast, the others are left
to Spark, so no task gets a hot name's rows.

Cases: a null url, or one without ``://``, has an empty host and path and no word, so no rule fits and the shares of the examples decide: allow, unless more of them are blocked; a rule's host fits itself and what ends in a
dot and it, and an empty path starts with no rule's; of rules of the same length the one with the longer host, then the first one, wins; a name of more than 63 letters, the most that a host's name may have, is one word known by
its hash; of splits of the same probability that with fewer words, then that with the longest last words; a null page_id is returned as it is, rows given twice are judged alike; empty documents leave the lexicon's words, an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import let
from quillon.session import materialise, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules, and the lexicon of words whose addresses are examples of what is blocked.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
LEXICON = (
    "adserver", "adult", "ads", "bet", "bets", "betting", "casino", "crack", "escort", "gambling", "hentai", "jackpot", "keygen", "lottery", "malware", "phishing", "pharmacy", "pills", "poker", "popunder", "porn", "sex",
    "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "xxx",
)
#: End of fixed values.
#: Letters of the longest word and name; a word of the lexicon counts as one in LEXICON_SHARE words of the corpus; parts that a short word's counts are dealt into; units of a log-odds; a key is hot from one row in HOT on.
WORD, NAME, LEXICON_SHARE, SHORT, SALTS, UNIT, HOT = 20, 63, 10_000, 3, 16, 1 << 20, 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = let(rest, lambda r: F.regexp_extract(r, "^[^/?#]*", 0))
    path = let(rest, lambda r: F.regexp_extract(r, "^[^/?#]*([^?#]*)", 1))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rule(rules: tuple[Rule, ...], host: Column, path: Column, what) -> Column:
    """``what`` of the longest of the rules that fit, null without one; the rules are a parameter of some hundred at most."""
    out = F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: (-len(r.text), -len(r.host)))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def names(host: Column, path: Column) -> Column:
    """The names of an address, in their order; a long one by its hash, which has no letter run of its own."""
    found = F.regexp_extract_all(F.lower(F.concat(host, F.lit("/"), path)), F.lit("\\p{L}+"), F.lit(0))
    return F.transform(found, lambda x: F.when(F.length(x) > NAME, F.concat(F.lit("#"), F.md5(x.cast("binary")))).otherwise(x))


def looked_up(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """``rows``, a written table, with the columns of ``facts``, which has one row a key, where there is one. Keys that one row in ``HOT`` or more has are joined by broadcast, of at most ``HOT`` rows."""
    least = max(2.0, rows.count() / HOT)
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    known = facts.join(F.broadcast(hot), key)  # at most HOT rows, as is the other
    return rows.join(F.broadcast(known), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts.hint("merge"), key))


def word_counts(texts: DataFrame, lexicon: tuple[str, ...] = LEXICON) -> tuple[DataFrame, int]:
    """((word, n), all n) of the words of a column ``text``, with those of the lexicon: runs of at most ``WORD`` letters, in lower case."""
    found = texts.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).where((F.col("word") != "") & (F.length("word") <= WORD))
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    written = materialise(counts, "words")
    total = written.agg(F.sum("n")).first()[0] or 0
    each = max(1, total // LEXICON_SHARE)
    seeds = texts.sparkSession.createDataFrame([(w, each) for w in lexicon], "word string, n long")
    return written.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), total + each * len(lexicon)


def split(name: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of a name; ``counts``: of the words at (start, end)."""
    unit, letter = round(UNIT * math.log(10 / max(total, 1))), round(UNIT * math.log(10))
    best: list[tuple[int, int]] = [(0, 0)]  # of each end: the log-probability in units, less words first
    back = [0]
    for end in range(1, len(name) + 1):
        top, at = None, 0
        for start in range(end):
            n = counts.get((start, end))
            own = round(UNIT * math.log(n / total)) if n else unit - letter * (end - start)
            one = (best[start][0] + own, best[start][1] - 1)
            if top is None or one > top:
                top, at = one, start
        best.append(top)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(distinct: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) of each row of ``distinct`` (name, once each): the substrings of the names are joined with the counts, short ones, which many names hold, in ``SALTS`` parts."""
    size = F.length("name")
    some = distinct.where(~F.col("name").startswith("#")).withColumn("start", F.explode(F.sequence(F.lit(0), size - 1)))
    some = some.withColumn("end", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + WORD, F.length("name")))))
    word = F.substring("name", F.col("start") + 1, F.col("end") - F.col("start"))
    some = some.withColumn("word", word).withColumn("salt", F.when(F.length("word") <= SHORT, F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.length("word") <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = some.join(counts.withColumn("salt", F.explode(salts)), ["word", "salt"]).groupBy("name").agg(F.collect_list(F.struct("start", "end", "n")).alias("found"))  # NAME x WORD at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append([name] if name.startswith("#") else split(name, {(f["start"], f["end"]): f["n"] for f in found or ()}, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return distinct.join(known, "name", "left").select("name", "found").mapInArrow(run, "name string, words array<string>")


def addresses(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(page_id, host, path, rule, verdict, names, key): ``verdict`` is the rule's; equal names have equal keys."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": by_rule(rules, F.col("host"), F.col("path"), lambda r: r.text), "verdict": by_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict), "names": names(F.col("host"), F.col("path"))})
    return rows.withColumn("key", F.unhex(F.md5(F.array_join("names", " ").cast("binary"))))


def trained(named: DataFrame, lexicon: tuple[str, ...] = LEXICON) -> tuple[DataFrame, int]:
    """((word, odds), odds of the classes) of multinomial naive Bayes with one added to each count; ``named``: (words, n), n addresses that no rule blocks."""
    bad = F.arrays_overlap("words", F.array(*map(F.lit, lexicon)))
    rows = named.where("n > 0").select("words", F.when(bad, F.col("n")).otherwise(0).alias("blocked"), F.when(bad, 0).otherwise(F.col("n")).alias("allowed"))
    counts = materialise(rows.select(F.explode("words").alias("word"), "blocked", "allowed").groupBy("word").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")), "word-classes")
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("a")).first()
    classes = rows.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("a")).first()
    odds = F.log((F.col("blocked") + 1) / (sums["b"] + sums["v"])) - F.log((F.col("allowed") + 1) / (sums["a"] + sums["v"]))
    return counts.select("word", F.round(odds * UNIT).cast("long").alias("odds")), round(UNIT * math.log((classes["b"] + 1) / (classes["a"] + 1)))


def judge(pages: DataFrame, texts: DataFrame, rules: tuple[Rule, ...] = RULES, lexicon: tuple[str, ...] = LEXICON) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score) of each row of ``pages`` (page_id, url); ``texts`` (text) is the corpus of the words. ``score``: the log-odds of block, whatever the rule."""
    rows = materialise(addresses(pages, rules), "addresses")
    free = F.coalesce(F.col("verdict") != "block", F.lit(True))
    kinds = materialise(rows.groupBy("key").agg(F.first("names").alias("names"), F.count_if(free).alias("n")), "address-kinds")
    parts = materialise(kinds.select("key", F.posexplode("names").alias("at", "name")), "names")
    counts, total = word_counts(texts, lexicon)
    words = materialise(segmented(parts.select("name").distinct(), counts, total), "name-words")
    named = looked_up(parts, "name", words).groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))  # the names of one address
    named = materialise(kinds.select("key", "n").join(named, "key", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))), "address-words")
    odds, prior = trained(named, lexicon)
    single = materialise(named.select("key", F.explode("words").alias("word")), "words-of-addresses")
    scores = looked_up(single, "word", odds).groupBy("key").agg(F.sum("odds").alias("odds"))
    scored = named.join(scores, "key", "left").select("key", F.array_join("words", " ").alias("words"), (F.coalesce("odds", F.lit(0)) + prior).alias("odds"))
    out = looked_up(rows, "key", materialise(scored, "address-scores"))
    verdict = F.coalesce("verdict", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", (F.col("odds") / UNIT).alias("score"))


def op12_url_filter(spark, sf_dir):
    """page_id, host, path, rule and verdict, with the words and the score, for each page; words are counted over all documents."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "documents").select("text"))


def url_rules(spark, sf_dir):
    """page_id, host, path, rule and, where a rule decides, its verdict: the columns of ``op12_url_filter`` that SQL can express."""
    return op12_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


#: Every rule against every url.
RULES_SQL = f"""
with p as (select page_id, coalesce(url, '') as u from pages), r as (select page_id, case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else '' end as rest from p),
h as (select row_number() over () as i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
l as (select * from (values {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}) t(verdict, rhost, rpath)),
f as (select h.i, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict from h join l on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by h.i)
select page_id, host, path, rule, verdict from h left join f using (i)
"""
