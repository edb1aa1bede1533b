"""Text expressions: word counts, keys, citations, answers, factoid tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, with the four information separators.
SPACES = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"

# Results depend on these exact lists.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "of", "in", "on", "at", "to", "for", "and", "or", "but", "with", "by", "from", "as", "into",
    "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once",
]
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18",
    "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000",
}
#: End of fixed values.

# The forms of citations that results depend on.
CITED_PREFIX, CITED_BARE = "\\[P[1-5]", "(?U)\\bP[1-5]\\b"
CITED_ROUND, CITED_GROUP, CITED_NAMED = "\\(P[1-5]\\)", "\\[P[1-5](?:, ?P[1-5])+\\]", "(?i)passage [1-5]"
#: End of fixed values.


def words(text: Column) -> Column:
    """The white-space separated words of a text; none for a null or blank one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: inside the lambda it is a variable, however often, and in whatever loop, it is read."""
    return F.get(F.transform(F.array(value), use), 0)


#: Distinct words up to which each word of a text is compared with them; with more of them the text is sorted.
FEW_WORDS = 32


def held_words(some: Column, others: Column, few: int = FEW_WORDS) -> Column:
    """How many of the words ``some``, repeats counted, are among the words ``others``.

    Both are hashed for the distinct words of ``some`` that ``others`` lack. Where these, or those that are held, are a ``few``, ``some`` are compared with them and not sorted.
    Else ``some`` are sorted, and the held words, sorted too, are met in the order of the runs of equal words, so long texts cost n log n and there is one step a distinct word.
    A search of ``others`` inside a lambda would split that text again for each word."""

    def among(s: Column, listed: Column) -> Column:
        return F.size(F.filter(s, lambda w: F.array_contains(listed, w)))

    def counted(s: Column, runs: Column, both: Column) -> Column:
        start = F.struct(F.lit(0).alias("met"), F.lit(0).alias("n"))

        def step(state: Column, k: Column) -> Column:
            begin = F.get(runs, k - 1)
            more = F.struct((state["met"] + 1).alias("met"), (state["n"] + F.get(runs, k) - begin).alias("n"))
            return F.when(F.get(both, state["met"]).eqNullSafe(F.get(s, begin)), more).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), F.size(runs) - 1), start, step, lambda state: state["n"])

    def of_sorted(s: Column, both: Column) -> Column:
        runs = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)) | (i == F.size(s)))  # where each run begins, and the end
        return bound(runs, lambda r: bound(F.sort_array(both), lambda b: counted(s, r, b)))

    def of_held(s: Column, both: Column) -> Column:
        return F.when(F.size(both) <= few, among(s, both)).otherwise(bound(F.sort_array(s), lambda o: of_sorted(o, both)))

    def of(s: Column, missing: Column) -> Column:
        return F.when(F.size(missing) <= few, F.size(s) - among(s, missing)).otherwise(bound(F.array_except(s, missing), lambda both: of_held(s, both)))

    return bound(some, lambda s: F.when(F.size(s) > 0, bound(F.array_except(s, others), lambda missing: of(s, missing))).otherwise(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; ``trim`` would take blanks only."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]++|(?<![\\s\\x1c-\\x1f])[\\s\\x1c-\\x1f]++\\z", "")  # each run of white space is read once


def dedup_key(text: Column) -> Column:
    return F.lower(strip(text))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


# -- citations -----------------------------------------------------------------------------------------------------------
def is_cited(text: Column) -> Column:
    """Whether a passage marker [P1]..[P5], or a bare P1..P5, occurs; a bracketed one counts by its first digit."""
    return text.rlike(CITED_PREFIX) | text.rlike(CITED_BARE)


def citation_numbers(text: Column) -> Column:
    """The numbers, as strings, of markers such as [P12], in order."""
    return F.regexp_extract_all(text, F.lit("\\[P([0-9]+)\\]"), F.lit(1))


def first_bad_citation(text: Column, strict: bool = False) -> Column:
    """The first marker number outside 1 to 5, or null. ``strict`` looks into groups such as [P1, P9] too."""
    found = F.regexp_extract_all(text, F.lit("(?<=[\\[ ,])P([0-9]+)(?=[\\],])"), F.lit(1)) if strict else citation_numbers(text)
    return F.get(F.filter(found, lambda c: ~c.rlike("^0*[1-5]$")), 0)


def citation_count(text: Column, digits: str = "[1-5]") -> Column:
    return F.regexp_count(text, F.lit(f"\\[P{digits}\\]"))


def citation_forms(text: Column) -> dict[str, Column]:
    """How often each form of a citation occurs: [P1], (P1), a group such as [P1, P2], and "passage 1" in any case."""
    forms = {"square": "\\[P[1-5]\\]", "round": CITED_ROUND, "group": CITED_GROUP, "named": CITED_NAMED}
    return {name: F.regexp_count(text, F.lit(p)).cast("long") for name, p in forms.items()}


def numbered_references(text: Column) -> Column:
    """The numbers of markers such as [3], in order."""
    return F.regexp_extract_all(text, F.lit("\\[([0-9]+)\\]"), F.lit(1)).cast("array<int>")


def bracket_citations(text: Column) -> Column:
    """Bare markers P1 to P5 in brackets; a marker next to a bracket stays."""
    return F.regexp_replace(text, "(?U)(?<!\\[)\\bP([1-5])\\b(?!\\])", "[P$1]")


# -- answers -------------------------------------------------------------------------------------------------------------
def parse_response(text: Column) -> tuple[Column, Column]:
    """(reasoning, answer) at the first "Answer:"; nulls where it is missing. A leading "Reasoning:" goes."""
    at = F.locate("Answer:", text)
    reasoning = strip(F.substring(text, F.lit(1), at - 1))
    reasoning = F.when(reasoning.startswith("Reasoning:"), strip(F.substring(reasoning, F.lit(11), F.length(reasoning)))).otherwise(reasoning)
    return F.when(at > 0, reasoning), F.when(at > 0, strip(F.substring(text, at + 7, F.length(text))))


def answer_label(question_type: Column, answer: Column) -> Column:
    return F.when(question_type == "yesno", F.lower(answer)).otherwise(answer)


def extract_label(text: Column) -> Column:
    """yes, no or maybe from free text: after "Answer:", after "answer is", else the last one that stands alone."""
    label = "(yes|no|maybe)"
    low = F.lower(text)
    found = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in (f"answer:\\s*{label}\\b", f"answer is:?\\s*{label}\\b", f"(?s)\\A.*\\b{label}\\b")]  # anchored: a long text without a label is read once
    return F.coalesce(*found)


def answer_of_target(target: Column) -> Column:
    """What stands between the first "Answer: " and the end mark that follows; null where one of them is missing."""
    at = F.locate("Answer: ", target) + F.lit(8)
    end = F.call_function("locate", F.lit("<|eot_id|>"), target, at + 1)
    return F.when((at > 8) & (end > 0), F.substring(target, at, end - at))


# -- factoids ------------------------------------------------------------------------------------------------------------
@F.pandas_udf(StringType())
def without_marks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks; the one step that Spark has no function for."""
    for s in parts:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def factoid_tokens(text: Column, ascii_only: bool = False) -> Column:
    """The distinct tokens of an answer that count: no stopwords, number words as digits, no single letters.

    The decomposition changes nothing in ASCII text, which stays inside the JVM: the Python step gets a null for it. ``ascii_only`` leaves it out for all."""
    ascii_text = F.octet_length(text) == F.length(text)
    plain = F.lower(text if ascii_only else F.when(ascii_text, text).otherwise(without_marks(F.when(~ascii_text, text))))
    plain = F.regexp_replace(plain, "(?U)[^\\w\\s]", " ")
    numbers = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    kept = F.filter(words(plain), lambda t: ~t.isin(STOPWORDS))
    kept = F.transform(kept, lambda t: F.coalesce(F.try_element_at(numbers, t), t))
    return F.array_distinct(F.filter(kept, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$")))


def factoid_overlap(a: Column, b: Column, ascii_only: bool = False) -> Column:
    return F.arrays_overlap(factoid_tokens(a, ascii_only), factoid_tokens(b, ascii_only))


# -- JSON ----------------------------------------------------------------------------------------------------------------
#: The short escapes of JSON, by UTF-16 unit.
ESCAPES = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}
#: The characters that JSON leaves as they are, of ASCII.
PLAIN = "[ !#-\\[\\]-~]"


def json_string(text: Column) -> Column:
    """The text as a JSON string in ASCII: all else as \\u and four lower-case digits, above 16 bits as a surrogate pair. Only the runs of characters that are escaped are taken apart."""

    def escaped(u: Column) -> Column:
        out = F.concat(F.lit("\\u"), F.lower(u))
        for unit, short in ESCAPES.items():
            out = F.when(u == unit, short).otherwise(out)
        return out

    def run(piece: Column) -> Column:
        units = F.regexp_extract_all(F.hex(F.encode(piece, "UTF-16BE")), F.lit("(....)"), F.lit(1))
        return F.when(piece.rlike(f"^{PLAIN}"), piece).otherwise(F.array_join(F.transform(units, escaped), ""))

    pieces = F.regexp_extract_all(text, F.lit(f"({PLAIN}+|[^{PLAIN[1:]}+)"), F.lit(1))
    return F.concat(F.lit('"'), F.when(text.rlike(f"^{PLAIN}*\\z"), text).otherwise(F.array_join(F.transform(pieces, run), "")), F.lit('"'))


# -- hashing -------------------------------------------------------------------------------------------------------------
def seeded(seed: int | str, *parts: Column) -> Column:
    """An order for seeded shuffles that depends on nothing but the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def hash_number(text: Column) -> Column:
    """The first eight hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
