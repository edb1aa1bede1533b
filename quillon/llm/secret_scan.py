"""Secret scans with one combined deterministic automaton.

All rules are compiled into a single automaton over bytes (see automaton.py). One pass over the bytes of a text, from its end,
names every place at which a match of any rule begins. From the leftmost such place of a rule a second automaton of all rules runs to the end of the longest match,
and on from there with the next place behind it: leftmost and not overlapping spans. A match whose counted part is shorter than the rule's least length
is dropped, without a retry. No other matcher takes part. Every byte of every text is read, whatever its length; memory is bounded by the slices of a batch
and the longest text. There may be any number of rules.

Cases: a null or empty text has no spans; rules that match at the same place are listed by rule; rows given twice are scanned twice; a null doc_id is returned as it is; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from quillon.llm.automaton import Ends, Starts
from quillon.llm.spans import joined, of_kind, span_rows
from quillon.session import table


@dataclass(frozen=True)
class Rule:
    """``pattern``: the expression of the spans. ``least``: the characters that a span has at least, behind the part that matches ``head``.
    ``start``: what is looked for in place of ``pattern``, where that would begin all over a text; it begins wherever a span that counts does, and nowhere before."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    start: str = ""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_NAMED = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _NAMED + "[A-Za-z0-9+/_.=-]+", 6, _NAMED),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24, start="[0-9a-f]{24}"),
)
#: What the method adds: well-known token formats. Their starts leave out the counted tail, which would multiply the states with the counter of the base.
MORE = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", start="gh[pousr]_[A-Za-z0-9]"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", start="xox[abprs]-[A-Za-z0-9-]"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Starts, Ends]:
    """The automaton of all starts, and that of all ends; in the latter the rules' heads follow the rules."""
    return Starts([r.start or r.pattern for r in rules]), Ends([r.pattern for r in rules] + [r.head or r.pattern for r in rules])


def _taken(text: bytes, places: list[int], marks: list[int], starts: Starts, ends: Ends, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, from the places at which rules begin."""
    spans, free = [], [0] * len(rules)
    for place, mark in zip(places, marks):
        open_ = [k for k in starts.sets[mark] if place >= free[k]]
        if not open_:
            continue
        end_of = ends.walk(text, place)
        for k in open_:
            if k in end_of:
                free[k] = end = end_of[k]
                counted = end_of.get(len(rules) + k, place) if rules[k].head else place
                if end - counted >= rules[k].least:
                    spans.append((place, k, end))
    return spans


def scanner(rules: tuple[Rule, ...] = BASE + MORE):
    """A function from texts to their spans, by start and then by rule."""
    starts, ends = compiled(rules)

    def scan(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        text, place, mark = starts.scan(raw)
        edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]) if len(text) else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            i = int(text[a])
            spans = _taken(raw[i], place[a:b].tolist(), mark[a:b].tolist(), starts, ends, rules)
            if len(raw[i]) > len(texts[i]):  # from bytes to code points
                before = np.r_[0, np.cumsum(np.frombuffer(raw[i], np.uint8) & 0xC0 != 0x80)]
                spans = [(int(before[s]), k, int(before[e])) for s, k, e in spans]
            out[i] = [(rules[k].kind, s, e) for s, k, e in spans]
        return out

    return scan


def find_secrets(docs, rules: tuple[Rule, ...] = BASE + MORE):
    """(doc_id, spans) for each row of ``docs``."""
    return span_rows(docs, lambda: scanner(rules))


def op10_secret_scan(spark, sf_dir):
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans, kinds = F.col("spans"), [r.kind for r in BASE]
    counts = [F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(of_kind(spans, *kinds)), 256).alias("base_sha256"), joined(spans).alias("spans"))
