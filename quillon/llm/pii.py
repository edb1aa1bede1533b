"""Personal data: a character-level bidirectional LSTM with CRF transitions, beside exact patterns.

The base finds e-mail and IP addresses, card and phone numbers by pattern, leftmost and not overlapping, and drops the matches that fail
their test. The tagger (lstm_crf.py) is trained on labelled spans: windows of a bounded sample of documents, labelled with the spans that the
base finds there and with the places of what is written into them: personal data in many written forms, such as addresses with the sign spelt out and phone numbers
without a plus, which no pattern of this module has. It reads every character of every text in overlapping windows. The windows' scores are reconciled over the whole document:
where windows overlap, the mean counts, weighted by the distance from their edges, and the best path of the CRF runs over all characters of windows that follow on one another, with its
transitions across their edges, so a span across an edge of windows comes out whole and once. A span
whose path scores ``MARGIN`` more than the path outside, that has the numbers of its kind (a card's check digit, an address's four bytes, a phone's 8 to 15 digits) and overlaps no span of the base
is added to them. A phone that the base's pattern loses, as it runs into the digits behind it, is found like this.

Cases: a null or empty text has no spans; of spans of the tagger that overlap one of the base the base's stays, and its own never overlap; spans of one start are listed by kind; a text shorter than a window is padded; a text of any length is read whole; rows given twice get the same spans twice; a
null doc_id is returned as it is; without any document the tagger learns from generated text; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lstm_crf import PAD, Tagger, char_classes
from quillon.llm.spans import joined, of_kind, span_rows
from quillon.session import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match that begins inside a run of digits would begin at its start too; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS = re.compile("[0-9]"), re.compile("[0-9]+")
#: Characters of a window, of its overlap with the next, windows decoded at once; of the fit the characters of a window, documents, characters of each, windows and steps.
WINDOW, OVERLAP, AT_ONCE, LEARN, SAMPLE, PART, EXAMPLES, STEPS = 256, 32, 2048, 96, 200, 1 << 16, 6000, 500
#: What a span's path must score beyond the path outside.
MARGIN = 4.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base, by kind and then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # from sign to sign, so that a long run of letters is read once
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def plausible(kind: str, s: str) -> bool:
    """Whether a span that the tagger adds has the numbers of its kind, or an address's signs in any spelling; how they are written is the tagger's to say."""
    if not s:
        return False
    runs = _DIGITS.findall(s)
    digits = "".join(runs)
    if kind == "email":
        return s[0].isalnum() and s[-1].isalpha() and ("@" in s or "at" in s.lower()) and ("." in s or "dot" in s.lower())
    if kind == "ip":
        return len(runs) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in runs)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


# -- labelled examples ---------------------------------------------------------------------------------------------------
def _name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def _planted(rng: random.Random, kind: str) -> str:
    """Personal data as people write it; numbers are drawn, so that no two are alike."""

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    if kind == "email":
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", ".")])
        return rng.choice(["", _name(rng) + rng.choice("._")]) + _name(rng) + rng.choice(["", number(2)]) + at + _name(rng) + dot + rng.choice(["com", "org", "net", "co.uk", "example.com", "fr", "de"])
    if kind == "ip":
        return rng.choice([".", ".", "[.]", "(.)", "-"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = number(15)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return rng.choice(["", " ", "-", ".", "/", "_"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    a, b, c, s = number(3), number(3), number(4), rng.choice(" .-")
    head = rng.choice(["+1 ", "+1 ", f"+{rng.randint(1, 99)} ", f"00{rng.randint(1, 99)} ", "1-", "", "", ""])
    return head + rng.choice([f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"({a}){b}{s}{c}", f"{a}/{b}{s}{c}"])


def _decoy(rng: random.Random) -> str:
    """What looks a little like personal data and is none."""
    n = rng.randint
    return rng.choice([str(n(1, 99999)), f"{n(1900, 2030)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(0, 99)}.{n(0, 99)}", f"{n(0, 9)}.{n(0, 9)}.{n(0, 20)}", f"{n(1, 23)}:{n(0, 59):02}", f"{_name(rng)} at {_name(rng)}", f"@{_name(rng)}", "%040x" % rng.getrandbits(160), f"AKIA{rng.getrandbits(64):016X}", f'token = "{rng.getrandbits(80):020x}"', f"${n(1, 999)},{n(0, 999):03}", f"{n(1, 9)}/{n(1, 9)}", f"#{n(1, 9999)}"])


def _generated(rng: random.Random) -> str:
    """Text for where there are no documents to learn from."""
    return " ".join(_name(rng).capitalize() + "." if rng.random() < 0.1 else _name(rng) for _ in range(300))


def _written_in(part: str, spans: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A part of a text with something written in place of a space outside its spans, and the spans with those of what was written, which are labels by their making."""
    added, new = " ", []
    for _ in range(rng.choice([1, 1, 1, 1, 2])):  # now and then two that follow on one another
        if rng.random() < 0.65:
            kind = rng.choice(KINDS)
            thing = _planted(rng, kind)
            new.append((kind, len(added), len(added) + len(thing)))
        else:
            thing = _decoy(rng)
        added += thing + rng.choice([" ", ". ", ", ", " "])
    at = rng.choice([i for i, c in enumerate(part) if c in " \n" and not any(a <= i < b for _, a, b in spans)] or [0])
    shift = len(added) - 1
    moved = [(k, a + shift * (a > at), b + shift * (a > at)) for k, a, b in spans]
    return part[:at] + added + part[at + 1 :], moved + [(k, at + a, at + b) for k, a, b in new]


def examples(texts: list[str], n: int = EXAMPLES, length: int = LEARN, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: parts of the texts with the base's spans, most of them with personal data and decoys written in, whose places are known."""
    rng = random.Random(seed)
    texts = [t for t in texts if t.strip()] or [_generated(rng) for _ in range(20)]
    windows, gold = np.full((n, length), PAD, np.uint8), np.zeros((n, length), np.uint8)
    for row in range(n):
        t = rng.choice(texts) if rng.random() < 0.8 else _generated(rng)
        a = rng.randrange(max(1, len(t) - length + 1))
        part = t[a : a + rng.choice([length, length, rng.randint(8, length)])]
        spans = base_spans(part)
        for _ in range(rng.choice([0, 1, 1, 2])):
            part, spans = _written_in(part, spans, rng)
        cut = rng.randrange(max(1, len(part) - length + 1))  # so that spans lie anywhere, also across an edge
        part = part[cut : cut + length]
        windows[row, : len(part)] = char_classes(part)
        for kind, s, e in spans:
            gold[row, max(s - cut, 0) : max(e - cut, 0)] = KINDS.index(kind) + 1
    return windows, gold


@lru_cache(maxsize=4)
def _trained(texts: tuple[str, ...], steps: int) -> Tagger:
    tagger = Tagger(len(KINDS) + 1)
    tagger.fit(*examples(list(texts)), steps)
    return tagger


def train(docs: DataFrame, rows: int = SAMPLE, steps: int = STEPS) -> Tagger:
    """The tagger learnt from at most ``rows`` documents, those with the least hash of doc_id, and ``PART`` characters of each, from anywhere in it."""
    n = docs.count()
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = docs.where(F.col("text").isNotNull()).where(hashed <= int((1 << 30) * min(1.0, 2 * rows / max(1, n)))).withColumn("h", hashed)
    begin = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.length("text") - PART, F.lit(0)) + 1).cast("int") + 1
    some = some.select("h", F.substring("text", begin, F.lit(PART)).alias("part"))
    return _trained(tuple(r["part"] for r in some.orderBy("h", "part").limit(rows).collect()), steps)


# -- scanning ------------------------------------------------------------------------------------------------------------
def _weights(size: int, low: int) -> np.ndarray:
    """What the scores of a window that begins at ``low`` of a text count for: more the farther a character is from the window's edges; an edge of the text is none."""
    at, end = np.arange(min(WINDOW, size - low)), low + WINDOW < size
    out = np.full(len(at), OVERLAP + 1.0, np.float32)
    if low:
        out = np.minimum(out, at + 1)
    return np.minimum(out, len(at) - at) if end else out


def reconciled(size: int, windows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The scores of a chain of overlapping windows (begin, scores) of a text of ``size`` characters: where they overlap, the weighted mean."""
    low, high = windows[0][0], min(size, windows[-1][0] + WINDOW)
    total, weight = np.zeros((high - low, windows[0][1].shape[1]), np.float32), np.zeros(high - low, np.float32)
    for begin, scores in windows:
        w = _weights(size, begin)
        total[begin - low : begin - low + len(w)] += w[:, None] * scores[: len(w)]
        weight[begin - low : begin - low + len(w)] += w
    return total / weight[:, None]


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The runs of a tag in each text. Windows whose best path stays outside are outside; the others that follow on one another are reconciled to one chain of
    scores, of which the best path over all its characters is taken, with the transitions across the windows' edges."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = char_classes("".join(texts))
    starts_of = np.cumsum(sizes) - sizes
    stride = WINDOW - OVERLAP
    counts = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // stride), 0)
    doc = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = nth * stride
    offsets = np.arange(WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    chains: list[tuple[int, int, np.ndarray]] = []
    held: list[tuple[int, np.ndarray]] = []  # the windows of the chain that may go on
    owner = -1

    def close() -> None:
        if held:
            chains.append((owner, held[0][0], reconciled(int(sizes[owner]), held)))
            held.clear()

    def flush() -> None:
        ends = [low + len(c) == sizes[i] for i, low, c in chains]
        for (i, low, scores), tags in zip(chains, tagger.best_paths([c for _, _, c in chains], [low == 0 for _, low, _ in chains], ends)):
            edges = np.flatnonzero(np.diff(tags.astype(np.int8), prepend=0, append=0))
            out[i] += [(KINDS[tags[s] - 1], low + s, low + e) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()) if tags[s] and tagger.margin(scores, int(tags[s]), s, e) >= MARGIN]
        chains.clear()

    for a in range(0, len(doc), AT_ONCE):
        d, s = doc[a : a + AT_ONCE], begin[a : a + AT_ONCE]
        at = (starts_of[d] + s)[:, None] + offsets
        windows = padded[at]
        windows[offsets >= (sizes[d] - s)[:, None]] = PAD
        rows, scores = tagger.inside(windows)
        for r, one in zip(rows.tolist(), scores):
            i, low = int(d[r]), int(s[r])
            if held and (i != owner or low != held[-1][0] + stride):
                close()
            owner = i
            held.append((low, one))
        if len(chains) >= AT_ONCE // 4:
            flush()
    close()
    flush()
    return out


def scanner(tagger: Tagger):
    """A function from texts to their spans, by kind and then start: those of the base and those that the tagger adds."""

    def scan(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out = []
        for text, tagged in zip(texts, tagged_spans(tagger, texts)):
            spans = base_spans(text)
            for kind, s, e in tagged:
                while s < e and text[s] in " \n\t.,;:'\"":
                    s += 1
                while e > s and text[e - 1] in " \n\t.,;:'\"":
                    e -= 1
                if plausible(kind, text[s:e]) and all(e <= a or s >= b for _, a, b in spans):
                    spans.append((kind, s, e))
            out.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
        return out

    return scan


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, spans, base) for each row of ``docs``: all spans, and those of the patterns alone."""
    tagger = tagger or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers

    def make():
        full = scanner(shared.value)

        def scan(texts):
            return [[*spans, *(("base " + k, a, b) for k, a, b in base_spans(text))] for spans, text in zip(full(texts), texts)]

        return scan

    found = span_rows(docs, make)
    bare = F.transform(of_kind(F.col("spans"), *("base " + k for k in KINDS)), lambda s: F.struct(F.substring(s["kind"], 6, 9).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", of_kind(F.col("spans"), *KINDS).alias("spans"), bare.alias("base"))


def op1_pii(spark, sf_dir):
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def pii_base(spark, sf_dir):
    """The columns of ``op1_pii`` that come from the patterns alone, which SQL can express."""
    return op1_pii(spark, sf_dir).drop("spans")
