"""Secret scans, personal data, languages and quality scores."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language_id, pii, quality_classifier, secret_scan
from quillon.llm.automaton import Ends, Starts
from quillon.llm.lstm_crf import Tagger


# the base as the contract words it: (kind, expression, group that is counted, least length)
CONTRACT = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]


def plain_secrets(text):
    out = []
    for k, (_, pattern, group, least) in enumerate(CONTRACT):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return [(CONTRACT[k][0], a, b) for a, k, b in sorted(out)]


def test_automaton_against_re():
    rng = random.Random(1)
    patterns = ["a(b|c)+d", "[a-c]{3}x?", "ab*[:=]c{2,}", "aab|ba", "a{2,3}"]
    starts, ends = Starts(patterns), Ends(patterns)
    texts = ["".join(rng.choice("abcdx:=") for _ in range(rng.randint(0, 30))).encode() for _ in range(500)] + [b"", b"ab" * 3000 + b"d"]
    found = {}
    for text, place, mark in zip(*(x.tolist() for x in starts.scan(texts))):
        found[text, place] = set(starts.sets[mark])
    for i, text in enumerate(texts):
        for at in range(len(text)):
            want = {k: max(e for e in range(at, len(text) + 1) if re.fullmatch(p.encode(), text[at:e])) for k, p in enumerate(patterns) if re.compile(p.encode()).match(text, at)} if len(text) < 100 else None
            if want is not None:
                assert found.get((i, at), set()) == set(want) and ends.walk(text, at) == want
    assert all(found[len(texts) - 1, at] for at in (0, 2, 5998))


def test_any_number_of_rules():
    """None of 70 rules is lost, alone or together."""
    words = [f"key{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(70)]
    rules = tuple(secret_scan.Rule(f"k{k}", w + "[0-9]+", 2 + len(w)) for k, w in enumerate(words))
    scan = secret_scan.scanner(rules)
    texts = [f"x {w}12 {w}3 {w}456" for w in words] + [" ".join(w + "77" for w in words)]
    got = scan(texts)
    assert [[(k, t[a:b]) for k, a, b in spans] for t, spans in zip(texts[:-1], got)] == [[(f"k{k}", w + "12"), (f"k{k}", w + "456")] for k, w in enumerate(words)]
    assert [k for k, _, _ in got[-1]] == [f"k{k}" for k in range(70)]


def test_secrets_random():
    rng = random.Random(2)
    parts = ["token", "Password", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc", "XYZ12", "AKIA", "0123456789ab", "deadbeef", "A1B2C3D4E5", "ghp_", "é", "\n", "ſecret", "toKen"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "AKIA" * 400, "0" * 5000, "token=" * 3000, "token=token: abcdef", 'passwd" : =x=abcde']
    base = {r.kind for r in secret_scan.BASE}
    for text, spans in zip(texts, secret_scan.scanner()(texts)):
        assert [s for s in spans if s[0] in base] == plain_secrets(text)


def test_secrets_query(spark, tmp_path):
    """All columns of the query against plain Python."""
    rng = random.Random(21)
    parts = ["token", "=", ":", " ", "'", "abcdef12", "AKIA", "0123456789ab", "A1B2C3D4E5F6", "ghp_" + "a1" * 20, "é", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(40)), "en", "s", 1) for i in range(300)] + [(900, None, "en", "s", 0), (901, "", None, None, None), (None, "token=abcdef", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secret_scan.op10_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        spans = plain_secrets(text or "")
        forge = [("forge", *m.span()) for m in re.finditer("gh[pousr]_[A-Za-z0-9]{36,}", text or "")]
        order = ["assign", "access", "hex", "forge"]
        every = sorted(spans + forge, key=lambda s: (s[1], order.index(s[0])))
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in order[:3])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in every)


def test_secrets_added():
    text = "x ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- xoxb-123456789012"
    assert [s[0] for s in secret_scan.scanner()([text])[0]] == ["forge", "pem", "chat"]


def test_secrets_rows(make, odd_rows):
    docs = make([*odd_rows, (50, 'a token = "abcdef123"'), (51, "key " + "ab12" * 6)])
    out = secret_scan.find_secrets(docs).collect()
    assert len(out) == len(odd_rows) + 2
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out}
    assert got[5] == got[6] == [] and got[50] == [("assign", 2, 20)] and got[51] == [("hex", 4, 28)]
    assert secret_scan.find_secrets(make([])).count() == 0


# -- personal data -------------------------------------------------------------------------------------------------------
def test_pii_base():
    text = "mail a.b@c-d.org, ip 10.0.0.1 no 300.1.1.1, card 4111 1111 1111 1111 no 4111 1111 1111 1112, tel +1 (555) 123-4567."
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@c-d.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert pii.base_spans("") == []


def plain_base(text):
    """The base as the contract words it."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    want = [("email", *m.span()) for m in email.finditer(text)]
    want += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    want += [("card", *m.span()) for m in card.finditer(text) if 16 <= sum(c.isdigit() for c in m.group()) <= 19 and pii.luhn(re.sub("[ -]", "", m.group()))]
    return want + [("phone", *m.span()) for m in phone.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_pii_base_random():
    """The base as its patterns have it, on random pieces."""
    rng = random.Random(12)
    parts = ["a", "b.c", "@", "@", ".", "com", "10", "255", "256", ".", "0", "+", "1", " ", "-", "(", ")", "4111111111111111", "\n", "é", "_", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text)
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == [] and pii.base_spans("0" * 9000 + "1.1.1.1")[0][0] == "ip"


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(4)
    return pii._trained(tuple(pii._generated(rng) for _ in range(40)), pii.STEPS)


def test_crf_gradient():
    rng = np.random.default_rng(0)
    t = Tagger(3, hidden=2)
    cls, gold = rng.integers(0, 9, (5, 4)), rng.integers(0, 3, (5, 4))

    def objective():
        # the loss is the chain's likelihood; the per-character term adds to the gradient alone
        fwd, bwd = t._run("f", cls), t._run("b", cls[::-1])[::-1]
        emit = [t.p["Wf"] @ f[4] + t.p["Wb"] @ b[4] + t.p["b"] for f, b in zip(fwd, bwd)]
        own = sum(np.log(np.exp(e).sum(axis=0)) - e[g, np.arange(4)] for e, g in zip(emit, gold)).mean()
        return t.loss(cls, gold)[0] + own

    _, grad = t.loss(cls, gold)
    for name in ("A", "Wf", "Ub", "Xf", "b"):
        for at in [np.unravel_index(i, t.p[name].shape) for i in rng.integers(0, t.p[name].size, 4)]:
            old = t.p[name][at]
            t.p[name][at] = old + 1e-5
            up = objective()
            t.p[name][at] = old - 1e-5
            down = objective()
            t.p[name][at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_pii_held_out(tagger):
    """Written forms for which the module has no pattern are found where they are, and nothing else is."""
    rng = random.Random(99)
    for kind in pii.KINDS:
        texts, want = [], []
        for _ in range(150):
            body, thing = pii._generated(rng), pii._planted(rng, kind)
            at = body.index(" ", rng.randrange(len(body) - 40)) + 1
            texts.append(body[:at] + thing + " " + body[at:])
            want.append((kind, at, at + len(thing)))
        found = pii.scanner(tagger)(texts)
        right = sum(w in f for w, f in zip(want, found))
        assert right > 0.9 * len(want) and sum(map(len, found)) - right <= 0.05 * len(want)
        beyond = sum(w in f and w not in pii.base_spans(t) for w, f, t in zip(want, found, texts))
        assert beyond > 0.2 * len(want)  # by the tagger alone
    clean = [pii._generated(rng) for _ in range(200)]
    assert sum(map(len, pii.scanner(tagger)(clean))) <= 2


def test_pii_phone_that_the_base_loses(tagger):
    """The base's pattern runs on into the address behind the number and is dropped, as its contract says; the tagger finds the number."""
    for phone, more in (("+1 (826) 555-4081", "190.137.223.7"), ("+1 (843) 555-7672", "170.106.47.201")):
        text = f"words before it. {phone} {more} and words after it, and so on."
        assert [k for k, *_ in pii.base_spans(text)] == ["ip"]
        spans = pii.scanner(tagger)([text])[0]
        assert [(k, text[a:b]) for k, a, b in spans] == [("ip", more), ("phone", phone)]


def test_pii_labels_are_the_planted_places():
    """A label is where something was written, whatever it looks like."""
    rng, seen = random.Random(2), Counter()
    for _ in range(400):
        part = pii._generated(rng)[:90] + " 10.0.0.1 " + pii._generated(rng)[:60]
        text, spans = part, pii.base_spans(part)
        for _ in range(2):
            text, spans = pii._written_in(text, spans, rng)
        assert ("ip", text.index("10.0.0.1"), text.index("10.0.0.1") + 8) in spans
        for k, a, b in spans:
            assert pii.plausible(k, text[a:b]) and text[a - 1] == " " and not text[b].isalnum()
            seen[k] += 1
    assert min(seen[k] for k in pii.KINDS) > 50


def test_pii_margin_is_the_difference_of_paths(tagger):
    rng = np.random.default_rng(3)
    a = tagger._prepare()["A"]
    scores = np.hstack([np.zeros((9, 1)), rng.normal(0, 2, (9, tagger.tags - 1))]).astype(np.float32)

    def path(tags):
        return sum(scores[i, t] for i, t in enumerate(tags)) + sum(a[x, y] for x, y in zip(tags, tags[1:]))

    for tag, s, e in ((1, 2, 6), (3, 4, 5), (2, 1, 8)):
        assert tagger.margin(scores, tag, s, e) == pytest.approx(path([tag if s <= i < e else 0 for i in range(9)]) - path([0] * 9), abs=1e-4)


def test_pii_windows_do_not_matter(tagger, monkeypatch):
    """A span is found once and whole wherever the windows' edges fall."""
    body = ("some words to fill the text with nothing in it " * 12).strip()
    for shift in range(0, 300, 23):
        text = body[:shift] + " +1 (555) 123-4567 " + body[shift:]
        spans = [s for s in pii.tagged_spans(tagger, [text])[0]]
        assert len(spans) == 1 and spans[0][0] == "phone"


def test_decode_bound_loses_nothing(tagger):
    """Windows that decode() leaves out have the best path outside throughout."""
    windows, _ = pii.examples(["plain words " * 30], 200, 96)
    rows, tags = tagger.decode(windows)
    w, cls = tagger._prepare(), np.ascontiguousarray(windows.T)
    over = np.empty((len(cls), tagger.tags - 1, len(windows)), np.float32)
    over[:] = w["b"]
    tagger._emit("f", cls, over)
    tagger._emit("b", cls, over)
    e = np.zeros((len(cls), tagger.tags, len(windows)))
    e[:, 1:] = over
    score, back = e[0], []
    for t in range(1, len(cls)):
        step = score[:, None, :] + w["A"][:, :, None]
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + e[t]
    path = [score.argmax(axis=0)]
    for b in reversed(back):
        path.append(b[path[-1], np.arange(len(windows))])
    full = np.array(path[::-1]).T
    assert np.array_equal(np.flatnonzero(full.any(axis=1)), rows)
    assert np.array_equal(full[rows], tags)


def test_paths_are_global(tagger):
    """Over windows that follow on one another the tags are the best path of the whole text by plain Viterbi, seams included."""
    rng = random.Random(14)
    for k in range(12):
        parts = [pii._planted(rng, rng.choice(pii.KINDS)) if rng.random() < 0.3 else pii._name(rng) for _ in range(150)]
        text = " ".join(parts)
        stride, size = pii.WINDOW - pii.OVERLAP, len(text)
        begins = [b for b in range(0, max(size - pii.OVERLAP, 1), stride)]
        windows = np.full((len(begins), pii.WINDOW), pii.PAD, np.uint8)
        classes = pii.char_classes(text)
        for r, b in enumerate(begins):
            windows[r, : len(classes[b : b + pii.WINDOW])] = classes[b : b + pii.WINDOW]
        rows, scores = tagger.inside(windows)
        a, want = tagger._prepare()["A"], np.zeros(size, int)
        e = np.full((size, tagger.tags), -1e9)
        e[:, 0] = 0
        chain = []
        for n, r in enumerate(rows.tolist() + [-9]):
            if chain and r != chain[-1][0] + 1:
                low = begins[chain[0][0]]
                one = pii.reconciled(size, [(begins[x], scores[y]) for x, y in chain])
                e[low : low + len(one)] = one
                chain = []
            if r >= 0:
                chain.append((r, n))
        score, back = e[0].astype(float), []
        for t in range(1, size):
            step = score[:, None] + a
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + e[t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        want = np.array(path[::-1])
        got = np.zeros(size, int)
        for kind, x, y in pii.tagged_spans(tagger, [text])[0]:
            got[x:y] = pii.KINDS.index(kind) + 1
        assert np.array_equal(got, want)


def test_decode_without_the_shortcut(tagger):
    """Where entering and leaving cost less than staying, no window is left out."""
    import copy

    odd = copy.deepcopy(tagger)
    odd.p["A"] = np.zeros_like(odd.p["A"])
    odd.p["A"][0, 1:] = odd.p["A"][1:, 0] = 1.0
    odd.fast = None
    windows, _ = pii.examples(["plain words " * 30], 20, 96)
    assert len(odd.inside(windows)[0]) == 20


def test_pii_query(spark, tmp_path):
    """The base columns of the query against the contract's patterns."""
    rng = random.Random(22)
    parts = ["mail", "a.b@c.org", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "\n", "@", "12", " "]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(30)), "en", "s", 1) for i in range(150)] + [(900, None, "en", "s", 0), (901, "", None, None, None), (None, "x@y.org", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        spans = plain_base(text or "")
        assert tuple(got[i][f"n_{k}"] for k in pii.KINDS) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        every = [x for x in got[i]["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(every)


def test_pii_rows(make, odd_rows):
    out = pii.find_personal_data(make([*odd_rows, (60, "write to me@example.org")]), pii._trained((), 3)).collect()
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in out}
    assert len(out) == len(odd_rows) + 1 and got[60] == [("email", 9, 23)] and got[5] == []


# -- languages -----------------------------------------------------------------------------------------------------------
def test_language(spark, sf):
    out = language_id.op4_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd(make, odd_rows):
    docs = make(odd_rows)
    model = language_id.KernelRidge.fit(language_id.sample(docs))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert got[5] == got[6] == got[7] == ("und", 0.0) and got[1][0] == "en"
    assert language_id.KernelRidge.fit([]).predict(["x"]) == [("und", 0.0)]
    assert language_id.predict(make([]), model).count() == 0


def test_language_of_long_texts(spark, sf):
    """A text of a million characters is told by all its segments; its first part alone would say something else."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.KernelRidge.fit(language_id.sample(docs))
    by = {x: " ".join(r["text"] for r in docs.where(F.col("lang") == x).orderBy("doc_id").collect()) for x in ("fr", "de")}
    long = by["fr"][:9000] + (by["de"] * 9)[:1_000_000]
    assert [x for x, _ in model.predict([long, by["fr"], "", by["de"]])] == ["de", "fr", "und", "de"]


def test_language_by_brute_force(spark, sf):
    """The query's rows are those of the kernel with plain sets of n-grams and the ridge solved anew."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(t[: language_id.SEGMENT], x) for t, x in language_id.sample(docs.where("lang in ('en', 'fr')"), 12)]
    model = language_id.KernelRidge.fit(rows, per_lang=4)
    buckets = [set(np.flatnonzero(language_id.presence([t])[0]).tolist()) for t, _ in rows]
    first = [k for x in ("en", "fr") for k in [k for k, r in enumerate(rows) if r[1] == x][:4]]

    def plain(a, b):
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    k = np.array([[plain(a, buckets[m]) for m in first] for a in buckets])
    n = Counter(x for _, x in rows)
    share = np.array([1 / n[x] for _, x in rows])[:, None]
    y = np.array([[1.0 if x == lang else -1.0 for lang in ("en", "fr")] for _, x in rows])
    weights = np.linalg.solve(k.T @ (share * k) + language_id.RIDGE * k[first] + 1e-9 * np.eye(len(first)), k.T @ (share * y))
    want = [("en", "fr")[int(s.argmax())] for s in k @ weights]
    assert [x for x, _ in model.predict([t for t, _ in rows])] == want
    assert np.abs(model.weights - weights).max() < 1e-2 * np.abs(weights).max()


def test_many_languages(spark):
    """A dirty lang column can't make the fit grow without bound, and each language that has a text is learnt."""
    rows = [(i, f"word{i} text", f"lang{i % 700}") for i in range(2000)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=512)
    assert len({x for _, x in got}) == 512 and len(got) <= 512
    rng = random.Random(6)
    words_ = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(400)}
    rows = [(400 * n + k, " ".join(rng.choice(words_[k]) for _ in range(60)), f"lang{k}") for n in range(4) for k in range(400)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = language_id.KernelRidge.fit(got)
    assert len(model.langs) == 400 and len(got) <= language_id.ROWS and len(model.marks) <= language_id.MARKS
    fresh = [(" ".join(rng.choice(words_[k]) for _ in range(60)), f"lang{k}") for k in range(400)]
    assert np.mean([p == x for (p, _), (_, x) in zip(model.predict([t for t, _ in fresh]), fresh)]) > 0.95


def test_language_without_letters_and_ties(make):
    """Number signs are no letters; of equal languages the first in alphabetical order is predicted."""
    model = language_id.KernelRidge.fit([("one text", "b"), ("one text", "a"), ("one text", "c")])
    assert [x for x, _ in model.predict(["one text", "½ ² ①", "12 %", "Ⅷ ½", "ª", "字"])] == ["a", "und", "und", "und", "a", "a"]


def test_language_query_by_brute_force(spark, sf):
    """All rows of the query are those of plain sets of n-grams, a kernel of set sizes and a ridge solved with all targets written out."""
    import zlib

    from quillon.llm.language_id import LENGTHS, RIDGE, SEGMENT

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = language_id.sample(docs.where("coalesce(crc32(cast(doc_id as string)) % 3, 0) <> 1"))

    def bucket(gram):
        h = 0
        for n, c in enumerate(gram):
            h = (h * 0x9E3779B1 ^ (ord(c) + n * 0x632BE5AB)) % 2**32
        return ((h ^ h >> 15) * 0x85EBCA6B % 2**32) >> (32 - language_id.BUCKETS.bit_length() + 1)

    def held(part):
        low = part.lower()
        return {bucket(low[i : i + n]) for n in LENGTHS for i in range(len(low) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) for y in b] for x in a])

    langs = sorted({x for _, x in fitted})
    marks = [held(t) for lang in langs for t in [t for t, x in fitted if x == lang][: language_id.LANDMARKS]]
    k = kernel([held(t) for t, _ in fitted], marks)
    n = Counter(x for _, x in fitted)
    share = np.array([1 / n[x] for _, x in fitted])[:, None]
    y = np.array([[1.0 if x == lang else -1.0 for lang in langs] for _, x in fitted])
    weights = np.linalg.solve(k.T @ (share * k) + RIDGE * kernel(marks, marks) + 1e-9 * np.eye(len(marks)), k.T @ (share * y))
    out = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf).collect()}
    close = 0
    for r in docs.collect():
        text, got = r["text"] or "", out[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        parts = [text[a : a + SEGMENT] for a in range(0, len(text), SEGMENT)]
        scores = np.average(kernel([held(p) for p in parts], marks) @ weights, axis=0, weights=[len(p) for p in parts])
        sure = float(1 / np.exp(4 * (scores - scores.max())).sum())
        near = np.sort(scores)[-1] - np.sort(scores)[-2] < 1e-3  # as single precision may have it
        close += near
        assert near or got["lang_pred"] == langs[int(scores.argmax())]
        assert got["score"] == pytest.approx(sure, abs=5e-3)
    assert len(out) == docs.count() and close < 0.02 * len(out)


def test_kernel_is_presence():
    rows = language_id.presence(["abcabc", "abc", "xyz", ""])
    assert (rows[0] >= rows[1]).all() and language_id.kernel(rows[1:2], rows[1:2])[0, 0] == pytest.approx(1)
    assert rows[3].sum() == 0


# -- quality -------------------------------------------------------------------------------------------------------------
def _auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("half", [0, 1])
def test_quality_held_out(spark, half):
    """Learnt from half of the labels, right on the other half; the rounds bring rows of the whole table, help the weaker view and do not harm the score."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows, known = quality_classifier.written_features(docs), labels.where(f"doc_id % 2 = {half}")

    def held(**named):
        out = quality_classifier.classify(rows, quality_classifier.co_train(rows, known, **named)).join(labels.where(f"doc_id % 2 <> {half}"), "doc_id").toPandas()
        return [_auc(out[c].to_numpy(), out.quality.to_numpy()) for c in ("score", "p_text", "p_meta")]

    assert held(labelled=150, pseudo=20)[0] > 0.95
    none, some = held(rounds=0), held(rounds=4)
    assert some[0] > 0.97 and some[0] >= none[0] - 0.001 and some[1] >= none[1] + 0.02 and some[2] >= none[2] - 0.001


def test_quality_query_by_brute_force(spark, sf):
    """All rows of the query are those of the same rounds over lists: every row scored and sorted in each round."""
    q = quality_classifier
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.features(docs).select("*", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"), F.xxhash64("words", "meta", "tags").alias("tie")).collect()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    known = sorted((r for r in rows if r["doc_id"] in quality), key=lambda r: (r["h"], r["doc_id"]))[: q.LABELLED]
    y = np.array([quality[r["doc_id"]] for r in known], float)
    held, learn = list(range(len(known)))[2::3], [k for k in range(len(known)) if k % 3 != 2]
    low = min(q.PSEUDO - 1, max(1, round(q.PSEUDO * (1 - y[learn].mean()))))
    mine = [[(y[k], known[k]) for k in learn] for _ in range(2)]
    taken = [{r["doc_id"] for r in known} for _ in range(2)]

    def odds(k, view, some):
        words_, meta, tags = q._arrays(some)
        return view.odds(*q._sparse_rows(words_)) if k == 0 else view.odds(meta, tags)

    def learnt(k):
        words_, meta, tags = q._arrays([r for _, r in mine[k]])
        target, weight = np.array([t for t, _ in mine[k]]), np.array([1.0] * len(learn) + [q.TRUST] * (len(mine[k]) - len(learn)))
        view = (q.TextView, q.MetaView)[k]()
        view.fit(q._sparse_rows(words_)[0], q._sparse_rows(words_)[1], target, weight) if k == 0 else view.fit(meta, tags, target, weight)
        o, t = odds(k, view, [known[i] for i in held]), y[held]
        platt = q._platt(o, t)
        p = q._sigmoid(platt[0] * o + platt[1])
        return view, platt, -np.mean(np.log(np.where(t > 0, p, 1 - p).clip(1e-6)))

    state = [learnt(k) for k in range(2)]
    for _ in range(q.ROUNDS):
        found = []
        for k in range(2):
            bound = q._sure(odds(k, state[k][0], [known[i] for i in held]), y[held])
            every = [(o, r) for o, r in zip(odds(k, state[k][0], rows).round(9), rows) if r["doc_id"] not in taken[k]]
            least = sorted(((o, r["h"], r["doc_id"], r["tie"]), r) for o, r in every if o <= bound[0])[:low]
            most = sorted(((-o, r["h"], r["doc_id"], r["tie"]), r) for o, r in every if o >= bound[1])[: q.PSEUDO - low]
            found.append([(0.0, r) for _, r in least] + [(1.0, r) for _, r in most])
        gained = False
        for k in range(2):
            taken[k] |= {r["doc_id"] for _, r in found[k]}
        for k in range(2):
            before = len(mine[k])
            mine[k] = mine[k] + found[1 - k]
            new = learnt(k) if found[1 - k] else None
            if new and new[2] <= state[k][2]:
                state[k], gained = new, True
            else:
                mine[k] = mine[k][:before]
        if not gained:
            break
    weight = np.array([1 / (s[2] + 1e-3) for s in state])
    each = [s[1][0] * odds(k, s[0], rows) + s[1][1] for k, s in enumerate(state)]
    score = q._sigmoid((weight / weight.sum()) @ np.array(each))
    out = {r["doc_id"]: r for r in q.op9_quality_classifier(spark, sf).collect()}
    assert len(out) == len(rows)
    for r, s, a, b in zip(rows, score, *map(q._sigmoid, each)):
        got = out[r["doc_id"]]
        assert (got["score"], got["p_text"], got["p_meta"]) == pytest.approx((s, a, b), abs=2e-5)
        assert got["kept"] == (got["score"] >= 0.5)


def test_surest_rows(spark):
    """What a round brings back is what sorting all unlabelled rows would."""
    sf = "/root/testdata/sf0.001"
    rows = quality_classifier.written_features(spark.read.parquet(f"{sf}/documents.parquet")).repartition(7)
    rng = np.random.default_rng(3)
    text, page = quality_classifier.TextView(rng.normal(size=quality_classifier.BUCKETS + 1)), quality_classifier.MetaView(rng.normal(size=2 * len(quality_classifier.META) + quality_classifier.TAIL + 1))
    some = rows.collect()
    words_, meta, tags = quality_classifier._arrays(some)
    done = {some[0]["doc_id"], some[1]["doc_id"]}
    got = quality_classifier.surest(rows, text, page, 5, 9, (done, set()), [(np.inf, -np.inf)] * 2)
    none = quality_classifier.surest(rows, text, page, 5, 9, (done, set()), [(-np.inf, np.inf), (-np.inf, -np.inf)])
    assert none[0] == [] and [x for x, _ in none[1]] == [1] * 9
    for view, odds in enumerate((text.odds(*quality_classifier._sparse_rows(words_)), page.odds(meta, tags))):
        order = [int(k) for k in np.argsort(odds.round(9), kind="stable") if view or some[k]["doc_id"] not in done]
        limit = {0: odds[order[4]], 1: odds[order[-9]]}
        for label, most in ((0, 5), (1, 9)):
            ids = {r["doc_id"] for x, r in got[view] if x == label}
            want = {some[k]["doc_id"] for k in order if (odds[k] <= limit[0] + 1e-8 if label == 0 else odds[k] >= limit[1] - 1e-8)}
            assert ids <= want and len(ids) == most


def test_quality_odd(spark, make, odd_rows):
    docs = make(odd_rows)
    none = spark.createDataFrame([(None, 1), (999, 0), (1, None)], "doc_id long, quality int")
    rows = quality_classifier.written_features(docs)
    out = quality_classifier.classify(rows, quality_classifier.co_train(rows, none)).collect()
    assert len(out) == len(odd_rows) and {r["score"] for r in out} == {0.5}
    some = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (7, 0), (13, 1)], "doc_id long, quality int")
    first, again = (sorted((r["doc_id"] or -1, r["score"]) for r in quality_classifier.classify(rows.repartition(n), quality_classifier.co_train(rows.repartition(n), some, pseudo=4)).collect()) for n in (1, 5))
    assert first == again
    empty = quality_classifier.written_features(make([]))
    assert quality_classifier.classify(empty, quality_classifier.co_train(empty, none)).count() == 0
