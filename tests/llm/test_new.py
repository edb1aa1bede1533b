"""Fill-in-the-middle, whitening and URL filters on odd rows, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import fill_middle, url_filter, whitening


# -- fill-in-the-middle --------------------------------------------------------------------------------------------------
def plain_cut(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(make, odd_rows):
    marks = ["<<P", "a<S", "S>x<M", "has <P> inside", "<S>", "x<M>", "P><S", "é𝒳 ß𝒳<", "a­b c\u0000d"]
    rows = [*odd_rows, *((1000 + 40 * k + j, t) for k, t in enumerate(marks) for j in range(40)), *((k, "one text held by many documents") for k in range(5000, 5400))]
    out = fill_middle.cut(make(rows)).withColumn("text", fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form"))).collect()
    want = [(*plain_cut(i, t), t or "") for i, t, *_ in rows]
    assert Counter(map(tuple, out)) == Counter(want)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.cut(make([])).count() == 0


def test_index_has_each_text_once(make, odd_rows):
    rows = [*odd_rows, *((k, "one text held by many documents") for k in range(100, 200))]
    index = fill_middle.index(make(rows).repartition(7)).collect()
    texts = {t or "" for _, t, *_ in rows}
    assert len(index) == len(texts)
    found = {bytes(r["key"]): r for r in index}
    for t in texts:
        r = found[hashlib.sha256(t.encode()).digest()]
        ends = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)]
        step = max(1, len(ends) // 50)
        assert r["n"] == len(ends) and all(fill_middle.select(k, r["low_bits"], r["low"], r["high"]) == ends[k - 1] for k in range(1, len(ends) + 1, step))
        assert len(r["low"]) + len(r["high"]) <= len(ends) * (2 + math.log2(max(len(t), 1) / max(len(ends), 1))) / 8 + 4  # what an Elias-Fano list may take


# -- whitening -----------------------------------------------------------------------------------------------------------
def plain_whitened(vectors):
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    f = np.array(fit, float)
    c = f - f.mean(axis=0)
    values, turn = np.linalg.eigh(c.T @ c / len(fit))
    values, turn = values[::-1], turn[:, ::-1]
    s = [sum(r[i] for r in fit) for i in range(len(fit[0]))]
    far = [sum((len(fit) * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    return len(fit), far, values, (np.array(x, float) - f.mean(axis=0)) @ turn / np.sqrt(np.maximum(values, 1e-300))


def whitened(spark, rows):
    return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, `x` string, `n` int"))


def table_of(rng, n, d):
    spread = np.linspace(1, 0.05, d)
    return [[float(np.float32(v)) for v in r] for r in rng.standard_normal((n, d)) * spread]


@pytest.mark.parametrize("n,d", [(400, 24), (90, 3), (500, 40), (6, 30), (40, 1)])
def test_whitening(spark, n, d):
    good = table_of(np.random.default_rng(n), n, d)
    bad = [None, [], [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [0.5] * (d + 1)]
    rows = [(i, v, "x", 1) for i, v in enumerate([*good, *good[:5], *([good[0]] * 30)])] + [(None, good[1], None, None)] + [(10_000 + i, v, "x", 1) for i, v in enumerate(bad)]
    out = whitened(spark, rows).collect()
    kept = [(i, v) for i, v, *_ in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    m, far, values, z = plain_whitened([v for _, v in kept])
    k = min(4, d, m - 1)
    assert len(out) == k * len(kept) and {r["n"] for r in out} == {m}
    assert {r["component"] for r in out} == set(range(1, k + 1))
    want = Counter((i, f) for (i, _), f in zip(kept, far) for _ in range(k))
    assert Counter((r["vec_id"], r["deviation"]) for r in out) == want and all(r["deviation_text"] == str(r["deviation"]) for r in out)
    trace = values.sum()
    one = {(r["vec_id"], r["component"]): r for r in out if r["vec_id"] is not None}
    for j in range(k):
        mine = np.array([one[i, j + 1]["whitened"] for i, _ in kept if i is not None])
        theirs = np.array([z[p, j] for p, (i, _) in enumerate(kept) if i is not None])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8 * np.abs(theirs).max()
        assert abs(one[kept[0][0], j + 1]["explained"] / (values[j] / trace) - 1) < 1e-9
    assert max(r["identity_error"] for r in out) < 1e-9 and max(r["residual"] for r in out) <= whitening.ROUNDING


def test_whitening_of_nothing(spark):
    assert whitened(spark, []).count() == 0
    assert whitened(spark, [(1, [0.5, 0.25], "x", 1)]).count() == 0
    assert whitened(spark, [(i, [0.5, 0.25], "x", 1) for i in range(5)]).count() == 0
    assert whitened(spark, [(1, None, "x", 1)]).columns[:3] == ["vec_id", "component", "n"]


def test_whitening_of_ties_and_huge_numbers(spark):
    corners = [[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    out = whitened(spark, [(i, v, "x", 1) for i, v in enumerate(corners)]).collect()
    assert len(out) == 24 and all(abs(r["explained"] - 1 / 3) < 1e-12 and r["deviation"] == 3 * 64 * 128 * 128 * 4 / 4 for r in out)
    huge = [[3.0e38, 0.0], [1.0, 2.0], [-3.0e38, 5.0]]
    out = whitened(spark, [(i, v, "x", 1) for i, v in enumerate(huge)]).collect()
    top, low = 2**63 - 1, -(2**63)
    s = [top + 256 + low, 0 + 512 + 1280]
    want = [sum((3 * a - b) ** 2 for a, b in zip(x, s)) for x in ([top, 0], [256, 512], [low, 1280])]
    assert {r["vec_id"]: r["deviation_text"] for r in out} == {i: str(w) for i, w in enumerate(want)}
    assert [r["deviation"] for r in out] == [w if w < 2**63 else None for w in want for _ in range(len(out) // 3)]


def test_lobpcg_against_dense():
    rng = np.random.default_rng(5)
    for d, spread in ((64, np.r_[np.linspace(9, 5, 9), np.full(55, 1.0)]), (200, 0.97 ** np.arange(200)), (30, np.r_[4.0, 4.0, 4.0, 4.0, np.ones(26)]), (20, np.zeros(20))):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = (q * spread) @ q.T
        found = whitening.lobpcg(lambda b: a @ b, d)
        assert np.abs(found.values - np.sort(spread)[::-1][:4]).max() <= 1e-12 * max(spread.max(), 1)
        assert found.residual <= whitening.ROUNDING and np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-12


# -- URL filters ---------------------------------------------------------------------------------------------------------
URLS = [
    None, "", "no scheme.example.net/en/x", "http://", "https://EXAMPLE.NET/en/", "https://example.net/en", "http://a.example.net/EN/x?y", "http://xnet/", "http://net/", "http://net", "http://a.net:80/", "http://org/fr/#x",
    "ftp://b.example.com/de/9?x=://q.net/", "http://b.example.com/de", "http://www.cheappills.example.com/en/12.html", "http://freebets.example.com/fr/win-now", "http://cheap-pills.example.org/en/1", "http://café-poker.example.org/es/",
    "http://quietgarden.example.com/en/7", "http://quietgarden.example.com/en/8", "http://m.gardennews.example.org/en/quietnews", "http://threads.example.com/es/1", "http://news.example.org/en/threads#casino", "x://" + "ab" * 40 + ".com/" + "q/" * 300,
    "http://\nnews\n.example.com/en/\n?x", "http://news.example.com?garden", "http://news.example.com#/de/", "http://gardenpoker.example.com/en/win",
]
TEXTS = ["the quiet garden news and the cheap free threads win", "Garden garden NEWS now a quiet thread", None, "", "the the the ads", "word" * 9]


def plain_split(name, counts, total):
    """Every split of a short name, the best by log-probability, fewest words, longest last words."""
    unit = 1 << 20
    best = None
    for cut in range(1 << (len(name) - 1)):
        ends = [i + 1 for i in range(len(name) - 1) if cut >> i & 1] + [len(name)]
        words = [name[a:b] for a, b in zip([0, *ends], ends)]
        p = sum(round(unit * math.log(counts[w] / total)) if counts.get(w) and len(w) <= url_filter.WORD else round(unit * math.log(10 / total)) - len(w) * round(unit * math.log(10)) for w in words)
        one = (p, -len(words), [len(w) for w in words[::-1]])
        if best is None or one > best[0]:
            best = (one, words)
    return best[1]


def plain_judge(pages, texts):
    counts = Counter(w for t in texts if t for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) <= 20)
    total = sum(counts.values())
    each = max(1, total // 10_000)
    counts.update({w: each for w in url_filter.LEXICON})
    total += each * len(url_filter.LEXICON)
    seen = {}
    rows = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text)) if fits else None
        words = []
        for name in re.findall(r"[^\W\d_]+", (host + "/" + path).lower()):
            if len(name) > 63:
                words.append("#" + hashlib.md5(name.encode()).hexdigest())
            else:
                if name not in seen:
                    seen[name] = plain_split(name, counts, total) if len(name) < 14 else [name]
                words += seen[name]
        rows.append((i, host, path, rule, words))
    classes = {True: Counter(), False: Counter()}
    docs = Counter()
    for _, _, _, rule, words in rows:
        if rule is None or rule.verdict != "block":
            bad = bool(set(words) & set(url_filter.LEXICON))
            docs[bad] += 1
            classes[bad].update(words)
    v = len(set(classes[True]) | set(classes[False]))
    nb, na = sum(classes[True].values()), sum(classes[False].values())
    odds = {w: math.log((classes[True][w] + 1) / (nb + v)) - math.log((classes[False][w] + 1) / (na + v)) for w in set(classes[True]) | set(classes[False])}
    prior = math.log((docs[True] + 1) / (docs[False] + 1))
    for i, host, path, rule, words in rows:
        score = prior + sum(odds.get(w, 0) for w in words)
        yield i, host, path, rule.text if rule else None, rule.verdict if rule else "block" if score > 1e-6 else "allow", " ".join(words), round(score, 3)


def judged(spark, pages, texts):
    df = spark.createDataFrame([(i, u, "<p>", "x") for i, u in pages], "page_id long, url string, html string, word string")
    out = url_filter.judge(df, spark.createDataFrame([(t, 1) for t in texts], "text string, n int")).collect()
    return Counter((*r[:6], round(r["score"], 3)) for r in out)


def test_url_filter(spark):
    pages = [*enumerate(URLS), (None, URLS[14]), (3, URLS[3]), *((100 + k, f"http://hot.example.com/en/{k}") for k in range(80))]
    want = Counter(plain_judge(pages, TEXTS))
    assert judged(spark, pages, TEXTS) == want
    verdicts = {i: (verdict, words) for i, _, _, _, verdict, words, _ in want}
    assert verdicts[14] == ("block", "www cheap pills example com en html") and verdicts[15][1].startswith("free bets example")
    assert verdicts[18] == ("allow", "quiet garden example com en") and verdicts[21][1] == "threads example com es" and verdicts[27][0] == "block"


def test_url_filter_of_nothing(spark):
    assert judged(spark, [], TEXTS) == Counter()
    assert judged(spark, [(1, None), (2, "http://casino.example.com/")], []) == Counter(plain_judge([(1, None), (2, "http://casino.example.com/")], []))


def test_split_is_the_likeliest():
    counts = {"the": 50, "he": 20, "red": 10, "there": 9, "d": 4, "a": 30, "are": 12, "tare": 1}
    for name in ("thered", "theared", "xthe", "aaa", "tare", "redthexx", "q"):
        found = {(a, b): counts[name[a:b]] for a in range(len(name)) for b in range(a + 1, len(name) + 1) if name[a:b] in counts}
        assert url_filter.split(name, found, 1000) == plain_split(name, counts, 1000)
