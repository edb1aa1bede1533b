"""Line dedup, quality rules and mixing on odd rows, against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import line_dedup, mixing, quality_rules

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = -(2**63)


def key(line):
    return line.strip(SPACE).translate(LOW)


def lines(text):
    return (text or "").split("\n")


def words(text):
    out = (text or "").translate(str.maketrans(SPACE, " " * 6)).split(" ")
    return [w for w in out if w]


def test_line_dedup(make, odd_rows):
    twice = "a line that one document holds, given three times\nx"
    odd_rows = [*odd_rows, (60, twice), (60, twice), (60, twice), (61, twice)]
    docs = make(odd_rows)
    holders = defaultdict(set)
    for i, t, *_ in odd_rows:
        for k in {key(x) for x in lines(t)}:
            if len(k) >= 20:
                holders[k].add(BIG if i is None else i)
    want = Counter()
    for i, t, *_ in odd_rows:
        me = BIG if i is None else i
        gone = [len(holders[key(x)]) >= 3 and len(key(x)) >= 20 and me < max(holders[key(x)]) for x in lines(t)]
        want[i, "\n".join(x for x, g in zip(lines(t), gone) if not g) if any(gone) else t] += 1
    for batches, fan_in in ((4, 2), (1, 2), (7, 3)):
        out = line_dedup.drop_repeated_lines(docs, batches=batches, fan_in=fan_in)
        assert out.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def test_line_dedup_levels(make):
    runs = line_dedup.LineRuns(fan_in=2)
    for i in range(5):
        runs.add(make([(i, "a line that is long enough to count\nx"), (10 + i, f"another line of number {i} in the text")]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [(r["n_docs"] if "n_docs" in r else None, r["last_doc"]) for r in runs.repeated().collect()] == [(None, 4)]


def plain_repeat(w, size=8):
    grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    n = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + size))
    return len(hit)


def test_quality_base(make, odd_rows):
    rows = [*odd_rows, (30, "a b c d e f g h " * 6), (31, "x y " * 30 + "#*$"), (32, "one two\none two\n\n\n one two")]
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.verdicts(make(rows)).collect()}
    want = set()
    for i, t, *_ in rows:
        w, full = words(t), [x for x in lines(t) if words(x)]
        r = plain_repeat(w)
        want.add((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), r, len(w) < 20 or 100 * r > 30 * len(w)))
    assert got == want


def test_quality_rejects_depleted(make):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)]
    boiler = " ".join(f"terms{j}" for j in range(30))
    rows = [*clean, *[(100 + i, boiler + f"\nown words {i}") for i in range(25)], *[(200 + i, boiler + "\n" + " ".join(f"v{i}x{j}" for j in range(30))) for i in range(5)]]
    kept = {r["doc_id"] for r in quality_rules.keep_good(make(rows)).collect()}
    assert kept == {i for i, _ in clean} | {200 + i for i in range(5)}


def test_mixing(make):
    rows = [(s * 1000 + i, "w " * (1 + (i * 7 + s) % 40), "en", f"src{s}") for s in range(5) for i in range(20 * (s + 1) ** 2)]
    rows += [(9000 + i, "a b c", None, None) for i in range(10)] + [(None, "x y", "en", "src1"), (9100, None, "en", "src2"), (9101, "", "en", "empty")]
    docs = make(rows)
    out = mixing.taken(docs).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for i, t, *rest in rows:
        size[rest[1] if rest else "s1"] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(size.values())), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    by = {r["doc_id"]: r for r in out}
    got, largest = defaultdict(int), defaultdict(int)
    for i, t, *rest in rows:
        r, s = by[i], rest[1] if rest else "s1"
        assert r["size"] == len(words(t)) and r["source_size"] == size[s]
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["times"] <= 3
        got[s] += r["size"] * r["times"]
        largest[s] = max(largest[s], r["size"])
    for s in order:
        assert abs(got[s] - target[s]) <= largest[s]
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == Counter({r["doc_id"]: r["times"] for r in out if r["times"]})


def test_quality_counts_documents(make):
    """25 copies of one row are one document: its lines are held by one, and nothing goes."""
    text = " ".join(f"w{j}" for j in range(40)) + "\n" + " ".join(f"v{j}" for j in range(30))
    rows = [(1, text)] * 25 + [(2 + i, " ".join(f"x{i}y{j}" for j in range(40))) for i in range(9)]
    out = quality_rules.keep_good(make(rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t) for i, t in rows)


def test_quality_removes_lines(make, odd_rows):
    """Lines above the host's limit are gone from what is passed on; all other columns are as they were."""
    line = "Subscribe to our letter"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + ("\n" + line.upper() + " \nend" if i < 4 else "")) for i in range(12)]
    docs = make(rows)
    out = {r["doc_id"]: r for r in quality_rules.keep_good(docs).collect()}
    for i, t in rows:
        want = t.replace(line.upper() + " \n", "").replace("\nend", "") if i < 4 else t
        assert out[i]["text"] == want and out[i]["n_chars"] == len(want) and out[i]["__q_row"] == "r" and out[i]["a.b"] == "dot"


@pytest.mark.parametrize("run", [line_dedup.drop_repeated_lines, quality_rules.keep_good, mixing.mix])
def test_empty(make, run):
    docs = make([])
    out = run(docs)
    assert out.columns == docs.columns and out.count() == 0


def test_digests(make, odd_rows, spark, tmp_path):
    make([r for r in odd_rows if r[0] is not None]).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert out[5]["n_lines"] == 1 and out[5]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[9]["n_lines"] == 3000 and out[9]["n_dropped"] == 0
