"""Decontamination, the n-gram join and suffix dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from helpers import prose
from quillon.llm import decontamination, ngram_join, suffix_dedup
from quillon.llm.components import components

BIG = -(2**63)


def toks(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text or "").split()


def shingles(text, n=5):
    t = toks(text)
    k = min(n, len(t))
    return [tuple(t[i : i + k]) for i in range(len(t) - k + 1)] if t else []


# -- decontamination -----------------------------------------------------------------------------------------------------
def test_leaks(spark, make, odd_rows):
    rng = random.Random(8)
    items = [prose(rng, 70), prose(rng, 30), "short item", prose(rng, 12)]
    w = items[0].split()
    w[66] = "other"
    rows = [*odd_rows, (40, prose(rng, 50) + "\n" + items[0].upper() + ". " + prose(rng, 50)), (41, " ".join(w)), (42, prose(rng, 9) + " " + items[1] + " " + items[3]), (43, items[0][:200]), (44, "a Short, item here"), (45, items[0].rsplit(" ", 1)[0]), (46, "")]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (11, items[1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(make(rows), bench).collect()}
    want = {}
    for i, text, *_ in rows:
        t = toks(text)
        for j, item in [*enumerate(items), (11, items[1])]:
            q, k = Counter(shingles(item)), min(5, len(toks(item)))
            n = len(toks(item))
            for a in range(max(1, len(t) - n + 1)):
                part = t[a : a + n]
                c = Counter(tuple(part[x : x + k]) for x in range(len(part) - k + 1))
                s = sum((c & q).values()) / sum((c | q).values())
                if s >= 0.8:
                    want[i, j] = max(want.get((i, j), 0), round(s, 6))
    assert got == want and {(41, 0), (44, 2), (45, 0)} <= set(want)
    left = decontamination.drop_contaminated(make(rows), bench)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, *_ in rows if not any(i == d for d, _ in want))
    assert decontamination.leaks(make([]), bench).count() == decontamination.leaks(make(rows), bench.limit(0)).count() == 0


def test_multi_index_is_complete():
    """Every fingerprint within the radius is a candidate."""
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 1 << 60, 20).astype(np.uint64) for _ in range(40)]
    index = decontamination.ItemIndex(list(range(40)), tokens)
    prints, tables = index.prints, index.tables
    for bits in range(decontamination.RADIUS + 1):
        for k in range(40):
            mask = np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            block = np.array([prints[k] ^ mask]).view(np.uint16)
            near = tables[0][block[0]] | tables[1][block[1]] | tables[2][block[2]] | tables[3][block[3]]
            assert np.unpackbits(near)[k]


def test_blocks_of_items(make, monkeypatch):
    """More items than a block holds, of many lengths, and none of the documents' shingles lost by the filter."""
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(decontamination, "GROUP_SHINGLES", 300)
    rng = random.Random(9)
    items = [prose(rng, 6 + k) for k in range(30)]
    rows = [(k, prose(rng, 12) + " " + t + " " + prose(rng, 8)) for k, t in enumerate(items)] + [(100 + k, prose(rng, 40)) for k in range(20)]
    bench = make(rows).sparkSession.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(make(rows), bench).collect()}
    assert got == {(k, k) for k in range(30)}


# -- n-gram join ---------------------------------------------------------------------------------------------------------
def plain_classes(rows):
    sets = [set(shingles(t)) for _, t, *_ in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
            elif not a and not b and rows[i] == rows[j]:
                up[find(i)] = find(j)
    ids = [BIG if r[0] is None else r[0] for r in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return Counter((ids[i], least[find(i)], links[i]) for i in range(len(rows)))


@pytest.fixture(scope="module")
def near_rows(odd_rows):
    rng = random.Random(5)
    rows = list(odd_rows)
    for g in range(6):
        seed = prose(rng, 200).split()
        for i in range(rng.choice([2, 5, 40])):
            w = list(seed)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            rows.append((1000 * (g + 1) + i, " ".join(w)))
    return rows


def test_join(make, near_rows):
    docs = make(near_rows)
    got = Counter((r["__q_id"], r["class_id"], r["n_links"]) for r in ngram_join.classes(docs).collect())
    assert got == plain_classes(near_rows)


def test_join_in_chunks(make, near_rows, monkeypatch):
    """Groups above the chunk limits give the same links, each counted once."""
    for name, value in (("CHUNK", 7), ("BUCKET_CHUNK", 5), ("SALT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    got = Counter((r["__q_id"], r["class_id"], r["n_links"]) for r in ngram_join.classes(make(near_rows)).collect())
    assert got == plain_classes(near_rows)


def test_keep_one(make, near_rows):
    docs = make(near_rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, _ in plain_classes(near_rows)}
    assert Counter(BIG if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == Counter(want)
    assert ngram_join.keep_one(make([])).count() == 0


def test_recall_on_planted_pairs(make):
    """Of 1000 pairs with a similarity of just above 0.8 and 200 of more, all are linked."""
    rng = random.Random(31)
    rows, links = [], set()
    for k in range(1200):
        w = prose(rng, 60).split()
        while True:  # of 56 shingles 6 change, so the similarity is 50 / 62
            v = list(w)
            n = 6 if k < 1000 else 1
            v[60 - n :] = prose(rng, n).split()
            a, b = set(shingles(" ".join(w))), set(shingles(" ".join(v)))
            if len(a & b) >= 0.8 * len(a | b):
                break
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {(r["__q_id"], r["class_id"]) for r in ngram_join.classes(make(rows)).collect()}
    assert got == {(i, i - i % 2) for i in range(2400)}


def test_prefix_stops_at_the_target(spark):
    """Links that are all alike need no short prefixes; links at the limit need the shortest."""
    near = spark.createDataFrame([(1, 2, 0.99)] * 50, ngram_join.LINK)
    edge = near.unionByName(spark.createDataFrame([(3, 4, 0.8)], ngram_join.LINK))
    assert ngram_join.estimated_recall(near, 0.8, 8)[8] > 0.9999 > ngram_join.estimated_recall(edge, 0.8, 5)[5] and ngram_join.estimated_recall(edge, 0.8, 4)[4] > 0.9999
    said = ngram_join.estimated_recall(edge, 0.8, 8)
    assert said[4] > 0.9999 > said[5] > said[8] and list(said.values()) == sorted(said.values(), reverse=True)
    assert set(ngram_join.estimated_recall(near.limit(0), 0.8, 8, 4).values()) == {1}


def test_differences_count_common_shingles():
    """Similarities from differences to a root are those of the whole sets."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = [base] + [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 61), False), rng.integers(0, 40, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(40)]
    diffs = [np.concatenate([np.setdiff1d(base, s), np.setdiff1d(s, base) ^ ngram_join._MORE]) for s in sets]
    got = {(i, j) for i, others in ngram_join._pairs(diffs, np.array([len(s) for s in sets]), len(base), np.zeros(len(sets), int), True, 0.8) for j in others.tolist()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert got == want and want


def test_prefix_is_shortened():
    assert ngram_join.prefix_length() == 4
    assert ngram_join.prefix_length(similarity=0.99) == 8 and ngram_join.prefix_length(similarity=0.1) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(200, 200)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(25)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in up}


# -- suffix dedup --------------------------------------------------------------------------------------------------------
def plain_suffix(rows):
    least = {}
    texts = [(BIG if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, i), i)
    out = Counter()
    for i, b in texts:
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                mark[k : k + 50] = b"\1" * 50
        out[None if i == BIG else i, bytes(c for c, m in zip(b, mark) if not m), sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1]))] += 1
    return out


def test_suffix_dedup(make, near_rows):
    rows = suffix_rows(near_rows)
    got = Counter((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.dedup(make(rows)).collect())
    assert got == plain_suffix(rows)
    assert suffix_dedup.dedup(make([])).count() == 0


def test_suffix_dedup_across_batches(make):
    """Each document in a batch of its own: all that is shared is found by the exchange."""
    rng = random.Random(16)
    passage, other = prose(rng, 30), prose(rng, 14)
    rows = [(i, prose(rng, 15) + " " + passage[: 60 + 9 * i] + " " + prose(rng, 9) + (" " + other + " x " + other if i % 3 == 0 else "") + " " + prose(rng, 8)) for i in range(9)]
    rows += [(20, other + " y " + other + " z " + passage), (21, passage), (22, passage)]
    got = Counter((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.dedup(make(rows).repartition(len(rows), "doc_id")).collect())
    assert got == plain_suffix(rows)


def test_loser_tree():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(rng.randint(0, 40))) for _ in range(7)]

    def coded(run):
        shared, rests = suffix_dedup.front_coded(run)
        return iter([(n, r, None) for n, r in zip(shared, rests)])

    merged = list(suffix_dedup.LoserTree([coded(r) for r in runs]))
    assert [s for _, s, _ in merged] == sorted(x for r in runs for x in r)
    last = b""
    for n, s, _ in merged:
        assert n == suffix_dedup.common(last, s, 0)
        last = s


@pytest.mark.parametrize("anchors", [suffix_dedup.window_anchors, suffix_dedup.window_grams])
def test_windows_have_equal_anchors(anchors):
    rng = random.Random(3)
    w = bytes(rng.randrange(97, 105) for _ in range(50))
    offsets = set()
    for _ in range(50):
        pre = bytes(rng.randrange(97, 105) for _ in range(rng.randint(0, 60)))
        data = pre + w + bytes(rng.randrange(97, 105) for _ in range(rng.randint(0, 60)))
        _, at = anchors(np.frombuffer(data, np.uint8))
        offsets.add(int(at[len(pre)]) - len(pre))
    assert len(offsets) == 1


def suffix_rows(near_rows):
    rng = random.Random(6)
    passage = prose(rng, 30)
    return [*near_rows, *[(7000 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(12)], (7100, "ab" * 300), (7101, "ab" * 90 + "x"), (7102, "é" * 60), (7103, "ü" + "é" * 30), (7104, passage + passage)]


@pytest.mark.parametrize("limits", [{"hot": 2}, {"segment": 70, "chunk": 300}, {"slice": 900, "part": 2000}, {"hot": 5, "slice": 2000, "segment": 64}])
def test_suffix_dedup_limits(make, near_rows, limits):
    """Hot anchors, segments of long texts, small slices and many parts give the same bytes."""
    rows = suffix_rows(near_rows)
    got = Counter((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.dedup(make(rows), suffix_dedup.Limits(**limits)).collect())
    assert got == plain_suffix(rows)


def test_suffix_query(spark, make, near_rows, tmp_path):
    """The columns of the query, not its helpers alone."""
    import hashlib

    rows = suffix_rows(near_rows)
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    sizes = Counter((BIG if i is None else i, len((t or "").encode())) for i, t, *_ in rows)
    for (i, kept, spans), n in plain_suffix(rows).items():
        want[i, hashlib.sha256(kept).hexdigest(), spans] += n
    out = suffix_dedup.op7_suffix_dedup(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["kept_sha256"], r["n_spans"]) for r in out) == want
    assert Counter((BIG if r["doc_id"] is None else r["doc_id"], r["n_bytes"]) for r in out) == sizes
    texts = {i: len((t or "").encode()) for i, t, *_ in rows}
    assert all(0 <= r["n_removed"] <= r["n_bytes"] == texts[r["doc_id"]] for r in out)
    assert all((r["n_removed"] == 0) == (r["n_spans"] == 0) for r in out)
