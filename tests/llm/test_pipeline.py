"""The pipeline's stages on odd rows, and its rows against the stages in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from helpers import prose
from quillon.llm import registry


def test_stages_keep_columns(spark, make, odd_rows, tmp_path):
    spark.createDataFrame([(1, "some item of the benchmark that no document has at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd_rows, []):
        docs = make(rows)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/stage{k}-{len(rows)}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}-{len(rows)}")
            assert docs.columns == columns


def plain_rules(rows):
    """The quality rules: base, and lines that more than a tenth and three documents of the source hold, counted by doc_id."""
    from test_native import key, plain_repeat, words

    hosts, held = defaultdict(set), defaultdict(set)
    for i, t, _, s in rows:
        hosts[s].add(i)
        for k in {key(x) for x in t.split("\n")} - {""}:
            held[s, k].add(i)
    above = {x for x, docs in held.items() if len(docs) >= 3 and len(docs) > 0.1 * len(hosts[x[0]])}
    out = []
    for i, t, lang, s in rows:
        w, kept = words(t), [x for x in t.split("\n") if (s, key(x)) not in above]
        if len(w) >= 20 and 100 * plain_repeat(w) <= 30 * len(w) and len(words(" ".join(kept))) >= 0.3 * len(w):
            out.append((i, "\n".join(kept), lang, s))
    return out


def plain_lines(rows):
    from test_native import key

    held = defaultdict(set)
    for i, t, *_ in rows:
        for k in {key(x) for x in t.split("\n")}:
            held[k].add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i), *r) for i, t, *r in rows]


def plain_clean(rows, items):
    from test_dedup import shingles, toks

    def leaks(text):
        for item in items:
            q, t, n = Counter(shingles(item)), toks(text), len(toks(item))
            for a in range(max(1, len(t) - n + 1)):
                c = Counter(shingles(" ".join(t[a : a + n])))
                if sum((c & q).values()) >= 0.8 * sum((c | q).values()):
                    return True
        return False

    return [r for r in rows if not leaks(r[1])]


def plain_mix(rows):
    from test_native import words

    size, order = Counter(), sorted({r[3] for r in rows})
    for r in rows:
        size[r[3]] += len(words(r[1]))
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
    out = Counter()
    for s in order:
        whole = int(target[s] // size[s])
        rest, done = target[s] - whole * size[s], 0
        by = defaultdict(list)
        for r in rows:
            if r[3] == s:
                by[hashlib.md5(str(r[0]).encode()).hexdigest()[:15]].append(r)
        once = set()
        for h in sorted(by):
            n = sum(len(words(r[1])) for r in by[h])
            if done + n <= rest or (done <= rest and 2 * (rest - done) > n):
                once.add(h)
            done += n
        for h, some in by.items():
            for r in some:
                out[r[0], r[1]] += whole + (h in once)
    return +out


def test_rows_against_brute_force(spark, make, tmp_path):
    """All rows of the pipeline, texts and repeats included, are those of the five stages in plain Python."""
    from test_dedup import plain_classes

    rng = random.Random(21)
    item = prose(rng, 40)
    shared, rare = "a line of more than twenty characters in many documents", "another line that not so many documents of a host will hold"
    boiler = prose(rng, 60)
    rows = [(i, prose(rng, 60) + ("\n" + shared if i % 4 == 0 else "") + ("\n" + rare if i % 25 == 7 else ""), "en", f"s{i % 3}") for i in range(120)]
    rows += [(1000, rows[1][1], "en", "s1"), (1001, rows[2][1] + " more", "en", "s0"), (1002, "too short", "en", "s0"), (1003, prose(rng, 30) + "\n" + item, "en", "s2"), (1004, "x y " * 40, "en", "s1"), (1005, item.rsplit(" ", 1)[0], "en", "s0")]
    rows += [(1100 + i, boiler + "\n" + prose(rng, 6), "en", "s3") for i in range(5)] + [(1200 + i, prose(rng, 40), "en", "s3") for i in range(9)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = plain_lines(plain_rules(rows))
    tops = {c for _, c, _ in plain_classes(left)}
    want = plain_mix(plain_clean([r for r in left if r[0] in tops], [item]))
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    ids = {i for i, _ in want}
    assert not ids & {1000, 1001, 1002, 1003, 1004, 1005, *range(1100, 1105)} and any(i >= 1200 for i in ids)


def test_registry():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in registry.QUERIES} - {"pipeline", "pii", "url", "whitening"}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
