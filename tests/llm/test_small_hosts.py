"""The line limit of the quality rules on small hosts and on rows given more than once."""

from quillon.llm import quality_rules


def own(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_small_host_loses_boilerplate(make):
    """Four of ten documents of a host are nearly all one line: no host is too small for that, but two documents are no evidence."""
    boiler, pair = own("b", 60), own("p", 60)
    rows = [(i, own(i, 60)) for i in range(6)] + [(10 + i, boiler + "\n" + own(10 + i, 5)) for i in range(4)]
    rows += [(20 + i, pair + "\n" + own(20 + i, 5), "en", "s2") for i in range(2)] + [(22, own(22, 60), "en", "s2")]
    assert {r["doc_id"] for r in quality_rules.keep_good(make(rows)).collect()} == {*range(6), 20, 21, 22}


def test_equal_rows_lose_their_words_once(make):
    """A quarter of the words of three equal rows is in a frequent line: the other three quarters are left to each of them."""
    line = own("c", 20)
    rows = [(1, line + "\n" + own(1, 60))] * 3 + [(1, line + "\n" + own(1, 60), "en", "s2")] + [(10 + i, own(10 + i, 60)) for i in range(31)] + [(50 + i, line + "\n" + own(50 + i, 60)) for i in range(3)]
    out = [(r["doc_id"], r["left_words"], r["kept"]) for r in quality_rules.verdicts(make(rows)).collect()]
    assert sorted(out) == [(1, 60, True)] * 3 + [(1, 80, True)] + [(10 + i, 60, True) for i in range(31)] + [(50 + i, 60, True) for i in range(3)]
    assert quality_rules.keep_good(make(rows)).count() == len(rows)
