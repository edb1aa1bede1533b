"""Every query of the subpackage with SQL gives the rows that DuckDB gives, on the smallest tables and on a few hard rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))
from compare import TABLES, canonical  # noqa: E402

from quillon.llm import registry  # noqa: E402


def same(spark, folder, tables, name):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if Path(f'{folder}/{t}.parquet').is_dir() else ''}'")
    df = registry.QUERIES[name](spark, str(folder))
    rel = con.sql(registry.ORACLE_SQL[name])
    return canonical(df.collect(), df.columns) == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf, name):
    assert same(spark, sf, TABLES, name)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_odd_rows(spark, make, odd_rows, tmp_path, name):
    """Nulls, blanks, long texts, copies and ties; doc_ids differ, as the SQL takes a row for a document."""
    rows = [r for k, r in enumerate(odd_rows) if r[0] is not None and r[0] not in [x[0] for x in odd_rows[:k]]]
    make(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[0][1]), (2, "short text of five words"), (3, None), (4, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.net/en/x", "http://net", "http://a.net/", "http://xnet/de/", "http://b.example.com/de/?q", "http://org/fr/#x", "x://a.example.net/en?://b.org/fr/", "http://É.org/fr/é"]
    spark.createDataFrame(list(enumerate([*urls, urls[4]])), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [None, [], [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("-inf"), 1.0], *([float(i % 5), i / 7, -i / 300] for i in range(40)), [0.0, 0.0, -0.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert same(spark, tmp_path, ("documents", "benchmark", "pages", "embeddings"), name)
