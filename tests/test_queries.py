"""Every query with SQL returns the rows that DuckDB returns."""

import random
from pathlib import Path

import duckdb
import pytest

from siftline.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def differences(df, sql):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    expected = con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    theirs = sorted(expected.select(*columns).fetchall(), key=key)
    return [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b] + ["count"] * (len(ours) != len(theirs))


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), ORACLES[name]) == []


def test_eval_leaks_reads_whole_texts(spark, tmp_path):
    far = "word " * 5000 + "Pick the best of them"
    rows = [(1, far), (2, "nothing here"), (40, "a text of more than twenty characters, the correct answer is b"), (80, "short"), (81, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.row: r.message.split("pattern ")[1] for r in QUERIES["eval_leaks"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [2, 41, 81]
    assert (got[2], got[81]) == ('"Pick the best"', '"Answer only with the LETTER"')


def test_short_passages_are_contained(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, "b c"), (3, "one two three"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "xaby"), (2, "ab cd one two three"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["benchmark_contained"](spark, str(tmp_path)).collect())) == [(1, 1), (1, 2), (2, 2), (3, 2)]


def test_many_short_passages_are_contained(spark, tmp_path):
    rng = random.Random(7)
    piece = lambda n: "".join(rng.choice("abcdé漢 ") for _ in range(n))
    items = [(i, piece(rng.randint(0, 5))) for i in range(120)] + [(500, None), (501, ""), (502, "a"), (503, " ")]
    docs = [(i, piece(rng.randint(0, 60))) for i in range(60)] + [(900, None), (901, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, d) for i, p in items for d, t in docs if p is not None and t is not None and p in t]
    assert sorted(map(tuple, QUERIES["benchmark_contained"](spark, str(tmp_path)).collect())) == sorted(want)
