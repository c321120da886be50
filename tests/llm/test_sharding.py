import zlib
from collections import Counter

import numpy as np

from siftline.llm.sharding import communication_matrix, measured, shuffle_into_shards, write_shards


def test_matrix_is_exact_and_hypergeometric():
    rows = [0, 5, 100, 37, 1]
    m = communication_matrix(rows, 8, seed=1)
    assert m.sum(axis=1).tolist() == rows and np.ptp(m.sum(axis=0)) <= 1
    draws = np.array([communication_matrix([30, 70], 4, seed=s)[0, 0] for s in range(3000)])
    mean, var = 30 / 4, 30 * 0.25 * 0.75 * 70 / 99
    assert abs(draws.mean() - mean) < 0.15 and abs(draws.var() - var) < 0.4


def test_rows_are_dealt_once_into_equal_shards(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = shuffle_into_shards(measured(docs), shards=7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert shuffle_into_shards(docs.limit(0)).count() == 0


def test_shuffle_is_uniform(spark):
    """Where a row lands does not depend on where it was: first-half rows take each shard and each slot half evenly."""
    df = spark.range(0, 4000, numPartitions=5).toDF("id")
    got = [r for seed in (1, 2) for r in shuffle_into_shards(df, 4, seed).collect()]
    cells = Counter((r.id // 1000, r.shard) for r in got)
    assert all(abs(n - 500) < 110 for n in cells.values())
    halves = Counter((r.id < 2000, r.slot < 500) for r in got)
    assert all(abs(n - 2000) < 150 for n in halves.values())


def test_written_shards_hold_whole_rows(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows)
    write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1]) for r in odd_rows)
    assert {r.shard for r in back.collect()} == {0, 1, 2}


def test_any_partitioning(spark, make_docs, odd_rows):
    """One full partition among empty ones, uneven ones, and columns of clashing names."""
    tables = [
        spark.range(0, 3000, numPartitions=1).union(spark.range(0).repartition(3)),
        spark.range(0).repartition(2).union(spark.range(0, 3000, numPartitions=1)).union(spark.range(0).repartition(2)),
        spark.range(0, 2990, numPartitions=1).union(spark.range(2990, 3000, numPartitions=7)),
    ]
    for df in tables:
        df = df.selectExpr("id", "id _place", "1 shard", "id key", "id _key", "id _at", "id _part", "id place")
        out = shuffle_into_shards(df)
        got = out.collect()
        assert sorted(r.id for r in got) == list(range(3000)) and all(r._place == r.id == r.key == r._at == r._part == r.place for r in got)
        assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(40) for k in range(75)]
        assert sorted(out.columns) == sorted(df.columns + ["slot"])


def test_one_file_at_sf01(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = measured(shuffle_into_shards(docs), "shard", "slot").collect()
    assert len(got) == docs.count() and Counter(r.shard for r in got) == Counter({s: 250 for s in range(40)})
