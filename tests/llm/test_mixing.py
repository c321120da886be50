import collections
import random

from pyspark.sql import functions as F

from siftline.llm.mixing import mix, mixture

from .conftest import sentence


def rows_of(n=400):
    rng = random.Random(2)
    return [(i, sentence(rng, rng.choice([0, 1, 5, 40, 90])), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(n)]


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        goal = {s: weight[s] * left / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if goal[s] > 3 * sizes[s]}
        if not above:
            return goal | {s: 3.0 * sizes[s] for s in capped}
        capped |= above


def test_targets_and_taken_words(make_docs):
    rows = rows_of() + [(1000, "tiny", "a"), (1001, None, None), (1002, "two words", None), (1003, "", "zero"), (1004, "dup", "hot"), (1004, "dup", "hot")]
    got = mixture(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    goal = water_fill(sizes)
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - goal[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 3 * 90 + 1, s
    assert sorted(map(tuple, mixture(make_docs(rows)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_documents_are_whole_rows(make_docs):
    rows = rows_of(90) + [(500, "dup words", "hot"), (500, "dup words", "hot")]
    docs = make_docs(rows)
    out = mix(docs)
    assert out.columns == docs.columns
    counted = collections.Counter(r.source for r in out.collect())
    expected = collections.Counter()
    for r in mixture(docs).collect():
        expected[r.source] += r.copies
    assert set(counted) <= set(expected) and abs(sum(counted.values()) - sum(expected.values())) <= len(expected) * 2
    assert {(r.doc_id, r.text) for r in out.collect()} <= {(a, b) for a, b, _ in rows}


def test_empty_tables(make_docs):
    empty = make_docs([(1, "a")]).limit(0)
    assert mixture(empty).count() == 0 and mix(empty).count() == 0


def test_before_each_is_a_prefix_fold(spark):
    from siftline.llm.common import FOLD, before_each

    for n in (0, 1, FOLD - 1, FOLD, FOLD + 1, 3 * FOLD + 5):
        values = [(7 * k) % 11 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        got = df.select(before_each(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), before_each(F.col("v"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("m")).first()
        assert got.s == [sum(values[:k]) for k in range(n)] and got.m == [max(values[:k], default=0) for k in range(n)]
