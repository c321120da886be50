import base64
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from siftline.llm.classifier import classify
from siftline.llm.mixing import mixture
from siftline.llm.secrets import digest, scan_secrets

from .test_jaccard import brute

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_in_turn(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        seen.append((docs, after))
        docs = after
    good = {r.doc_id for r in classify(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in seen[0][1].collect()} == good
    # of each class of equal and near copies, by all pairs, the least doc_id stays
    assert sorted(r.doc_id for r in seen[1][1].collect()) == sorted({c for _, c, _, _ in brute([(r.doc_id, r.text) for r in seen[1][0].collect()])})
    assert {r.doc_id for r in seen[2][1].collect()} == {r.doc_id for r in seen[2][0].collect()}
    assert all(r.spans == "" for r in digest(scan_secrets(seen[2][1])).collect())
    expected = Counter({r.doc_id: r.copies for r in mixture(seen[3][0]).collect() if r.copies})
    assert Counter(r.doc_id for r in seen[3][1].collect()) == expected
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = {r.doc_id: r.text for r in seen[4][0].collect()}
    for r in seen[4][1].collect():
        assert r.ids == library.encode_ordinary(plain[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 50 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_empty_and_null_documents(spark, make_docs):
    docs = make_docs([(1, None), (None, None), (2, ""), (2, ""), (3, "x " * 70)])
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, DATA)
        assert table.count() <= 15


def test_large_groups_pass_all_stages(spark, make_docs):
    """One large group of equal texts and one of near copies over many partitions: one of each is left to be mixed."""
    text = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 900").orderBy("doc_id").first().text
    words = text.split(" ")
    rows = [(i, text) for i in range(400)] + [(1000 + i, " ".join([*words[: i % len(words)], f"x{i}", *words[i % len(words) :]])) for i in range(200)] + [(5000, "other words " * 3 + text[::-1])]
    docs = make_docs(rows).repartition(23)
    kept = corpus_pipeline.STAGES[1][1](spark, docs, DATA)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 5000]
