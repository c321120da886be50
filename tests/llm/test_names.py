"""Extra columns whose names clash with those of results, differ from them in case only, or hold dots and quotes."""

import pytest

from siftline.llm.audit import audit
from siftline.llm.bpe import decode, encode, round_trip
from siftline.llm.classifier import classify, keep_good
from siftline.llm.embeddings import near_dedup
from siftline.llm.fingerprints import fingerprint_all, with_near
from siftline.llm.jaccard import jaccard_join, keep_one
from siftline.llm.mixing import mix, mixture
from siftline.llm.quality_rules import quality_rules
from siftline.llm.secrets import digest, mask_secrets, scan_secrets
from siftline.llm.sharding import shuffle_into_shards
from siftline.llm.token_counts import keep_trees
from siftline.llm.trie import prefix_trie

EXTRA = ["IDS", "_STATISTICS", "Shard", "SLOT", "N_Tokens", "a.b", "a`b", "Decoded", "_row", "_Key", "mark", "MARK2", "Size", "bits", "key", "_column1", "rank", "KIND", "_place", "Copies"]
#: Stages that hand on all columns, and those that each of them replaces.
STAGES = {
    "good": (keep_good, ()), "one": (lambda d, _: keep_one(d), ()), "masked": (lambda d, _: mask_secrets(d), ()), "mixed": (lambda d, _: mix(d), ()),
    "shards": (lambda d, _: shuffle_into_shards(d), ("Shard", "SLOT")), "encoded": (lambda d, _: encode(d), ("IDS", "N_Tokens")),
}
JOBS = {
    "secrets": lambda d, _: digest(scan_secrets(d)), "jaccard": lambda d, _: jaccard_join(d), "fingerprints": lambda d, _: with_near(fingerprint_all(d)), "rules": lambda d, _: quality_rules(d),
    "mixing": lambda d, _: mixture(d), "counts": lambda d, _: keep_trees(d), "bpe": lambda d, _: round_trip(d), "classifier": classify, "audit": audit, "decoded": lambda d, _: decode(encode(d)),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"some words of text {i % 7} token = abcdefgh{i}", "en", "s", 30, *(f"{c} {i}" for c in EXTRA)) for i in range(40)]
    quoted = ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {quoted}")
    return docs, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", STAGES)
def test_stages_hand_on_columns_of_any_name(tables, tmp_path, name):
    docs, labels = tables
    stage, replaced = STAGES[name]
    out = stage(docs, labels)
    out.write.parquet(f"{tmp_path}/out")
    kept = [c for c in EXTRA if c not in replaced]
    assert [c for c in out.columns if c in EXTRA] == kept
    for r in docs.sparkSession.read.parquet(f"{tmp_path}/out").collect():
        assert [r[c] for c in kept] == [f"{c} {r['doc_id']}" for c in kept]


@pytest.mark.parametrize("name", JOBS)
def test_results_are_those_without_extra_columns(tables, name):
    docs, labels = tables
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = lambda d: sorted(map(str, JOBS[name](d, labels).drop(*EXTRA).collect()))
    assert rows(docs) == rows(plain)


def test_scanned_rows_keep_their_names(tables):
    assert scan_secrets(tables[0]).schema["_row"].dataType == tables[0].schema


def test_conversations_and_embeddings(spark):
    extra = ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA)
    more = tuple("x" for _ in EXTRA)
    chats = spark.createDataFrame([(0, 0, "user", "hi", *more, 1, 2, 3)], f"conv_id long, turn long, role string, text string, {extra}, depth int, sum_a int, place int")
    assert prefix_trie(chats).count() == 2
    vectors = spark.createDataFrame([(1, [1.0, 0.0], *more), (2, [1.0, 0.1], *more)], f"vec_id long, embedding array<float>, {extra}")
    assert sorted(map(tuple, near_dedup(vectors).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
