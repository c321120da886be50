"""Tables of nulls and empty texts only, in one partition, through every operator over documents."""

import pytest

from siftline.llm import queries
from siftline.llm.bpe import encode, round_trip
from siftline.llm.classifier import classify, keep_good
from siftline.llm.fingerprints import fingerprint_all, with_near
from siftline.llm.jaccard import jaccard_join
from siftline.llm.mixing import mixture
from siftline.llm.quality_rules import quality_rules
from siftline.llm.secrets import digest, scan_secrets
from siftline.llm.sharding import measured, shuffle_into_shards
from siftline.llm.token_counts import edit_trees, keep_trees, three_edits

JOBS = {
    "secrets": lambda d, _: digest(scan_secrets(d)), "jaccard": lambda d, _: jaccard_join(d), "sharding": lambda d, _: shuffle_into_shards(measured(d)),
    "fingerprints": lambda d, _: with_near(fingerprint_all(d)), "rules": lambda d, _: quality_rules(d), "mixing": lambda d, _: mixture(d),
    "counts": lambda d, _: edit_trees(keep_trees(d).withColumn("edits", three_edits())), "bpe": lambda d, _: round_trip(d), "encode": lambda d, _: encode(d),
    "classifier": classify, "good": keep_good,
}


@pytest.mark.parametrize("name", JOBS)
def test_nulls_and_empty_texts_alone(spark, make_docs, name):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (3, ""), (None, None), (4, " ")]
    docs = make_docs(rows).coalesce(1)
    n = JOBS[name](docs, labels).count()
    assert n == len(rows) or name == "good" and n <= len(rows)


def test_each_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
