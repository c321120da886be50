"""A corpus pipeline of five stages over the documents table; each stage is an operator of siftline.llm.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of documents.

1. Documents that the quality classifier rejects go.
2. One document of each near-duplicate class stays, the one with the least doc_id.
3. Secrets in the texts are masked by their kinds; no document goes.
4. Sources are mixed to their target weights: documents are left out or repeated.
5. Texts are encoded with the ranks of byte_bpe_50k; what is returned are ids in place of texts.

Null texts are empty ones and stay as far as each stage's rule says; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftline.llm.bpe import encode
from siftline.llm.classifier import keep_good
from siftline.llm.common import remove, shared_folder, table
from siftline.llm.jaccard import keep_one
from siftline.llm.mixing import mix
from siftline.llm.secrets import mask_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mixing),
    ("byte-level BPE", tokens),
]

#: Ridge regression and similarity joins are beyond SQL; the pipeline is tested against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again. Only the last one's rows stay there."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
