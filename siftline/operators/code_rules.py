"""Rules over calls in Python files: seeds, shuffles after a split, de-duplication without normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..findings import ERROR, WARNING, findings
from . import messages

# Names of calls.
RANDOM_CALLS = (
    "random.shuffle", "random.sample", "random.choice", "random.choices", "np.random.shuffle", "np.random.choice", "np.random.permutation",
    "np.random.rand", "np.random.randint", "numpy.random.shuffle", "numpy.random.choice", "numpy.random.permutation", "numpy.random.rand", "numpy.random.randint",
)
SEED_CALLS = ("random.seed", "np.random.seed", "numpy.random.seed")
SPLIT_CALLS = ("train_test_split", "sklearn.model_selection.train_test_split", "model_selection.train_test_split")
SHUFFLE_CALLS = ("random.shuffle", "np.random.shuffle", "np.random.permutation", "numpy.random.shuffle", "numpy.random.permutation")
DEDUP_CALLS = ("drop_duplicates", "unique", "set")
NORMALIZERS = ("lower", "upper", "casefold", "strip", "lstrip", "rstrip", "normalize")


def random_seed_not_set(calls: DataFrame, settings: Settings) -> DataFrame:
    """Every random call of a file without a seed call, with a fix that seeds after the last import."""
    seeded = calls.where(F.col("dotted").isin(*SEED_CALLS)).select("path").distinct()
    hits = calls.where(F.col("dotted").isin(*RANDOM_CALLS)).join(seeded, "path", "left_anti")
    first = hits.groupBy("path").agg(F.min_by("dotted", "preorder").alias("first"))
    hits = hits.join(first, "path")
    seed = F.concat(F.regexp_extract("first", r"^((?:np\.|numpy\.)?random)\.", 1), F.lit(".seed(0)"))
    at = F.col("last_import") + 1
    fix = F.struct(F.format_string(messages.SEED_FIX, seed, at).alias("description"), F.lit("idiomatic").alias("level"), F.array(F.struct(at.cast("int").alias("line"), F.concat(seed, F.lit("\n")).alias("insert"))).alias("edits"))
    message = F.format_string(messages.SEED_NOT_SET, "dotted")
    return findings(hits, "random-seed-not-set", WARNING, message, line=F.col("line"), col=F.col("col"), fix=fix)


def shuffle_after_split(calls: DataFrame, settings: Settings) -> DataFrame:
    """Shuffles that start behind the file's first split; calls inside other calls do not count."""
    plain = calls.where(~F.col("nested"))
    split = plain.where(F.col("dotted").isin(*SPLIT_CALLS)).groupBy("path").agg(F.min("start_off").alias("split_at"))
    hits = plain.where(F.col("dotted").isin(*SHUFFLE_CALLS)).join(split, "path").where("start_off > split_at")
    message = F.format_string(messages.SHUFFLE_AFTER_SPLIT, "dotted")
    return findings(hits, "shuffle-after-split", ERROR, message, line=F.col("line"), col=F.col("col"))


def dedup_without_normalization(calls: DataFrame, settings: Settings) -> DataFrame:
    """The first de-duplicating call of a file that has no normalising call anywhere."""
    normal = calls.where(F.col("base_name").isin(*NORMALIZERS)).select("path").distinct()
    first = calls.where(F.col("base_name").isin(*DEDUP_CALLS)).join(normal, "path", "left_anti").groupBy("path").agg(F.min_by(F.struct("base_name", "line", "col"), "preorder").alias("f"))
    message = F.format_string(messages.DEDUP_WITHOUT_NORMALIZATION, "f.base_name")
    return findings(first, "dedup-key-misses-normalization", WARNING, message, line=F.col("f.line"), col=F.col("f.col"))
