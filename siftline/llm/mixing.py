"""Mixing sources to target weights: systematic sampling of whole documents.

Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the words of the whole table; a target stops
at CAP times its source's words, and the excess is shared again by weight until none is above. A document of a source is
expected target / source size times. Within a source the documents lie in order of size, then doc_id; the prefix sum of
expected copies gets one offset for the source, and a document is emitted once per integer boundary that its part of the sum
crosses. Neighbours in that order have like sizes, so the words taken come as near the target as the sizes allow. The
offset hashes seed and source, so reruns agree.

Edge cases: a null text has size 0; a source of size 0 has target 0 and takes nothing. Rows with equal doc_id and size
keep a place each. The sources are as many as a mixing table has lines; they are ordered in one task after they have been
summed up, one row for each. An empty table gives an empty result. Extra columns stay with mix() and are ignored by mixture().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, plain_names, with_rank

WEIGHTS = 3
CAP = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    """Number of words of a text; null: 0. Words are cut at ASCII blanks only."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target and rate from rows (source, size).

    Sources whose share passes CAP times their size are those with the least size by weight: in that order, one is capped
    if the words left over by those before it, shared by the weights from it on, give it too much.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(everything) - CAP * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
    per = per.withColumn("shares", F.sum("weight").over(later))
    per = per.withColumn("capped", F.col("weight") * F.col("left") > CAP * F.col("source_size") * F.col("shares"))
    free = F.when(~F.col("capped"), F.struct(-F.col("shares"), "left", "shares"))
    per = per.withColumn("open", F.min(free).over(everything))
    target = F.when(F.col("capped"), (CAP * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("open.left")).cast("double") / F.col("open.shares").cast("double")
    )
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target)
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target / F.col("source_size").cast("double"))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def offset(source: str = "source", seed: int = SEED):
    """A number in [0, 1) that seed and source decide: 32 bits of a digest."""
    word = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies_of(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """sized (doc_id, source, size and any more columns) with source_size, target and copies."""
    ranked = with_rank(sized, ["source"], ["size", *(c for c in sized.columns if c not in ("source", "size"))])
    goals = targets(sized).withColumnRenamed("source", "_source")
    joined = ranked.join(goals, ranked["source"].eqNullSafe(goals["_source"])).withColumn("_offset", offset(seed=seed))
    crossed = lambda n: F.floor(n.cast("double") * F.col("rate") + F.col("_offset"))
    copies = (crossed(F.col("rank")) - crossed(F.col("rank") - 1)).cast("long")
    return joined.select(*sized.columns, "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each document; words taken are copies times size."""
    return copies_of(cut(docs.select("doc_id", "source", word_count().alias("size"))), seed)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves, all columns whatever their names, each as many times as it is taken.

    Texts follow by two hashes of the whole row; rows that are equal in all columns are one text whose copies are summed.
    """
    docs, back = plain_names(docs, "doc_id", "text", "source")
    key = F.struct(F.xxhash64(*docs.columns).alias("one"), F.xxhash64(F.lit("second"), *docs.columns).alias("two"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    goals = copies_of(cut(docs.select("doc_id", "source", word_count().alias("size"), key.alias("key"))), seed)
    taken = goals.where("copies > 0").groupBy(F.col("key").alias("_key")).agg(F.sum("copies").cast("int").alias("_copies"))
    rows = keyed.groupBy("_key").agg(F.first("_row").alias("_row")).join(taken, "_key")
    return back(rows.select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row")).select("_row.*"))
