"""Sharding: a uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are written once to the shared folder, each with its place: the partition that it lay in and its number there. How
many rows each partition sends to each shard is drawn from the multivariate hypergeometric distribution: the shards'
sizes are given (counts at most one apart), a partition draws its number of rows from what is left of them. Each partition
permutes its list of destinations and deals its rows by it; the rows are exchanged, and permuted again within their
shards by random keys. Every order of the rows is then equally likely. All draws follow from the seed and a row's written
place, never from the task that happens to read it, so a task that runs again deals alike.

The driver holds one number for each pair of partition and shard. Only places, shards and keys are ranked; the rows
themselves are exchanged once. Shards take as many partitions as the exchange has: the second permutation ranks rows
within a shard without bringing it into one task.

Edge cases: rows are rows, whatever is null or repeated in them; fewer rows than shards leave some shards with none, and
partitions may be empty or of any size. An empty table gives an empty result. Columns of clashing names (shard, slot,
in any case) are replaced, all others stay whatever their names are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_table, plain_names, with_rank

SHARDS = 40
SEED = 5
OVERHEAD = 16
#: monotonically_increasing_id has the partition above so many bits.
PLACE_BITS = 33


def communication_matrix(rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """How many of its rows each partition sends to each shard: rows sum to `rows`, columns are at most one apart."""
    rng, total = np.random.default_rng(seed), sum(rows)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), np.int64)
    for i, n in enumerate(rows):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[i]
    return out


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (0 to the shard's size - 1), uniformly at random."""
    df, back = plain_names(df, replaced=("shard", "slot"))
    place = "_place"
    kept = cut_table(df.withColumn(place, F.monotonically_increasing_id()))
    places = kept.select(F.col(place).alias("place"))
    counts = {r.part: r.n for r in places.groupBy(F.shiftright("place", PLACE_BITS).alias("part")).agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    sends = kept.sparkSession.sparkContext.broadcast(dict(zip(parts, matrix, strict=True)))

    def deal(batches):
        drawn = {}
        for batch in batches:
            at = batch.column("place").to_numpy()
            part, number = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
            to, keys = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for p in np.unique(part).tolist():
                if p not in drawn:
                    rng = np.random.default_rng([seed, p])
                    order = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), sends.value[p]))
                    drawn = {p: (order, rng.integers(-(1 << 63), 1 << 63, len(order), dtype=np.int64))}
                mine = part == p
                to[mine], keys[mine] = (x[number[mine]] for x in drawn[p])
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(to), pa.array(keys)], ["place", "shard", "key"])

    dealt = places.mapInArrow(deal, "place long, shard int, key long")
    ranked = with_rank(dealt, ["shard"], ["key", "place"], "slot").select("place", "shard", (F.col("slot") - 1).alias("slot"))
    return back(kept.join(ranked.withColumnRenamed("place", place), place).select(*df.columns, "shard", "slot"))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, size and text_crc32 of whole texts, a null text empty, and the columns of more."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), *more)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes df's rows as Parquet under path/shard=k, each shard's files in order of slot."""
    dealt = shuffle_into_shards(df, shards, seed)
    dealt.repartitionByRange(max(shards, df.sparkSession.sparkContext.defaultParallelism), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
