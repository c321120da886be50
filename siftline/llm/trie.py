"""Conversation prefix trie: which conversations begin alike, and what sharing their common beginnings saves.

A conversation is rebuilt from the first turns of its family's first one and its own later turns (see `rebuilt`). Every prefix of
a rebuilt conversation is a node of the trie, named by two running polynomial sums over the 64-bit halves of its turns' digests,
so a name does not depend on how rows are dealt. Partitions combine the visits of their rows into partial tries (tables of nodes with
members, ends and the least member), which meet by name; with more than FAN partitions they meet in groups of FAN first, again and
again. Ends are lists of the conversations that end at a node, in blocks of BLOCK neighbouring ids, so no list grows with the corpus.

The roll-up from the leaves runs along conversations: a node belongs to its least member, so the nodes of a subtree are those that its
members own at this depth or below. Each conversation sums what it owns from its end upwards, and hands every node on its way the
sum so far; the same merges add them up. So a subtree's sums take one pass, however deep the trie is.

Digests of ends are made as a stream, block by block in order of ids, as SHA-256 has to read them one after another: one node's ids
pass one task, which holds a batch of blocks.

Edge cases: a null role or text is an empty one. Rows of one turn (null turns first) stand in order of the digest of role and text, so
repeated rows are repeated turns. Rows without a conv_id belong to no conversation and are left out. conv_id % 100 has the sign of
conv_id. A conversation of which no turn is left is a member of the root and ends there. An empty table has no root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, join_hot, keyed, spread
from .ranges import running

#: Conversations of a family, whose first has an id divisible by this number, and the number of ways to cut their beginnings.
FAMILY, CUTS = 100, 6
#: Multipliers of the two running sums; both are odd, and 3 modulo 4 so that orders of turns differ in nearly all bits.
BASES = {"a": 0x9E3779B97F4A7C17, "b": 0xD6E8FEB86659FD93}
#: Partial tries that are merged at a time, and ids of a block of ends.
FAN, BLOCK = 64, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["sum_a", "sum_b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, chars): the turns without their texts; a and b are the halves of a digest of role and text."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.length(text).cast("long").alias("chars"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"))
    half = lambda i: F.conv(F.substring("digest", 16 * i + 1, 16), 16, -10).cast("long")
    return rows.select("conv_id", "turn", half(0).alias("a"), half(1).alias("b"), "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, chars): every conversation's turns after it is rebuilt, in order of `at`, and a row at 0 for the root.

    Conversation c begins with the first h turns of c - c % FAMILY, where h is the CRC-32 of its id modulo CUTS, and goes on with
    its own turns after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % CUTS
    placed = cut(running(turns, "conv_id", ["turn", "a", "b"], ["a", "b", "chars"]).select("conv_id", (F.col("place") + 1).alias("at"), "a", "b", "chars"))
    head = F.struct("at", "a", "b", "chars")
    bases = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < CUTS)).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(head).alias("heads"))  # CUTS - 1 at most
    each = placed.where("at = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h")).join(bases, "base", "left")
    root = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("at", "a", "b", "chars")))
    taken = F.coalesce(F.filter("heads", lambda x: x.at <= F.col("h")), F.array().cast("array<struct<at:long,a:long,b:long,chars:long>>"))
    begun = each.select("conv_id", F.explode(F.concat(F.array(root), taken)).alias("x")).select("conv_id", "x.*")
    return placed.where(F.col("at") > h).unionByName(begun)


def merged(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """rows grouped by keys, in rounds of FAN partitions at a time. Each sum is over a column of its own name, so rounds can go on with it."""
    n = spread(rows)
    rows = rows.withColumn("_part", F.spark_partition_id())
    while n > FAN:
        n = -(-n // FAN)
        rows = rows.withColumn("_part", F.floor(F.col("_part") / FAN)).groupBy("_part", *keys).agg(*(v.alias(k) for k, v in sums.items()))
    return rows.groupBy(*keys).agg(*(v.alias(k) for k, v in sums.items()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, of rows in order of node and block."""
    at, digest = None, None

    def done(found):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], [*KEY, "ends_sha256"])

    for batch in batches:
        found = []
        for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True), batch.column("ids").to_pylist(), strict=True):
            text = ",".join(map(str, sorted(ids))).encode()
            if key == at:
                digest.update(b"," + text)
            else:
                if at is not None:
                    found.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(text)
        yield done(found)
    if at is not None:
        yield done([(at, digest.hexdigest())])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    turns = cut(turns_of(conversations))  # ranges are sampled before rows are dealt: texts are read and digested once
    visits = running(rebuilt(turns), "conv_id", ["at"], ["a", "b", "chars"], BASES)
    visits = cut(visits.select("conv_id", F.col("place").alias("depth"), *KEY, "chars", "last"))
    one = F.lit(1).cast("long")
    partial = visits.select(*KEY, "chars", F.col("conv_id").alias("first"), one.alias("n"), F.col("last").cast("long").alias("ends"))
    nodes = merged(partial, KEY, chars=F.max("chars"), first=F.min("first"), n=F.sum("n"), ends=F.sum("ends"))
    nodes = keyed(nodes.select(F.struct(*KEY).alias("key"), "chars", "first", "n", "ends"))
    rows = join_hot(visits.select(F.struct(*KEY).alias("key"), "conv_id", "depth"), nodes, "key")
    own = F.col("conv_id") == F.col("first")
    if_own = lambda v, c: F.when(own, v).otherwise(0).cast("long").alias(c)
    rows = rows.select("conv_id", "depth", "key.*", "first", if_own(one, "own"), if_own((F.col("n") - 1) * F.col("chars"), "saved"), if_own((F.col("n") == F.col("ends")).cast("long"), "leaves"))
    # from each conversation's end to the root
    climbed = running(rows, "conv_id", [F.col("depth").desc()], ["depth", *KEY, "first", "own", "saved", "leaves"], {"saved": 1, "leaves": 1}, ["first"], ["own"])
    climbed = climbed.select(
        *KEY, "first", "depth", F.when(F.col("own") == 1, F.col("next_first")).alias("parent"), one.alias("n"), F.coalesce("previous_own", F.lit(0)).alias("children"),
        F.col("sum_leaves").alias("leaves"), F.col("sum_saved").alias("saved"),
    )
    whole = merged(climbed, KEY, first=F.min("first"), depth=F.max("depth"), parent=F.max("parent"), n=F.sum("n"), children=F.sum("children"), leaves=F.sum("leaves"), saved=F.sum("saved"))
    ended = visits.where("last").select(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block"), F.array("conv_id").alias("ids"))
    lists = merged(ended, [*KEY, "block"], ids=F.flatten(F.collect_list("ids")))
    lists = lists.repartition(spread(lists), *KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    digests = in_batches(lists).mapInArrow(_digests, "sum_a long, sum_b long, ends_sha256 string")
    return whole.join(digests, KEY, "left").select(
        F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
