"""Filter interaction audit: what each of five filters removes, in each order in which they can be applied.

Every document gets a bit for each filter that it fails (A to E) and for its labels; texts go no further than that. Whether a text
equals one of a smaller doc_id is found by joining two 64-bit hashes of the text with the least doc_id that has them. Then each
partition packs the bits of each part's rows into NumPy bitsets, one for each filter and label. For each set of filters that
can come first (a prefix, 32 of them) it takes these from the part with AND-NOT, and counts by popcount what is left and what each
other filter would remove of it. The counts of the partitions are summed by part and prefix; all 120 orders are made of them.

Edge cases: a null text is an empty one. Null sources and empty ones are one part, the empty string. A null doc_id is neither smaller
nor greater than another, so such a row neither fails E nor makes one fail it, and it has no labels; equal doc_ids are not smaller than
each other. A document with several rows of labels has a mark if any of them has it. Repeated rows count as often as they stand. An
empty table has no parts and so no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, join_hot, keyed, map_batches, maybe_in
from .jaccard import marked
from .textkit import Words, chunks, per_text, span_hash

FILTERS = "ABCDE"
#: Filter A: fewer words fail. B: a lower share of different words, C: a higher share of capitals, in percent. D: these characters.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
PREFIXES = 1 << len(FILTERS)
#: Rows of a part that make bitsets together; more make several rounds of counts.
AT_ONCE = 1 << 22

_COUNTS = ["kept", *(f"{kind}_{f}" for kind in ("removed", "good", "toxic") for f in FILTERS)]


def fails(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits of filters A to D of each text."""
    words = Words(data, offsets)
    owner, hashes = words.owner(), span_hash(data, words.starts, words.ends)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    different = np.bincount(owner[fresh], minlength=len(offsets) - 1)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    points = per_text((data & 0xC0) != 0x80, offsets)
    capitals = per_text((data >= ord("A")) & (data <= ord("Z")), offsets)
    found = (words.counts < LEAST_WORDS, 100 * different < LEAST_DIFFERENT * words.counts, 100 * capitals > MOST_CAPITALS * points, per_text(symbol[data], offsets) > 0)
    return sum(x.astype(np.int32) << k for k, x in enumerate(found))


def _flag(batch: pa.RecordBatch) -> pa.RecordBatch:
    bits = [fails(data, offsets) for _, _, data, offsets in chunks(batch.column("text"))]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "mark", "mark2")), pa.array(np.concatenate(bits))], ["doc_id", "part", "mark", "mark2", "bits"])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits) of every document: bit k for filter k of FILTERS, then GOOD and TOXIC."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = cut(map_batches(marked(texts.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))), _flag, "doc_id long, part string, mark long, mark2 long, bits int"))
    rows = rows.withColumn("key", F.struct("mark", "mark2")).drop("mark2")
    same = keyed(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"))
    asked = cut(maybe_in(rows, same.rows.select("key.mark"), "mark", "_met"))
    met = join_hot(asked.where("_met"), same, "key", "left")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    met = met.select("doc_id", "part", F.when(later, F.col("bits") + (1 << FILTERS.index("E"))).otherwise(F.col("bits")).alias("bits"))
    rows = asked.where("NOT _met").select("doc_id", "part", "bits").unionByName(met)
    has = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((has("quality", GOOD) + has("toxic", TOXIC)).alias("marks")).where("marks > 0")
    return rows.join(marks, "doc_id", "left").select("part", (F.col("bits") + F.coalesce("marks", F.lit(0))).alias("bits"))


def _bitsets(codes: np.ndarray) -> list[np.ndarray]:
    """A bitset of all rows, and one for each bit of their codes, as words of 64 bits."""
    room = np.zeros(-len(codes) % 64, bool)
    return [np.packbits(np.concatenate([x, room])).view(np.uint64) for x in (np.ones(len(codes), bool), *((codes >> k & 1).astype(bool) for k in range(len(FILTERS) + 2)))]


def prefix_counts(codes: np.ndarray) -> np.ndarray:
    """A row of _COUNTS for each set of filters that came before: what is left, and what each filter removes of it (all, good, toxic)."""
    rows, *filters, good, toxic = _bitsets(codes)
    count = lambda x: int(np.bitwise_count(x).sum())
    left = [rows]
    for before in range(1, PREFIXES):
        last = before.bit_length() - 1
        left.append(left[before ^ (1 << last)] & ~filters[last])
    out = np.zeros((PREFIXES, len(_COUNTS)), np.int64)
    for before, rest in enumerate(left):
        gone = [rest & f for f in filters]
        out[before] = [count(rest), *map(count, gone), *(count(g & good) for g in gone), *(count(g & toxic) for g in gone)]
    return out


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each part by prefix, for the rows of a partition; AT_ONCE rows wait at most."""
    waiting: dict[str, list[np.ndarray]] = {}
    n = 0

    def done():
        for part, codes in waiting.items():
            counts = prefix_counts(np.concatenate(codes))
            yield pa.RecordBatch.from_arrays([pa.array([part] * PREFIXES), pa.array(range(PREFIXES), pa.int32()), *(pa.array(c) for c in counts.T)], ["part", "before", *_COUNTS])

    for batch in batches:
        names = batch.column("part").dictionary_encode()
        of, bits = names.indices.to_numpy(), batch.column("bits").to_numpy().astype(np.uint8)
        order = np.argsort(of, kind="stable")
        for name, codes in zip(names.dictionary.to_pylist(), np.split(bits[order], np.cumsum(np.bincount(of, minlength=len(names.dictionary)))[:-1]), strict=True):
            waiting.setdefault(name, []).append(codes)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield from done()
            waiting, n = {}, 0
    yield from done()


def counted(rows: DataFrame) -> DataFrame:
    """part, before (a set of filters as bits) and the sums of _COUNTS; rows: part, bits."""
    schema = "part string, before int, " + ", ".join(f"{c} long" for c in _COUNTS)
    partial = in_batches(rows).mapInArrow(_audit, schema)
    return partial.groupBy("part", "before").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, place of the step's filter in FILTERS, filters before it) of all orders."""
    orders = ["".join(x) for x in permutations(FILTERS)]
    bits = lambda fs: sum(1 << FILTERS.index(f) for f in fs)
    return [(o, k + 1, FILTERS.index(f), bits(o[:k])) for o in orders for k, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = cut(counted(flagged(docs, labels)))
    every = PREFIXES - 1
    orders = [factorial(n) * factorial(len(FILTERS) - 1 - n) for n in range(len(FILTERS))]  # that begin with a given set of n, then a given filter

    def over(name: str, value: Callable[[int], Column]) -> Column:
        return F.array(*(F.sum(value(k)) for k in range(len(FILTERS)))).alias(name)

    removed = lambda k: F.col(f"removed_{FILTERS[k]}")
    # with all filters before, none removes anything; the array has no place for that
    times = F.coalesce(F.get(F.array(*(F.lit(n).cast("long") for n in orders)), F.bit_count("before")), F.lit(0))
    whole = counts.groupBy("part").agg(
        over("fails", lambda k: F.when(F.col("before") == 0, removed(k)).otherwise(0)),
        over("unique", lambda k: F.when(F.col("before") == every ^ (1 << k), removed(k)).otherwise(0)),
        over("shapley", lambda k: removed(k) * times),
    )
    table = F.broadcast(docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, filter int, before int"))
    pick = lambda kind: F.array(*(F.col(f"{kind}_{f}") for f in FILTERS))[F.col("filter")]
    found = counts.join(table, "before").select("part", "filter_order", "step", "filter", "kept", pick("removed").alias("removed"), pick("good").alias("good_lost"), pick("toxic").alias("toxic_lost"))
    at = lambda c: F.col(c)[F.col("filter")]
    return found.join(whole, "part").select(
        "part", "filter_order", "step", (F.col("kept") - F.col("removed")).alias("kept"), "removed", (at("fails") - F.col("removed")).alias("redundant"),
        at("unique").alias("unique_fails"), "good_lost", "toxic_lost", at("shapley").alias("shapley"),
    )
