"""Document fingerprints: SimHash of BITS bits, and the search for all fingerprints within a Hamming radius.

The terms of a text are its words and its pairs of neighbouring words. Each term's hash votes on every bit, for 1 or
for 0, with the length of its words (each up to LONGEST bytes) as weight, so that short function words weigh little. Weights
are whole numbers and their sums exact, so equal texts have equal fingerprints.

The search cuts a fingerprint into BLOCKS blocks, with a table for each, keyed by the block. Of RADIUS bits that differ, not all
blocks can have more than their share (see SHARES), so a query that looks into each table with its block changed in
every choice of at most so many bits finds every fingerprint within the radius; the distance is then checked.

Documents meet the next one in order of doc_id (equal ids: of a hash of the text; null first) in ranges, one per partition;
the last text of each range and the first of the next are joined afterwards, so nothing passes through one task.

Edge cases: a null text is an empty one; the fingerprint of a text without words is all zeros. A single document is its own
next one. Repeated rows each give a row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, join_hot, keyed, map_batches, spread
from .jaccard import grouped
from .textkit import U64, Words, buffers, chunks, mix, span_hash, windows

#: Of the different texts of sf0.1 with a Jaccard similarity of 0.8 or more over five-word shingles, the farthest lie 19 bits apart.
BITS, BLOCKS, RADIUS = 128, 8, 20
WIDTH = BITS // BLOCKS
#: Bits that may differ in each block: if all blocks had one more, more than RADIUS bits would differ in total.
SHARES = [RADIUS // BLOCKS - (i > RADIUS % BLOCKS) for i in range(BLOCKS)]
PAIRS, COUNTS = ["a", "b", "near_a", "near_b", "distance"], ["a", "b", "n"]
#: Pairs of a bucket that are compared at a time.
AT_ONCE = 1 << 20
LONGEST = 16
CHUNK = 1 << 19
#: Every so many doc_ids one is a query of the search.
EVERY = 20


def _bits(hashes: np.ndarray) -> np.ndarray:
    halves = np.column_stack([mix(hashes + U64(1)), mix(hashes ^ U64(0xA5A5A5A55A5A5A5A))])
    return np.unpackbits(halves.view(np.uint8), axis=1)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text, as rows of BITS / 8 bytes."""
    words = Words(data, offsets)
    owner, n = words.owner(), len(offsets) - 1
    hashes = span_hash(data, words.starts, words.ends)
    weights = np.minimum(words.ends - words.starts, LONGEST)
    pairs, at = windows(hashes, owner, 2)
    votes = np.zeros((n, BITS))
    for keys, weight, bounds in ((hashes, weights, words.bounds), (pairs, weights[at] + weights[at + 1], np.searchsorted(at, words.bounds))):
        bits = _bits(keys).astype(np.float32)
        for i in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[i], bounds[i + 1]
            total = int(weight[a:b].sum())
            kind = np.float32 if total < 1 << 23 else np.float64
            votes[i] += 2.0 * (weight[a:b].astype(kind) @ bits[a:b].astype(kind, copy=False)) - total
    return np.packbits(votes > 0, axis=1)


def _halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts but the last: code points, bytes of the edited texts, and their offsets."""
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(at[:-1], offsets)
    n = np.diff(first)
    half = n[:-1] // 2
    kept = at[first[:-2] + n[:-1] - half]
    taken = at[first[1:-1] + np.minimum(half, n[1:])]
    raw = memoryview(data)
    parts = [x for i in range(len(half)) for x in (raw[offsets[i] : kept[i]], raw[offsets[i + 1] : taken[i]])]
    lengths = (kept - offsets[:-2]) + (taken - offsets[1:-1])
    return n[:-1], np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def _compare(texts: pa.Array) -> list[pa.Array]:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of all texts but the last."""
    data, offsets = buffers(texts)
    n_chars, edited, ends = _halves(data, offsets)
    own, changed = fingerprints(data, offsets), fingerprints(edited, ends)
    near = lambda a, b: 1.0 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS
    raw = memoryview(edited)
    columns = [n_chars, [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]]
    columns += [[r.tobytes().hex() for r in own[:-1]], [r.tobytes().hex() for r in changed], near(own[:-1], changed), near(own[:-1], own[1:])]
    return [pa.array(c) for c in columns]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def fingerprint_all(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like the edited and the next document's ones are."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("_hash", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(spread(docs), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").drop("_hash").withColumn("part", F.spark_partition_id().cast("long"))

    def walk(batches):
        held = None

        def edge(kind, row):
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[1:]), pa.array([kind]), row.column("part"), row.column("text")], [*NAMES[1:], "edge", "part", "text"]).add_column(0, "doc_id", row.column("doc_id"))

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                yield edge(0, batch.slice(0, 1))
                rows = batch
            else:
                rows = pa.RecordBatch.from_arrays([pa.concat_arrays([held.column(c), batch.column(c)]) for c in ("doc_id", "text", "part")], ["doc_id", "text", "part"])
            for i, j, *_ in chunks(rows.column("text").slice(0, rows.num_rows - 1), CHUNK):
                done = _compare(rows.column("text").slice(i, j - i + 1))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(i, j - i), *done, pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.string())], [*NAMES, "edge", "part", "text"])
            held = rows.slice(rows.num_rows - 1, 1)
        if held is not None:
            yield edge(1, held)

    walked = cut(in_batches(ranged).mapInArrow(walk, RESULT + ", edge long, part long, text string"))
    firsts = walked.where("edge = 0").select("part", F.col("text").alias("next_text"))
    parts = sorted(r.part for r in firsts.select("part").collect())  # one number for each partition
    following = walked.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, follower long")
    lasts = walked.where("edge = 1").select("doc_id", "part", "text").join(following, "part").join(firsts.withColumnRenamed("part", "follower"), "follower")

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_compare(pa.array([a, b], pa.string())) for a, b in zip(batch.column("text").to_pylist(), batch.column("next_text").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.concat_arrays(c) for c in zip(*found, strict=True))], NAMES)

    closed = map_batches(lasts.select("doc_id", "text", "next_text"), close, RESULT)
    return walked.where("edge is null").select(*NAMES).unionByName(closed)


def _halves_of(marks: DataFrame, *more: str) -> DataFrame:
    """The different fingerprints (and other columns) with two longs, a and b, in place of the fingerprint."""
    half = lambda i: F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long")
    return marks.select(half(0).alias("a"), half(1).alias("b"), *more).distinct()


def _blocks() -> Column:
    """The blocks of a fingerprint; the number of the table is in the bits above each."""
    each = BLOCKS // 2
    block = lambda i: F.shiftrightunsigned(F.col("ab"[i // each]), (each - 1 - i % each) * WIDTH).bitwiseAND((1 << WIDTH) - 1)
    return F.array(*(block(i).bitwiseOR(F.lit(i << WIDTH)).cast("int") for i in range(BLOCKS)))


def changes() -> list[tuple[int, int]]:
    """(table, bits) of every change of a block that a query looks up."""
    return [(t, sum(1 << b for b in bits)) for t, share in enumerate(SHARES) for n in range(share + 1) for bits in combinations(range(WIDTH), n)]


def _earlier(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a pair of fingerprints that differ by x (two words) also meets in a table before this one."""
    met = np.zeros(len(x), bool)
    for t, share in enumerate(SHARES):
        word, at = divmod(t, BLOCKS // 2)
        block = x[:, word] >> U64((BLOCKS // 2 - 1 - at) * WIDTH) & U64((1 << WIDTH) - 1)
        met |= (t < table) & (np.bitwise_count(block) <= share)
    return met


def _meet(pairs: bool):
    """Within runs of whole buckets: each pair within the radius, or each query's number of rows within it."""

    def fn(batches):
        for run in grouped(batches, ["key"]):
            key, n = (run.column(c).to_numpy() for c in ("key", "n"))
            words = np.column_stack([run.column(c).to_numpy() for c in "ab"]).view(U64)
            ask, held = np.flatnonzero(n == 0), np.flatnonzero(n > 0)
            first, last = np.searchsorted(key[held], key[ask]), np.searchsorted(key[held], key[ask], "right")
            total, at = np.cumsum(last - first), 0
            while at < len(ask):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
                many = (last - first)[at:to]
                q = np.repeat(np.arange(at, to), many)
                m = held[np.arange(len(q)) - np.repeat(np.cumsum(many) - many - first[at:to], many)]
                x = words[ask[q]] ^ words[m]
                distance = np.bitwise_count(x).sum(axis=1)
                near = np.flatnonzero(distance <= RADIUS)
                near = near[~_earlier(x[near], key[ask[q[near]]] >> WIDTH)]
                q, m, distance, at = ask[q[near]], m[near], distance[near], to
                if pairs:
                    columns = [words[q, 0], words[q, 1], words[m, 0], words[m, 1], distance]
                else:
                    some, of = np.unique(q, return_inverse=True)
                    count = np.zeros(len(some), np.int64)
                    np.add.at(count, of, n[m])
                    columns = [words[some, 0], words[some, 1], count]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(U64).view(np.int64)) for c in columns], PAIRS if pairs else COUNTS)

    return fn


def _searched(queries: DataFrame, marks: DataFrame, pairs: bool) -> DataFrame:
    """Queries and marks (fingerprint, n) meet by table and block, in Arrow, so that a group of near copies makes no rows for its pairs."""
    tried = F.broadcast(queries.sparkSession.createDataFrame(changes(), "table int, bits int"))
    asked = _halves_of(queries).withColumn("blocks", _blocks()).crossJoin(tried)
    asked = asked.select(F.col("blocks")[F.col("table")].bitwiseXOR(F.col("bits")).alias("key"), "a", "b", F.lit(0).cast("long").alias("n"))
    held = _halves_of(marks, "n").select(F.explode(_blocks()).alias("key"), "a", "b", "n")
    dealt = asked.unionByName(held).repartition(spread(marks), "key").sortWithinPartitions("key")
    return in_batches(dealt).mapInArrow(_meet(pairs), ", ".join(f"{c} long" for c in (PAIRS if pairs else COUNTS)))


def _text(a: str, b: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (a, b))))


def within_radius(queries: DataFrame, marks: DataFrame) -> DataFrame:
    """(fingerprint, near, distance): for each different fingerprint of queries all different ones of marks within RADIUS."""
    found = _searched(queries, marks.select("fingerprint", F.lit(1).cast("long").alias("n")), True)
    return found.select(_text("a", "b").alias("fingerprint"), _text("near_a", "near_b").alias("near"), F.col("distance").cast("int").alias("distance"))


def with_near(marked: DataFrame) -> DataFrame:
    """marked with n_near: for doc_ids divisible by EVERY, the number of other rows whose fingerprints are within RADIUS."""
    asks = F.col("doc_id") % EVERY == 0
    many = marked.groupBy("fingerprint").agg(F.count("*").alias("n"))
    found = _searched(marked.where(asks), many, False).groupBy("a", "b").agg((F.sum("n") - 1).alias("n_near")).select(_text("a", "b").alias("_mark"), "n_near")
    ours, others = marked.where(asks), marked.where(~F.coalesce(asks, F.lit(False)))
    by = keyed(found.join(many.withColumnRenamed("fingerprint", "_mark"), "_mark").withColumnRenamed("_mark", "fingerprint"))
    return join_hot(ours, by, "fingerprint", "left").drop("n").unionByName(others.withColumn("n_near", F.lit(None).cast("long")))
