"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics of each whole text (lengths, character and word shares, repetition, a compression ratio) are standardised by
the training rows' means and deviations. FEATURES random cosines approximate a Gaussian kernel of width WIDTH over them.
Each partition of PART_ROWS rows sums their products into one matrix; FAN of these at a time are added until LEFT are left, which
the driver adds to solve for the ridge weights. Ridge scores are put in bins of 1 / BINS, and isotonic regression over the bins (pool adjacent
violators) gives the probability of label 1. All labelled rows that are not held out are used; there is no sample.

Edge cases: a null text is an empty one and gets a score like any other. A null doc_id is never held out and has no label.
Repeated doc_ids give a row each, and train with each label they meet. Without labels, or with labels of one class only,
every score is the share of label 1 (0.5 without any). Null labels are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, in_batches, map_batches, plain_names
from .textkit import U64, Words, chunks, mix, per_text, repeated, span_hash, windows

FEATURES = 320
WIDTH = 3.0
RIDGE = 1e-3
PART_ROWS = 20_000
#: Matrices that one task adds, again and again until LEFT of them are left.
FAN, LEFT = 64, 16
BINS = 1000
SEED = 11
THRESHOLD = 0.3

CLASSES = {
    "blank": b" \t\r\x0b\x0c", "newline": b"\n", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)),
    "stop": b".", "comma": b",;:", "shout": b"!?", "bar": b"|", "symbol": b"#*$%&<>@^~=+_\\/{}[]", "quote": b"\"'`()-", "high": bytes(range(128, 256)),
}
NAMES = [
    "log_bytes", "log_words", "word_length", "word_spread", *(f"share_{c}" for c in CLASSES), "word_bar", "word_symbol", "word_shout", "word_upper",
    "word_digit", "distinct", "same_as_last", "repeat_3", "lines_per_word", "dup_lines", "ratio",
]


def _in(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_TABLES = {k: _in(v) for k, v in CLASSES.items()}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text of a chunk, a row for each, columns as NAMES."""
    words, n = Words(data, offsets), len(offsets) - 1
    owner, bounds, counts = words.owner(), words.bounds, words.counts
    size, many = np.maximum(np.diff(offsets), 1), np.maximum(counts, 1)
    lengths = words.ends - words.starts
    mean = per_text(lengths, bounds) / many
    spread = np.sqrt(np.maximum(per_text(lengths * lengths, bounds) / many - mean**2, 0))
    columns = [np.log1p(np.diff(offsets)), np.log1p(counts), mean, spread]
    flags = {k: t[data] for k, t in _TABLES.items()}
    columns += [per_text(f, offsets) / size for f in flags.values()]

    def words_with(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[words.ends] - total[words.starts]

    columns += [per_text(words_with(flags[k]) > 0, bounds) / many for k in ("bar", "symbol", "shout")]
    columns += [per_text(words_with(flags["upper"]) >= 2, bounds) / many, per_text(words_with(flags["digit"]) > 0, bounds) / many]
    hashes = span_hash(data, words.starts, words.ends)
    keys = hashes + mix(owner.astype(U64) + U64(7))
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    columns.append(np.bincount(owner[order[fresh]], minlength=n) / many)
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    columns.append(per_text(again, bounds) / many)
    threes, at = windows(keys, owner, 3)
    columns.append(np.bincount(owner[at[repeated(threes)]], minlength=n) / many)
    lines = per_text(flags["newline"], offsets)
    columns.append((lines + 1) / many)
    newlines = np.flatnonzero(flags["newline"])
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], newlines[newlines + 1 < len(data)] + 1)
    stops = np.append(starts[1:], len(data))[: len(starts)]
    of = np.searchsorted(offsets, starts, "right") - 1
    same = repeated(span_hash(data, starts, stops - (data[stops - 1] == 10)) + mix(of.astype(U64) + U64(3)))
    columns.append(np.bincount(of[same], minlength=n) / (lines + 1))
    z, raw = zstandard.ZstdCompressor(level=1), memoryview(data)
    columns.append(np.array([len(z.compress(raw[a:b])) / (b - a) if b > a else 1.0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]))
    return np.column_stack(columns)


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = np.concatenate([statistics(data, offsets) for _, _, data, offsets in chunks(batch.column("text"))])
    columns = [pa.array(x.astype(np.float32)) for x in rows.T]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), *columns], [*(c for c in batch.schema.names if c != "text"), *NAMES])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES]).astype(np.float64)


class Model:
    """Standardisation, random cosines, ridge weights and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float = WIDTH, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.waves = rng.standard_normal((len(mean), features)) / width
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps, self.levels = np.array([0.0]), np.array([0.5])

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        waves = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.cosines(x[i : i + 4096]) @ self.weights for i in range(0, len(x), 4096)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0, 1)


def isotonic(at: np.ndarray, weight: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted places: the mean places of the blocks, and their shares of label 1."""
    blocks: list[list[float]] = []
    for x, w, y in zip(at, weight, ones, strict=True):
        blocks.append([x * w, w, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def held_out(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(train: DataFrame) -> Model:
    """train: the statistics' columns and quality 0 or 1."""
    sums = train.agg(F.count("*"), F.sum("quality"), *(F.avg(c) for c in NAMES), *(F.stddev_pop(c) for c in NAMES)).first()
    rows, ones, k = sums[0], sums[1] or 0, len(NAMES)
    if rows == 0 or ones in (0, rows):
        model = Model(np.zeros(k), np.ones(k))
        model.levels = np.array([ones / rows if rows else 0.5])
        return model
    model = Model(np.array(sums[2 : 2 + k], float), np.array(sums[2 + k :], float))

    def products(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x, y = _matrix(batch), batch.column("quality").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 4096):
                z = model.cosines(x[i : i + 4096])
                total += z.T @ np.column_stack([z, y[i : i + 4096]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def added(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for sums in batch.column("sums"):
                total += np.frombuffer(sums.as_py()).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = math.ceil(rows / PART_ROWS)
    summed = in_batches(train.select(*NAMES, "quality").repartition(parts)).mapInArrow(products, "sums binary")
    while parts > LEFT:
        parts = math.ceil(parts / FAN)
        summed = summed.repartition(parts).mapInArrow(added, "sums binary")
    total = sum(np.frombuffer(r.sums).reshape(FEATURES + 1, FEATURES + 2) for r in summed.collect())  # LEFT matrices of a fixed size
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * rows / FEATURES * np.eye(FEATURES + 1), total[:, -1])

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(model.raw(_matrix(batch)), -1, 2) * BINS).astype(np.int64)), batch.column("quality")], ["bin", "quality"])

    bins = map_batches(train.select(*NAMES, "quality"), binned, "bin long, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("ones")).orderBy("bin").collect()
    at, n, y = (np.array(x, float) for x in zip(*bins, strict=True))
    model.steps, model.levels = isotonic((at + 0.5) / BINS, n, y)
    return model


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and the statistics of each whole text."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("text")), _describe, kinds + "".join(f", {c} float" for c in NAMES))


def train_model(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from the statistics of labelled documents that are not held out."""
    marks = labels.where("quality is not null").where(~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    return fit(cut(stats.join(marks, stats["doc_id"] == marks["_id"]).select(*NAMES, "quality")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = cut(described(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"]))
    model = train_model(stats, labels)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    scores = map_batches(stats, scored, "doc_id long, score double")
    return scores.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, all columns whatever their names.

    The rows are kept once with their statistics beside them as one binary column; the model is fitted on these and
    they are judged by them, so no text is described twice.
    """
    docs, back = plain_names(docs, "doc_id", "text")
    names, own = docs.columns, "_statistics"

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.concatenate([statistics(data, offsets) for _, _, data, offsets in chunks(batch.column("text").cast(pa.string()))]).astype(np.float32)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*batch.schema.names, own])

    def unpacked(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(own).to_pylist()), np.float32).reshape(-1, len(NAMES))

    def spelt(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in unpacked(batch).T.copy())], ["doc_id", *NAMES])

    rows = cut(map_batches(docs, describe, StructType(list(docs.schema.fields)).add(own, "binary")))
    stats = map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), own), spelt, "doc_id long" + "".join(f", {c} float" for c in NAMES))
    model = train_model(stats, labels)

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = batch.filter(pa.array(model.score(unpacked(batch).astype(np.float64)) >= THRESHOLD))
        return pa.RecordBatch.from_arrays([kept.column(c) for c in names], names)

    return back(map_batches(rows, good, docs.schema))
