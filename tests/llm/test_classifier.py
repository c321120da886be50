import math
import re
import zlib
from collections import Counter

import numpy as np
import zstandard

from siftline.llm.classifier import BINS, CLASSES, FEATURES, RIDGE, SEED, WIDTH, classify, isotonic

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [(got[i].predicted, truth[i], got[i].score) for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([p == y for p, y, _ in test]) > 0.9
    good, bad = [s for _, y, s in test if y], [s for _, y, s in test if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_odd_rows_and_missing_labels(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classify(docs, none).collect()
    assert len(got) == len(odd_rows) and {r.score for r in got} == {0.5}
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, marks).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert classify(docs.limit(0), marks).count() == 0


def test_isotonic_pools_violators():
    at, levels = isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.ones(4), np.array([0.0, 1.0, 0.0, 1.0]))
    assert at.tolist() == [1.0, 2.5, 4.0] and levels.tolist() == [0.0, 0.5, 1.0]


def plain_statistics(text):
    """The same statistics by loops over strings and bytes."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    size, many, lengths = max(len(raw), 1), max(len(words), 1), [len(w) for w in words]
    mean = sum(lengths) / many
    out = [math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(max(sum(n * n for n in lengths) / many - mean * mean, 0))]
    count = {k: sum(b in v for b in raw) for k, v in CLASSES.items()}
    out += [n / size for n in count.values()]
    with_ = lambda k, least=1: sum(sum(b in CLASSES[k] for b in w) >= least for w in words) / many
    out += [with_("bar"), with_("symbol"), with_("shout"), with_("upper", 2), with_("digit")]
    out += [len(set(words)) / many, sum(a == b for a, b in zip(words, words[1:], strict=False)) / many]
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    out.append(sum(n for n in threes.values() if n > 1) / many)
    lines = raw.split(b"\n")
    out.append(len(lines) / many)
    own = lines[:-1] if raw.endswith(b"\n") else lines if raw else []
    often = Counter(own)
    out.append(sum(often[x] > 1 for x in own) / len(lines))
    out.append(len(zstandard.ZstdCompressor(level=1).compress(raw)) / len(raw) if raw else 1.0)
    return np.array(out, np.float32)


def test_scores_equal_a_plain_version(spark, make_docs, odd_rows):
    """Statistics, standardisation, cosines, ridge weights and calibration worked out once more, from the plain texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(10**6 + k, t) for k, (_, t, *_) in enumerate(odd_rows)]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r.score for r in classify(make_docs(rows), labels).collect()}
    x = {i: plain_statistics(t or "").astype(float) for i, t in rows}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    train = [i for i in quality if zlib.crc32(str(i).encode()) % 5]
    a, y = np.array([x[i] for i in train]), np.array([quality[i] for i in train], float)
    mean, deviation = a.mean(axis=0), a.std(axis=0)
    deviation[deviation <= 1e-9] = 1
    rng = np.random.default_rng(SEED)
    waves, phases = rng.standard_normal((a.shape[1], FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    features = lambda v: np.append(np.cos(np.clip((v - mean) / deviation, -8, 8) @ waves + phases) * np.sqrt(2 / FEATURES), 1)
    z = np.array([features(v) for v in a])
    # ridge as least squares with a row for each penalty, not by normal equations
    penalty = np.sqrt(RIDGE * len(train) / FEATURES) * np.eye(FEATURES + 1)
    weights = np.linalg.lstsq(np.vstack([z, penalty]), np.append(y, np.zeros(FEATURES + 1)), rcond=None)[0]
    bins = Counter()
    ones = Counter()
    for r, v in zip(z @ weights, y, strict=True):
        b = math.floor(min(max(r, -1), 2) * BINS)
        bins[b] += 1
        ones[b] += v
    at = sorted(bins)
    n, share = np.array([bins[b] for b in at], float), np.array([ones[b] / bins[b] for b in at])
    # isotonic by its min-max formula; equal levels next to each other are one block
    total, good = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * share))
    levels = np.array([max(min((good[j] - good[i]) / (total[j] - total[i]) for j in range(k + 1, len(at) + 1)) for i in range(k + 1)) for k in range(len(at))])
    starts = [k for k in range(len(at)) if k == 0 or levels[k] - levels[k - 1] > 1e-12]
    ends = [*starts[1:], len(at)]
    steps = [sum(n[k] * (at[k] + 0.5) / BINS for k in range(i, j)) / (total[j] - total[i]) for i, j in zip(starts, ends, strict=True)]
    plain = np.array([np.interp(features(x[i]) @ weights, steps, levels[starts]) for i, _ in rows])
    ours = np.array([got[i] for i, _ in rows])
    # a raw score on the edge of a bin may fall to either side
    assert np.quantile(np.abs(plain - ours), 0.98) < 1e-3 and np.abs(plain - ours).max() < 0.1
