import hashlib
import random
import re
import struct
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm.fingerprints import BITS, BLOCKS, LONGEST, RADIUS, SHARES, changes, fingerprint_all, fingerprints, with_near, within_radius
from siftline.llm.jaccard import shingles
from siftline.llm.textkit import buffers, span_hash

from .conftest import sentence


@pytest.mark.parametrize("parts", ["1", "5"])
def test_edited_texts_follow_the_next_document(spark, make_docs, odd_rows, parts):
    rows = [r[:2] for r in odd_rows if r[0] not in (None, 104)] + [(200, "é𝒜"), (300, "last")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in fingerprint_all(make_docs(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted((i, t or "") for i, t in rows)
    assert sorted(got) == [i for i, _ in ordered]
    marks = {}
    for k, (i, text) in enumerate(ordered):
        after, half, r = ordered[(k + 1) % len(ordered)], len(text) // 2, got[i]
        edited = text[: len(text) - half] + after[1][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), i
        like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, got[after[0]].fingerprint)
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint
        if edited in marks:
            assert marks[edited] == r.edited_fingerprint


def test_likeness_grows_with_shared_text(make_docs):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 200)) for i in range(40)]
    got = fingerprint_all(make_docs(rows)).collect()
    assert sum(r.near_edited for r in got) / 40 > sum(r.near_next for r in got) / 40 + 0.08


def test_search_finds_all_within_radius(spark):
    rng = random.Random(6)
    marks = [rng.getrandbits(128) for _ in range(60)]
    for m in list(marks):
        for _ in range(4):
            for b in rng.sample(range(128), rng.randint(1, RADIUS + 3)):
                m ^= 1 << b
            marks.append(m)
    df = spark.createDataFrame([(i, f"{m:032x}") for i, m in enumerate(marks)] + [(1000, f"{marks[0]:032x}")], "doc_id long, fingerprint string")
    got = {(r.fingerprint, r.near, r.distance) for r in within_radius(df, df).collect()}
    expected = {(f"{a:032x}", f"{b:032x}", d) for a in marks for b in marks if (d := bin(a ^ b).count("1")) <= RADIUS}
    assert got == expected
    rows = with_near(df).collect()
    assert len(rows) == len(marks) + 1
    for r in rows:
        own = sum(bin(int(r.fingerprint, 16) ^ b).count("1") <= RADIUS for b in [*marks, marks[0]]) - 1
        assert r.n_near == (own if r.doc_id % 20 == 0 else None)


def test_one_row_and_none(make_docs):
    docs = make_docs([(5, "only one text")])
    (row,) = with_near(fingerprint_all(docs)).collect()
    assert row.near_next == 1.0 and row.n_chars == 13 and row.edited_sha256 == hashlib.sha256(b"only ononly o").hexdigest()
    assert with_near(fingerprint_all(docs.limit(0))).count() == 0
    twice = fingerprint_all(make_docs([(5, "same"), (5, "same"), (None, None)])).collect()
    assert len(twice) == 3


def test_near_copies_lie_within_radius():
    rng, pairs = random.Random(8), []
    for _ in range(400):
        words = sentence(rng, rng.randint(60, 300)).split(" ")
        edits = list(words)
        for _ in range(max(1, round(len(words) * rng.uniform(0.01, 0.024)))):
            edits[rng.randrange(len(edits))] = sentence(rng, 1)
        pairs += [" ".join(words), " ".join(edits)]
    data, offsets = buffers(pa.array(pairs))
    keys, bounds = shingles(data, offsets)
    sets = [set(keys[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    like = np.array([len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    marks = fingerprints(data, offsets)
    far = np.unpackbits(marks[::2] ^ marks[1::2], axis=1).sum(axis=1)[(like >= 0.8) & (like < 0.9)]
    assert len(far) > 100 and (far <= RADIUS).mean() >= 0.95


def test_shares_cover_the_radius():
    assert sum(s + 1 for s in SHARES) == RADIUS + 1 and len(changes()) == len(set(changes())) and len(SHARES) == BLOCKS


def plain_fingerprint(text):
    """The votes of a text's words and pairs of words, one term and one bit at a time."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    terms = [(hash_of(w), min(len(w), LONGEST)) for w in words]
    terms += [(pair_of(terms[k][0], terms[k + 1][0]), terms[k][1] + terms[k + 1][1]) for k in range(len(words) - 1)]
    out = 0
    for bit in range(BITS):
        votes = sum(weight if bits_of(h)[bit] else -weight for h, weight in terms)
        out = out << 1 | (votes > 0)
    return f"{out:032x}"


@lru_cache(None)
def hash_of(word):
    data = np.frombuffer(word, np.uint8)
    return int(span_hash(data, np.array([0]), np.array([len(data)]))[0])


def finish(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def pair_of(a, b):
    return finish((a * 0x9E3779B97F4A7C15 + b) % 2**64)


@lru_cache(None)
def bits_of(h):
    """128 bits in the order of the fingerprint's bytes, each byte from its high bit."""
    raw = struct.pack("<QQ", finish((h + 1) % 2**64), finish(h ^ 0xA5A5A5A55A5A5A5A))
    return [byte >> k & 1 for byte in raw for k in range(7, -1, -1)]


def test_bits_equal_plain_votes(make_docs, odd_rows):
    """Also of ties, repeated rows, null ids and the long texts."""
    docs = make_docs(odd_rows)
    texts = [t or "" for _, t, *_ in odd_rows]
    got = fingerprint_all(docs).collect()
    assert Counter(r.fingerprint for r in got) == Counter(map(plain_fingerprint, texts))
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))  # null first; 104 comes twice with one text
    assert [r[0] for r in ordered] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    edited = []
    for k, (_, t, *_) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1] or ""
        t = t or ""
        edited.append(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
    assert Counter(r.edited_fingerprint for r in got) == Counter(map(plain_fingerprint, edited))
    assert Counter(r.edited_sha256 for r in got) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in edited)
