"""The prefix trie against a plain one in Python, on families, long conversations, ties and odd rows; running sums on many partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import trie
from siftline.llm.ranges import powers, running

SCHEMA = "conv_id long, turn long, role string, text string, depth int, first string"


def plain(rows):
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    half = lambda d, i: int.from_bytes(bytes.fromhex(d[16 * i : 16 * i + 16]), "big", signed=True)
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            d = digest(role or "", text or "")
            own[c].append(((turn is not None, turn or 0, half(d, 0), half(d, 1)), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items())


def built(spark, rows, parts=3):
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return sorted(map(tuple, found), key=lambda r: (r[0], r[1]))


def chats(rng, ids, longest=9):
    words = ["yes", "no", "go on", "é𝒜", "", None]
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words), 7, "x") for c in ids for t in range(rng.randint(1, longest))]


def test_equals_a_plain_trie(spark):
    rng = random.Random(3)
    rows = chats(rng, [*range(-30, 30), *range(100, 160), 305, 306, 10**15 + 1, 9_000_000_000])
    rows += [(500, None, "user", "first", 1, ""), (500, 3, "b", "tie", 1, ""), (500, 3, "a", "tie", 1, ""), (500, 3, "a", "tie", 1, ""), (None, 0, "user", "lost", 1, "")]
    rows += [(c, t, "user", "same", 1, "") for c in range(4000, 4300) for t in range(3)]  # one very common conversation
    rows += [(7001, t, "user", f"t{t % 5}", 1, "") for t in range(700)] + [(7002, t, "user", f"t{t % 5}", 1, "") for t in range(650)]
    assert built(spark, rows) == plain(rows)


def test_many_partitions_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "BLOCK", 8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = chats(random.Random(5), range(90)) + [(300, t, "user", "long", 1, "") for t in range(400)]
        rows += [(c, 0, "user", "same", 1, "") for c in range(1000, 1090)]
        assert built(spark, rows, 9) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None)], [(5, None, None, None, None, None)], [(0, 0, "user", "a", 1, "")]])
def test_few_rows(spark, rows):
    assert built(spark, rows, 1) == plain(rows)


def test_running_sums_over_groups_that_take_many_partitions(spark):
    rng = random.Random(1)
    sizes = [500, 1, 1, 40, 300, 2]
    rows = [(g, i, rng.getrandbits(63) - (1 << 62)) for g, n in enumerate(sizes) for i in range(n)]
    got = running(spark.createDataFrame(rows, "g long, i long, v long").repartition(5), "g", [F.col("i").desc()], ["i", "v"], {"v": 12345678901}, ["i"], ["v"]).collect()
    by = {(r.g, r.i): r for r in got}
    assert len(got) == len(rows)
    for g, n in enumerate(sizes):
        own, total = [r for r in rows if r[0] == g][::-1], 0
        for place, (_, i, v) in enumerate(own):
            total = (total + v * pow(12345678901, place, 1 << 64)) % (1 << 64)
            r = by[g, i]
            assert (r.place, r.last, r.sum_v % (1 << 64)) == (place, place == n - 1, total)
            assert (r.next_i, r.previous_v) == (None if place == n - 1 else i - 1, None if place == 0 else own[place - 1][2])


def test_powers():
    e = np.array([0, 1, 2, 63, 1000003])
    assert powers(0xD6E8FEB86659FD93, e).tolist() == [pow(0xD6E8FEB86659FD93, int(x), 1 << 64) for x in e]
