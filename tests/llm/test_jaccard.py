import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from siftline.llm import common
from siftline.llm.jaccard import LEVELS, RECALL, _root, _split, components, forest, jaccard_join, keep_one, runs_for, unlike

from .conftest import sentence


def brute(rows):
    """text_id, number of linked texts and class of each row, from all pairs of different texts."""
    first = {}
    for i, t in rows:
        t = t or ""
        first[t] = i if first.get(t) is None else min(x for x in (first[t], i) if x is not None) if i is not None else first[t]
    sets = {}
    for t in first:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    texts, links, parent = list(sets), Counter(), {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for t in texts:
        if first[t] is not None:
            least[root(t)] = min(first[t], least.get(root(t), first[t]))
    return [(i, least.get(root(t or "")), first[t or ""], links[t or ""]) for i, t in rows]


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["new" + str(rng.randrange(10**6))], [words[k], "more"]])
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(12)
    out = [r[:2] for r in odd_rows]
    passage = sentence(rng, 60)
    at = 5000
    for size, edits in ((260, 4), (40, 3), (3, 2), (2, 1), (2, 9)):  # groups of near copies, the first larger than several blocks
        base = sentence(rng, 180)
        for _ in range(size):
            out.append((at, edited(rng, base, rng.randint(0, edits))))
            at += 1
    for _ in range(120):  # texts that only share a passage
        out.append((at, sentence(rng, rng.randint(20, 90)) + " " + passage))
        at += 1
    out += [(at + k, out[60 + 7 * k][1]) for k in range(30)]
    rng.shuffle(out)
    return out


def test_links_and_classes_equal_brute_force(make_docs, rows):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in jaccard_join(make_docs(rows)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_large_groups_over_many_partitions(spark, make_docs, monkeypatch):
    """A large group of equal texts, one of near copies and a passage that many share, with every key of some rows a hot one."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    rng = random.Random(21)
    base, same, passage = sentence(rng, 150), sentence(rng, 90), sentence(rng, 40)
    rows = [(i, same) for i in range(700)] + [(1000 + i, edited(rng, base, rng.randint(0, 4))) for i in range(450)]
    rows += [(2000 + i, f"{sentence(rng, rng.randint(20, 60))} {passage}") for i in range(300)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = make_docs(rows).repartition(31)
        expected = brute(rows)
        assert sorted(map(tuple, jaccard_join(docs).collect())) == sorted(expected)
        assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted({c for _, c, _, _ in expected})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recall_on_all_pairs_of_sf01(spark):
    """Every link of sf0.1, found by counting shared shingles of all texts, is in a class, and every text has all its links."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = {}
    for i, t in rows:
        texts[t] = min(i, texts.get(t, i))
    names, sizes, of = list(texts.values()), [], defaultdict(list)
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {hash(tuple(w[j : j + 5])) for j in range(len(w) - 4)} or {hash(tuple(w))}
        sizes.append(len(own))
        for x in own:
            of[x].append(k)
    shared = Counter()
    for members in of.values():
        shared.update(combinations(members, 2))
    links = Counter()
    for (a, b), n in shared.items():
        if n >= 0.8 * (sizes[a] + sizes[b] - n) - 1e-9:
            links[names[a]] += 1
            links[names[b]] += 1
    assert sum(links.values()) > 60
    got = {r.text_id: r.n_links for r in jaccard_join(docs).collect()}
    assert {i: n for i, n in got.items() if n} == dict(links)


def test_one_document_of_each_class_stays(make_docs, rows):
    docs = make_docs([*rows, (7, "the same id, another text")])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(got.values()) == 1
    expected = {c for _, c, _, _ in brute([*rows, (7, "the same id, another text")])}
    assert {i for i, _ in got} == expected and (7, "the same id, another text") in got


def test_empty_and_null_tables(make_docs):
    docs = make_docs([(None, None), (None, "a"), (1, "")])
    assert jaccard_join(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join(docs).collect()) == [("1", "1", 0), ("None", "1", 0), ("None", "None", 0)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5002, 5001), (5002, 5000)]
    rng.shuffle(edges)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)} | {i: 5000 for i in (5000, 5001, 5002)}


def test_forest_and_runs():
    links = np.zeros((5, 5), bool)
    for a, b in ((0, 3), (3, 4), (1, 2)):
        links[a, b] = links[b, a] = True
    assert forest(links).tolist() == [0, 1, 1, 0, 0]
    assert runs_for(0.99) < runs_for(0.99999)


def test_runs_cover_all_levels():
    rng, runs, n = np.random.default_rng(9), runs_for(), 4000
    a = [rng.integers(0, 1 << 32, (n, 2 * k * runs), dtype=np.uint32) for k in (1, LEVELS - 1)]
    b = [np.where(rng.random(x.shape) < 0.8, x, rng.integers(0, 1 << 32, x.shape, dtype=np.uint32)) for x in a]
    met = []
    for run in range(runs):
        sides = []
        for tokens in (a, b):
            pair, path = np.arange(n), _root(run, n)
            for level in range(LEVELS):
                rows, path = _split(tokens[min(level, 1)][pair], path, run, level)
                pair = pair[rows]
            sides.append(set(zip(pair.tolist(), path.tolist(), strict=True)))
        met.append(len({p for p, _ in sides[0] & sides[1]}) / n)
    # runs have no token in common, so their misses multiply
    assert np.prod([1 - m for m in met]) + unlike() <= 1 - RECALL
