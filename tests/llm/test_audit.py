"""The audit of filters against plain counts, on odd rows and on tables without any."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from siftline.llm import audit
from siftline.llm.textkit import CHUNK

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(rows, i):
    doc_id, text = rows[i][0], rows[i][1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    copy = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows)
    return {f for f, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy), strict=True) if x}


def plain(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    docs, out = [(r[2] or "", failed(rows, i), r[0]) for i, r in enumerate(rows)], []
    for part in sorted({d[0] for d in docs}):
        own, shapley, found = [d for d in docs if d[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                redundant = sum(f in d[1] for d in own) - len(gone)
                found.append([part, order, step, len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] in good for d in gone), sum(d[2] in toxic for d in gone)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def built(spark, rows, labels):
    docs = spark.createDataFrame([(*r[:3], 1, 2, 3) for r in rows], "doc_id long, text string, source string, bits int, mark long, key int").repartition(3)
    return sorted(map(tuple, audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(*COLUMNS).collect()))


def test_equals_plain_counts(spark, odd_rows):
    rng = random.Random(8)
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in odd_rows]
    rows += [(200 + i, " ".join(rng.choice(["One", "two", "a", "b#", "3"]) for _ in range(rng.randint(30, 90))), rng.choice(["a", "", None])) for i in range(80)]
    rows += [(300 + i, "the same text", "hot") for i in range(40)] + [(300, "the same text", "hot"), (None, "the same text", "hot")]
    rows += [(900, " ".join(f"w{i}" for i in range(300_000)), "long")]
    assert len(rows[-1][1]) > CHUNK
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows[::2]] + [(1, 1, 1), (1, 0, 0), (None, 1, 1), (77777, 1, 1)]
    assert built(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    assert built(spark, [], []) == []
    assert built(spark, [(None, None, None)], []) == plain([(None, None, None)], [])


def test_counts_of_prefixes():
    codes = np.random.default_rng(4).integers(0, 128, 1001).astype(np.uint8)
    counts = audit.prefix_counts(codes)
    for before in range(audit.PREFIXES):
        left = codes[codes & before == 0]
        assert counts[before, 0] == len(left)
        for k in range(5):
            gone = left[left >> k & 1 == 1]
            assert counts[before, [1 + k, 6 + k, 11 + k]].tolist() == [len(gone), int((gone & audit.GOOD > 0).sum()), int((gone & audit.TOXIC > 0).sum())]
