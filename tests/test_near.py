"""Near overlaps against brute force, with hot buckets; signatures; scripts; runs of whole groups."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.functions import arrow, json_values, scripts, signing
from siftline.functions.text import BANDS, HASHES, PRIME, ROWS, SCRIPTS, coefficients
from siftline.operators import leakage

WORDS = [f"w{i}" for i in range(40)] + ["é", "漢字"]


def variants(rng, n, base=None):
    """Texts near one text, each with some words changed."""
    base = base or [rng.choice(WORDS) for _ in range(60)]
    return [" ".join(rng.choice(WORDS) if rng.random() < 0.02 else w for w in base) for _ in range(n)]


def sign(text):
    words = text.lower().split()
    values = [int.from_bytes(hashlib.md5(" ".join(words[i : i + 3]).encode()).digest()[:4], "big") % PRIME for i in range(len(words) - 2)]
    return [min((a * v + b) % PRIME for v in values) for a, b in coefficients()] if values else None


def plain(rows, threshold):
    """(d, row, other, place row, similarity) by comparing all prompts."""
    signs, first = {r[2]: sign(r[2]) for r in rows}, {}
    for d, row, prompt in rows:
        first[prompt, d] = min(row, first.get((prompt, d), row))
    found = []
    for d, row, prompt in rows:
        for other in range(d):
            if (prompt, other) in first:
                found.append((d, row, other, first[prompt, other], None))
                continue
            best = None
            for (theirs, set_of), place in first.items():
                if set_of == other and threshold > 0 and signs[prompt] and signs[theirs]:
                    a, b = signs[prompt], signs[theirs]
                    bands = [k for k in range(BANDS) if a[ROWS * k : ROWS * k + ROWS] == b[ROWS * k : ROWS * k + ROWS]]
                    like = sum(x == y for x, y in zip(a, b, strict=True)) / HASHES
                    if bands and like >= threshold:
                        best = min(best or (0, 0, 0), (-like, bands[0], place))
            if best:
                found.append((d, row, other, best[2], -best[0]))
    return sorted(found, key=str)


def got(spark, rows, threshold):
    df = spark.createDataFrame([(d, "p", 0, row, prompt) for d, row, prompt in rows], "d int, path string, path_ord int, row long, prompt string").repartition(3)
    return sorted(((r.d, r.row, r.other, r.place.row, r.similarity) for r in leakage.overlaps(df, threshold).collect()), key=str)


@pytest.mark.parametrize("block", [leakage.BLOCK, 7])
def test_near_overlaps_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK", block)
    monkeypatch.setattr(leakage, "STRIP", 16)
    rng = random.Random(4)
    texts = variants(rng, 60) + variants(rng, 20) + variants(rng, 3) + [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(20)] + ["two words", "a b c"]
    rows = [(rng.randrange(3), i, t) for i, t in enumerate(texts)]
    rows += [(rng.randrange(3), 1000 + i, rng.choice(texts)) for i in range(60)]  # equal ones, in the same set and in others
    assert got(spark, rows, 0.6) == plain(rows, 0.6)
    assert got(spark, rows, 0) == plain(rows, 0)


def test_a_hot_bucket_is_dealt_over_all_tasks(spark, monkeypatch):
    """20,000 different signatures in one bucket, and no task has over twice the median of rows."""
    n, parts = 20_000, 8
    marks = spark.range(n).select(F.format_string("s%d", "id").alias("sign"), F.concat(F.array(*(F.lit(k).cast("long") for k in range(4))), F.transform(F.sequence(F.lit(5), F.lit(128)), lambda k: F.col("id") * 1000 + k)).alias("signature"), (F.col("id") % 2).cast("int").alias("half"), "id")
    signs = marks.select("sign", "signature", F.when(F.col("half") == 1, 1).alias("asks"), F.col("half").alias("least"))
    places = marks.where("half = 0").select("sign", F.lit(0).alias("d"), F.struct(F.lit(0).alias("path_ord"), F.lit("p").alias("path"), F.col("id").alias("row")).alias("place"))
    monkeypatch.setattr(leakage, "BLOCK", 1024)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        dealt = leakage.in_blocks(signs, places).groupBy(F.spark_partition_id().alias("task")).count()
        tasks = sorted(r["count"] for r in dealt.collect())
        rows = leakage.best_in_buckets(signs, places, 0.02).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(tasks) > parts / 2 and tasks[-1] <= 2 * tasks[len(tasks) // 2]
    # all have only the first band in common, four places of 128: the first place wins
    assert len(rows) == n // 2 and {(r.place.row, r.similarity) for r in rows} == {(0, 4 / 128)}


def test_prompts_are_read_and_signed_once(spark):
    """However often rows, places and signatures are used, what the prompts come from runs once."""
    seen, rng = spark.sparkContext.accumulator(0), random.Random(8)
    rows = [(rng.randrange(3), "p", 0, i, t) for i, t in enumerate(variants(rng, 30) * 2 + ["a b"])]

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "d int, path string, path_ord int, row long, prompt string")
    found = leakage.overlaps(df.mapInArrow(count, df.schema), 0.6).collect()
    assert {r.similarity is None for r in found} == {True, False}  # exact and near ones
    assert seen.value == len(rows)


def test_white_space_is_that_of_regular_expressions(spark):
    """Every character at the ends of a text, and in runs between its words; bytes that are not UTF-8 are not taken for parts of white space."""
    points = [c for c in [*range(0x3100), *range(0xFE00, 0x10000), 0x1D173, 0x1F600] if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"{chr(c)} {chr(c)}a b{chr(c)}{chr(c)}C\u3000 d{chr(c)}") for c in points], "id int, text string")
    df = df.union(spark.sql("SELECT -id AS id, cast(concat(b, encode('a b c', 'utf-8'), b) AS string) AS text FROM VALUES (1, X'85'), (2, X'80'), (3, X'2020'), (4, X'E380') AS t (id, b)"))
    pattern = json_values.SPACE
    trimmed = df.select("id", json_values.trim(F.col("text")).alias("got"), F.regexp_replace("text", f"^{pattern}+|{pattern}+$", "").alias("want"))
    assert trimmed.where("NOT got <=> want").collect() == []
    words = df.select("id", F.regexp_replace(F.lower("text"), f"{pattern}+", " ").cast("binary").alias("text")).collect()
    data, at = signing.single_blanks(*arrow.text_bytes(df.select("id", F.lower("text").alias("text")).toArrow().column("text").combine_chunks()))
    assert [bytes(data[i:j]).strip(b" ") for i, j in zip(at[:-1], at[1:], strict=True)] == [bytes(r.text).strip(b" ") for r in words]


def test_heads_of_md5_equal_those_of_hashlib():
    """Runs of bytes of up to one block, at its edge and beyond, in one batch and at the end of the data."""
    raw = np.frombuffer(bytes(random.Random(3).randrange(256) for _ in range(400)), np.uint8)
    runs = [(k, k + n) for n in [*range(70), 119, 120, 200] for k in (0, 7, 400 - n)]
    first, last = (np.array(x) for x in zip(*runs, strict=True))
    assert signing.md5_heads(raw, first, last).tolist() == [int.from_bytes(hashlib.md5(raw[a:b].tobytes()).digest()[:4], "big") for a, b in runs]
    assert signing.md5_heads(raw, first[:0], last[:0]).tolist() == []


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "  A  b\tC d ", "É é é É", "x " * 500])
def test_signatures_equal_plain_ones(spark, text):
    df = spark.createDataFrame([(1, "q r s t"), (2, text), (3, None)], "id long, text string").coalesce(1)
    found = {r.id: r.signature for r in signing.signatures(df).collect()}
    assert found == {k: v for k, v in {1: sign("q r s t"), 2: sign(text)}.items() if v}


def test_scripts_of_every_letter():
    import regex

    starts, kinds = scripts.ranges()
    assert (np.diff(starts) > 0).all() and starts[0] == 0
    rng = random.Random(1)
    for point in [*range(0x500), *(rng.randrange(0x110000) for _ in range(3000))]:
        char, want = chr(point), [0] * len(scripts.NAMES)
        if regex.fullmatch(r"\p{L}", char):
            own = [k for k, s in enumerate(SCRIPTS) if regex.fullmatch(rf"\p{{Script={s}}}", char)]
            want[own[0] if own else -1] = 1
        assert scripts.letters([char])[0].tolist() == want, hex(point)
    assert scripts.letters(["", "aé", "漢a字"]).tolist() == [[0] * 12, [2] + [0] * 11, [1, 2] + [0] * 10]


def test_whole_groups_are_not_cut():
    rng, keys = random.Random(2), []
    for k in range(40):
        keys += [k] * rng.choice([1, 1, 2, 30])
    batches, at = [], 0
    while at < len(keys):
        n = rng.randint(1, 12)
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n]), pa.array(range(at, min(len(keys), at + n)))], ["k", "v"]))
        at += n
    batches.insert(3, batches[0].slice(0, 0))
    out = list(arrow.whole_groups(iter(batches), ["k"]))
    assert [v for b in out for v in b.column("v").to_pylist()] == list(range(len(keys)))
    held = defaultdict(set)
    for i, b in enumerate(out):
        for k in b.column("k").to_pylist():
            held[k].add(i)
    assert all(len(v) == 1 for v in held.values())
