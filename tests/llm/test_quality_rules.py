import base64
import os
import random
import re
from collections import Counter

import zstandard

from siftline.llm.quality_rules import BAD_CHUNKS, CHUNK, CHUNK_BANDS, LEVEL, WHOLE_BANDS, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked),
        len(words) < 50 or 100 * len(marked) > 50 * len(words),
    )


def test_counts_equal_brute_force(make_docs, odd_rows):
    got = quality_rules(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    for doc_id, text, *_ in odd_rows:
        for r in (r for r in got if r.doc_id == doc_id):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), doc_id


def band(ratio, n, bands):
    """Whether a ratio lies outside the band of its length; None if the length has none."""
    own = [b for b in bands if n >= b[0]]
    return None if not own else not own[-1][1] <= ratio <= own[-1][2]


def test_bands_equal_a_plain_version(spark, make_docs, odd_rows):
    """Ratios, bands and verdicts worked out text by text with the plain library, over odd rows and the documents of sf0.01."""
    rows = [(5000 + k, t) for k, (_, t, *_) in enumerate(odd_rows)] + [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    noise = base64.b64encode(random.Random(3).randbytes(30_000)).decode()
    rows += [(9000 + n, " ".join(noise[i : i + 60] for i in range(0, n, 60))) for n in (3100, 9000, 40_000)]
    rows += [(9100, rows[3][1] + " " + " ".join(noise[i : i + 60] for i in range(0, 9000, 60)))]
    got = {r.doc_id: r for r in quality_rules(make_docs(rows)).collect()}
    press = zstandard.ZstdCompressor(level=LEVEL)
    verdicts = set()
    for doc_id, text in rows:
        raw = (text or "").encode()
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        ratios = [len(press.compress(p)) / len(p) for p in parts]
        whole = len(press.compress(raw)) / len(raw) if raw else 0.0
        judged = [x for p, q in zip(parts, ratios, strict=True) if (x := band(q, len(p), CHUNK_BANDS)) is not None]
        shown = [q for p, q in zip(parts, ratios, strict=True) if len(p) >= CHUNK_BANDS[0][0] or len(parts) == 1]
        bad = bool(band(whole, len(raw), WHOLE_BANDS)) or sum(judged) > BAD_CHUNKS * len(judged)
        r = got[doc_id]
        assert (r.whole_ratio, r.min_chunk_ratio, r.max_chunk_ratio) == (whole, min(shown, default=0.0), max(shown, default=0.0)), doc_id
        assert r.kept == (not r.base_failed and not bad), doc_id
        verdicts.add((r.base_failed, bad))
    assert {(False, False), (False, True), (True, True)} <= verdicts


def test_bands_reject_repetition_and_noise_and_keep_prose(make_docs):
    from .conftest import sentence

    rng = random.Random(9)
    noise = base64.b64encode(os.urandom(9000)).decode()
    noise = " ".join(noise[i : i + 60] for i in range(0, len(noise), 60))
    # no three-word window repeats, but the text does as a whole
    cycle = [f"{w}" for i in range(12) for w in (f"word{i % 3} filler{i % 4} tail{i}", "same old phrase again") for _ in range(6)]
    rows = [(1, sentence(rng, 700)), (2, noise), (3, "the same words " * 300), (4, " ".join(cycle)), (5, sentence(rng, 60))]
    got = {r.doc_id: r for r in quality_rules(make_docs(rows)).collect()}
    assert got[1].kept and got[5].kept
    assert not got[2].base_failed and not got[2].kept and got[2].whole_ratio > 0.7
    assert not got[3].kept and got[3].whole_ratio < 0.05
    assert not got[4].kept


def test_empty_table_and_repeated_rows(make_docs):
    assert quality_rules(make_docs([(1, "a")]).limit(0)).count() == 0
    assert quality_rules(make_docs([(1, "a b"), (1, "a b")])).count() == 2
