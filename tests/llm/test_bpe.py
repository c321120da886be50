import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import bpe
from siftline.llm.bpe import decode, encode, round_trip
from siftline.llm.token_counts import edit_trees, keep_trees, three_edits


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["it's we're I'll 's ' s ''s x''s\n's 're'd 'l", "hello   world  \n\n x\t\ty ", " 　 é's 123abc 1²½ <|endoftext|>", "ab" * 400 + " " + "x1" * 300, "q" * 3000, "a" * 71 + " " + "の" * 700, "abcab" * 900, "\n a", "'", "日本語 テキスト"]


def test_ids_equal_the_library_and_decode(make_docs, odd_rows, library):
    rows = [r[:2] for r in odd_rows] + [(2000 + i, t) for i, t in enumerate(HARD)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(make_docs(rows)).collect())
    expected = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        sha = hashlib.sha256(b"".join(struct.pack("<I", i) for i in ids)).hexdigest()
        expected.append((doc_id if doc_id is not None else -1, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected)
    encoded = encode(make_docs(rows))
    assert encoded.columns[:1] == ["doc_id"] and "text" not in encoded.columns
    back = {r.doc_id: bytes(r.decoded).decode() for r in decode(encoded).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert round_trip(make_docs(rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["'s", "'", "s", "re", " ", "  ", "\n", "\t", "a", "é", "1", "!", "𝒜", "'ll", "日本", "́", "--", "\xa0", "zq" * 9]) | st.text(max_size=3), max_size=14))
def test_any_text_equals_the_library(library, parts):
    import pyarrow as pa

    text = "".join(parts)
    words = bpe.vocabulary(bpe.read_ranks(bpe.default_ranks()))
    ((_, _, data, offsets),) = bpe.chunks(pa.array([text]))
    ids, _ = bpe.encode_chunk(words, data, offsets)
    assert ids.tolist() == library.encode_ordinary(text)


def test_wide_matrices_equal_the_library(library):
    rng = random.Random(7)
    words = bpe.vocabulary(bpe.read_ranks(bpe.default_ranks()))
    for n in (49, 130, 700, 5000, 70_000):
        for letters in ("ab", "ethransio", "日本語の人あい", "é"):
            piece = "".join(rng.choice(letters) for _ in range(n)).encode()
            data = bpe.np.frombuffer(piece, bpe.np.uint8)
            ids, (many,) = words.encode_pieces(data, bpe.np.array([0]), bpe.np.array([len(data)]))
            assert ids.tolist() == library.encode_ordinary(piece.decode()) and many == len(ids)


def edited_text(text, edits):
    for start, stop, new in edits:
        start = min(start, len(text))
        text = text[:start] + (new or "") + text[min(max(stop, start), len(text)) :]
    return text


def test_kept_trees_follow_later_edits(spark, make_docs, odd_rows, library, tmp_path):
    """Trees are written, edited, written again and edited again; the counts are those of the texts encoded afresh."""
    rng = random.Random(3)
    rows = [r[:2] for r in odd_rows if r[0] is not None and r[0] != 104] + [(2000 + i, t) for i, t in enumerate(HARD)] + [(3000 + i, "".join(rng.choice(["a", " ", "\n", "'s", "1", "é ", "!"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    texts = {i: t or "" for i, t in rows}
    keep_trees(make_docs(rows)).write.parquet(str(tmp_path / "0"))
    for turn in range(2):
        kept = spark.read.parquet(str(tmp_path / str(turn)))
        edits = {}
        for i, t in texts.items():
            n = len(t)
            edits[i] = [(a := rng.randint(0, n + 2), rng.choice([a, a + 1, a + 5, a - 1, n + 9]), rng.choice(["", " ", "x", "'s", "\n\n ", " word", None, "many words " * 200])) for _ in range(rng.randint(0, 5))]
        given_edits = spark.createDataFrame(list(edits.items()), "id long, edits array<struct<start:long,stop:long,text:string>>")
        edit_trees(kept.join(given_edits, kept["doc_id"] == given_edits["id"])).write.parquet(str(tmp_path / str(turn + 1)))
        got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / str(turn + 1))).collect()}
        assert set(got) == set(texts)
        for i, r in got.items():
            assert r.tokens_before == len(library.encode_ordinary(texts[i]))
            texts[i] = edited_text(texts[i], edits[i])
            ids = library.encode_ordinary(texts[i])
            assert (r.text, r.n_chars, r.n_tokens) == (texts[i], len(texts[i]), len(ids)), (i, edits[i])
            assert sum(r.tokens) == r.node_tokens[1] == len(ids) and sum(r.widths) == r.node_chars[1] == len(texts[i]) and sum(r.sizes) == len(r.widths) == r.n_pretokens


def test_edits_reencode_little(make_docs, odd_rows):
    kept = keep_trees(make_docs(odd_rows))
    rows = edit_trees(kept.withColumn("edits", three_edits()), texts=False).collect()
    assert len(rows) == len(odd_rows)
    long = [r for r in rows if r.doc_id == 103][0]
    assert long.pretokens_before > 8000 and 0 < long.reencoded < 60
    plain = edit_trees(kept.withColumn("edits", F.lit(None))).collect()
    assert all(r.tokens_before == r.n_tokens and r.reencoded == 0 for r in plain)
    assert keep_trees(make_docs(odd_rows).limit(0)).count() == 0
