import numpy as np
import pyarrow as pa

from siftline.llm.textkit import Words, buffers, chunks, span_hash


def test_hashes_do_not_depend_on_place_or_blocks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 5000, 400))
    ends = np.minimum(starts + rng.integers(0, 1500, 400), 5000)
    whole = span_hash(data, starts, ends)
    for block in (1, 64, 1000, 4999, 5000):
        assert (span_hash(data, starts, ends, block) == whole).all()
    by_bytes = {}
    for h, a, b in zip(whole, starts, ends, strict=True):
        assert by_bytes.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)
    assert (span_hash(np.tile(data, 2), starts + 5000, ends + 5000) == whole).all()


def test_words_and_chunks_keep_to_texts():
    texts = ["a bb", None, "", "cc\xa0d\n e", " ", "x"]
    column = pa.array(texts).slice(0)
    got, seen = [], 0
    for i, j, data, offsets in chunks(column, limit=4):
        words = Words(data, offsets)
        for k in range(j - i):
            a, b = words.bounds[k], words.bounds[k + 1]
            got.append([data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)])
        seen += j - i
    assert seen == len(texts) and got == [["a", "bb"], [], [], ["cc\xa0d", "e"], [], ["x"]]
    data, offsets = buffers(pa.array(["zz", "é", "y"], pa.large_string()).slice(1))
    assert data.tobytes().decode() == "éy" and offsets.tolist() == [0, 2, 3]
