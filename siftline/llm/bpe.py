"""Byte-level BPE: encoding and decoding of whole texts with the ranks of a public vocabulary.

Texts are cut into pre-tokens by the public pattern, worked out on arrays of code points. Equal pre-tokens of a chunk are
encoded once. A pre-token that is itself in the vocabulary is one token; the others are rows of padded matrices, one
matrix for each range of lengths. In each round every row merges its leftmost pair of least rank: ranks of pairs come from
a hash table, rows are compacted to the left, and rows without a pair leave the matrix. Rows of over SHORT bytes merge all
their pairs of that rank in one round, from the left, unless one of these merges makes a pair of a lower rank, which would
come before the others; so the ids are the same. Only runs of over LONGEST bytes without any boundary take the same merges
from a heap, as the work in a matrix grows with length times rounds. Spans are told apart by 64-bit hashes.

Edge cases: a null text is an empty one, with no tokens. Repeated rows each give a row. Null doc_ids are kept. Special
tokens are ordinary text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import map_batches, plain_names
from .textkit import U64, chunks, span_hash

#: Bytes of text worked on at once: more find more pre-tokens equal, and take more memory.
CHUNK = 1 << 20
SHORT, LONGEST = 48, 1 << 16
WIDTHS = (4, 8, 12, 16, 24, SHORT, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, LONGEST)
#: Bytes of a matrix's rows that are merged together.
MATRIX = 1 << 20
NO_RANK = np.iinfo(np.int32).max
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    table = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    # The Unicode property White_Space.
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens in bytes (each ends where the next begins), and for each text its first one, n + 1 bounds.

    Runs of one kind are pre-tokens, with these exceptions: the last blank of a white-space run before other text stands
    alone, or joins that text if it is a space; 's 't 're 've 'm 'll 'd are pre-tokens if the apostrophe begins one.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n, kind = len(code), kinds()[code]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    first[n] = True
    cut = first[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    cut[after - 1] = True
    cut[after[code[after - 1] == 32]] = False
    quote = np.flatnonzero((code[:-1] == 39) & (kind[1:] == LETTER) & cut[:-1] & ~first[1:n])
    one = code[quote + 1]
    two = np.where(first[np.minimum(quote + 2, n)], 0, code[np.minimum(quote + 2, n - 1)])
    length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        length[(one == ord(a)) & (two == ord(b))] = 2
    quote, length = quote[length > 0], length[length > 0]
    cut[quote + 1] = False
    end = quote + 1 + length
    cut[end[end < n]] = True
    starts = at[np.flatnonzero(cut)]
    return starts, np.searchsorted(starts, offsets)


class Vocabulary:
    """Ranks of byte strings, a hash table of the pairs that merge, and the bytes of each token for decoding."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.size = max(self.ranks.values()) + 1
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        widths = np.zeros(self.size, np.int64)
        for t in tokens:
            widths[self.ranks[t]] = len(t)
        self.widths, self.begins = widths, np.cumsum(widths) - widths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        ends = self.begins + widths
        used = np.flatnonzero(widths)
        hashes = span_hash(self.bytes, self.begins[used], ends[used])
        order = np.argsort(hashes)
        self.hashes, self.hashed = hashes[order], used[order].astype(np.int32)
        splits = ((t[:i], t[i:], t) for t in tokens for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        left, right, rank = np.fromiter((self.ranks[x] for three in splits for x in three), np.int64).reshape(-1, 3).T
        self._build(left * self.size + right, rank)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: in each round, the first of the keys that want a free slot gets it and the others move on."""
        self.shift = 64 - max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        self.values = np.full(len(self.slots), NO_RANK, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.slots[slot] < 0
            _, chosen = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[chosen]
            self.slots[slot[chosen]], self.values[slot[chosen]] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(self.shift)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges to; NO_RANK if it does not, or if a side is padding (negative)."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(len(keys), NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.slots[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (there >= 0)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.slots) - 1)
        return out

    def _merge_matrix(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """tokens: rows of ids padded by -1. The merged rows, and how many ids each has."""
        n, width = tokens.shape
        ids, counts = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        rows = np.arange(n)
        tokens = np.column_stack([tokens, np.full((n, 2), -1, np.int32)])
        ranks = self.pair_ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width + 1)
        columns = np.arange(width + 2)
        while len(rows):
            place = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), place]
            done = best == NO_RANK
            if done.any():
                kept = min(width, tokens.shape[1])
                ids[rows[done], :kept] = tokens[done, :kept]
                counts[rows[done]] = (tokens[done] >= 0).sum(axis=1)
                rows, tokens, ranks, place, best = rows[~done], tokens[~done], ranks[~done], place[~done], best[~done]
                if not len(rows):
                    break
                used = int((tokens >= 0).sum(axis=1).max()) + 2
                tokens, ranks = tokens[:, :used], ranks[:, : used - 1]
                columns = columns[:used]
            here = np.arange(len(rows))
            step = columns[None, :] + (columns[None, :] > place[:, None])
            step[:, -1] = len(columns) - 1
            tokens = np.take_along_axis(tokens, step, axis=1)
            tokens[here, place] = best
            ranks = np.take_along_axis(ranks, np.minimum(step[:, :-1], len(columns) - 2), axis=1)
            ranks[here, place] = self.pair_ranks(best, tokens[here, place + 1])
            inner = np.flatnonzero(place > 0)
            ranks[inner, place[inner] - 1] = self.pair_ranks(tokens[inner, place[inner] - 1], best[inner])
        return ids, counts

    def _merge_all(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _merge_matrix, with all of a row's pairs of least rank in one round."""
        n, width = tokens.shape
        ids, counts = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        rows = np.arange(n)
        tokens = np.column_stack([tokens, np.full(n, -1, np.int32)])
        ranks = self.pair_ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width)
        while len(rows):
            best = ranks.min(axis=1)
            done = best == NO_RANK
            if done.any():
                ids[rows[done], : tokens.shape[1] - 1] = tokens[done, :-1]
                counts[rows[done]] = (tokens[done] >= 0).sum(axis=1)
                rows, tokens, ranks, best = rows[~done], tokens[~done], ranks[~done], best[~done]
                if not len(rows):
                    break
            hit, columns = ranks == best[:, None], np.arange(ranks.shape[1])
            fresh = hit.copy()
            fresh[:, 1:] &= ~hit[:, :-1]
            hit &= (columns - np.maximum.accumulate(np.where(fresh, columns, 0), axis=1)) % 2 == 0  # in a run, every second
            row, at = np.nonzero(hit)
            made, last = best[row], tokens.shape[1] - 1
            after = np.where(at + 2 <= last, tokens[row, np.minimum(at + 2, last)], -1)
            prior = np.where(at > 0, np.where((at > 1) & hit[row, np.maximum(at - 2, 0)], made, tokens[row, np.maximum(at - 1, 0)]), -1)
            early = np.unique(row[np.minimum(self.pair_ranks(made, after), self.pair_ranks(prior, made)) < made])
            if len(early):
                first = hit[early].argmax(axis=1)
                hit[early] = False
                hit[early, first] = True
                row, at = np.nonzero(hit)
            kept = tokens >= 0
            kept[:, 1:] &= ~hit
            to = np.cumsum(kept, axis=1) - 1
            tokens[row, at] = best[row]
            place = to[row, at]
            row_kept, at_kept = np.nonzero(kept[:, :-1])
            used, place_kept = int(to[:, -1].max()) + 1, to[row_kept, at_kept]
            fewer, lower = np.full((len(rows), used + 1), -1, np.int32), np.full((len(rows), used), NO_RANK, np.int32)
            fewer[row_kept, place_kept], lower[row_kept, place_kept] = tokens[row_kept, at_kept], ranks[row_kept, at_kept]
            lower[row, place] = self.pair_ranks(fewer[row, place], fewer[row, place + 1])
            row, place = row[place > 0], place[place > 0] - 1
            lower[row, place] = self.pair_ranks(fewer[row, place], fewer[row, place + 1])
            tokens, ranks = fewer, lower
        return ids, counts

    def _merge_heap(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece: a heap of (rank, place) over a linked list."""
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        parts = {i: piece[i : i + 1] for i in range(len(ids))}
        heap = [(r, i, 2) for i in range(len(ids) - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, length = heapq.heappop(heap)
            j = after[i] if i in parts else len(ids)
            if i not in parts or j not in parts or len(parts[i]) + len(parts[j]) != length or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts.pop(j)
            ids[i], after[i] = rank, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a in parts and b in parts and (r := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ids[i] for i in sorted(parts)]

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces data[start:end] in a row, and the number of ids of each. Equal pieces are encoded once."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes, first, of = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        lengths = ends - starts
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        whole = self.hashes[place] == hashes
        counts = np.where(whole, 1, 0).astype(np.int64)
        found = [(np.flatnonzero(whole), self.hashed[place[whole]])]
        low = 0
        for width in WIDTHS:
            of_width = np.flatnonzero(~whole & (lengths > low) & (lengths <= width))
            low, many = width, max(1, MATRIX // width) if width > SHORT else max(1, len(of_width))
            for i in range(0, len(of_width), many):
                rows = of_width[i : i + many]
                index = starts[rows, None] + np.arange(width)
                inside = index < ends[rows, None]
                tokens = np.where(inside, self.single[data[np.minimum(index, len(data) - 1)]], -1).astype(np.int32)
                ids, counts[rows] = (self._merge_all if width > SHORT else self._merge_matrix)(tokens)
                found.append((np.repeat(rows, counts[rows]), ids[ids >= 0]))
        for row in np.flatnonzero(~whole & (lengths > LONGEST)):
            ids = self._merge_heap(data[starts[row] : ends[row]].tobytes())
            counts[row] = len(ids)
            found.append((np.full(len(ids), row), np.array(ids, np.int32)))
        owner, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = ids[np.argsort(owner, kind="stable")]
        begins, many = np.cumsum(counts) - counts, counts[of]
        return ids[spread_index(begins[of], many)], many

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and n + 1 offsets of them."""
        widths = self.widths[ids]
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(widths, out=offsets[1:])
        return self.bytes[spread_index(self.begins[ids], widths)], offsets


def spread_index(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... count times for each, in a row."""
    before = np.cumsum(counts) - counts
    return np.repeat(begins - before, counts) + np.arange(int(counts.sum()))


@lru_cache(maxsize=2)
def vocabulary(lines: bytes) -> Vocabulary:
    """Built once in each Python worker."""
    return Vocabulary(lines)


def read_ranks(path: str) -> bytes:
    """The lines of a rank file, for a broadcast: its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_chunk(words: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk in a row, and n + 1 bounds."""
    starts, bounds = pretokens(data, offsets)
    ids, counts = words.encode_pieces(data, starts, np.append(starts[1:], len(data)))
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return ids, total[bounds]


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """docs without text, with n_tokens and ids, an array of integers; these take the place of columns of such names in any case."""
    docs, back = plain_names(docs, "text", replaced=("n_tokens", "ids"))
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks or default_ranks()))
    others = [c for c in docs.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for i, j, data, offsets in chunks(batch.column("text"), CHUNK):
            ids, bounds = encode_chunk(words, data, offsets)
            arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in others), pa.array(np.diff(bounds)), arrays], [*others, "n_tokens", "ids"])

    schema = StructType([docs.schema[c] for c in others]).add("n_tokens", "long").add("ids", ArrayType(IntegerType()))
    return back(map_batches(docs.select(*others, F.col("text").cast("string").alias("text")), run, schema))


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """encoded with its ids turned to bytes as `decoded`, in place of a column of such a name in any case; null ids give no bytes."""
    encoded, back = plain_names(encoded, "ids", replaced=("decoded",))
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks or default_ranks()))
    others = [c for c in encoded.columns if c != "ids"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, out = vocabulary(shared.value), []
        for ids in batch.column("ids"):
            out.append(words.decode(np.asarray(ids.values if ids.is_valid else [], np.int64))[0].tobytes())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(out, pa.binary())], [*others, "decoded"])

    schema = StructType([encoded.schema[c] for c in others]).add("decoded", "binary")
    return back(map_batches(encoded.select(*others, "ids"), run, schema))


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, its ids decoded again, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks or default_ranks()))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for i, j, data, offsets in chunks(batch.column("text"), CHUNK):
            ids, bounds = encode_chunk(words, data, offsets)
            plain, ends = words.decode(ids)
            written, plain, rows = memoryview(ids.astype("<u4").tobytes()), memoryview(plain.tobytes()), []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rows.append((int(b - a), hashlib.sha256(written[4 * a : 4 * b]).hexdigest(), hashlib.sha256(plain[ends[a] : ends[b]]).hexdigest()))
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_batches(texts, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
