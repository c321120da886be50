"""Token counts that follow edits: a segment tree over each document's pre-tokens, re-encoding only what an edit touches.

keep_trees makes a table of documents with their trees, to be written and kept; edit_trees applies edits to rows of such a
table and gives rows of the same form, to be kept in turn, so edits can come at any later time. A tree is five arrays:
the sizes of its leaves, which are blocks of about BLOCK pre-tokens, the widths (code points) and numbers of tokens of the
pre-tokens, and the sums of both over the nodes. An edit (start, stop, replacement, in code points of the text as it then
is) goes down the sums to the pre-tokens it touches. Two pre-tokens before it may look at what it changes, so cutting
starts there; it goes on until a cut of the new text falls on one of the old text behind the edit, from where both agree.
Only the pre-tokens in between are encoded, and the sums from their blocks to the root are set anew. The total is that of
encoding the edited text as a whole. A block that has grown to over MOST pre-tokens makes the tree be laid out anew.

Edge cases: a null text is an empty one; positions beyond a text mean its end, and stop before start means start. Null
replacements are empty, null edits none. Edits of a document apply in the order given. Repeated rows each give a row and
null doc_ids are kept. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, Vocabulary, default_ranks, pretokens, read_ranks, vocabulary
from .common import map_batches
from .textkit import chunks

BLOCK, MOST = 16, 256
#: Pre-tokens before an edit whose ends may depend on what it changes.
CONTEXT = 2
EDITS = "array<struct<start:long,stop:long,text:string>>"


class Tree:
    """Segment tree over the pre-tokens of one text: their widths in code points and their numbers of tokens.

    Sizes of blocks, widths and tokens are arrays that stay as they are; only blocks that are looked at become lists.
    """

    def __init__(self, sizes: np.ndarray, widths: np.ndarray, tokens: np.ndarray, chars: np.ndarray, counts: np.ndarray):
        self.sizes, self.leaves, self.sums = sizes, (widths, tokens), [chars.tolist(), counts.tolist()]
        self.starts, self.size = np.cumsum(sizes) - sizes, len(chars) // 2
        self.seen: dict[int, tuple[list[int], list[int]]] = {}
        self.changed: set[int] = set()

    @classmethod
    def built(cls, widths: np.ndarray, tokens: np.ndarray) -> Tree:
        columns = layout(widths, tokens, np.array([0, len(widths)]))
        return cls(*(values for values, _ in columns))

    def block(self, b: int) -> tuple[list[int], list[int]]:
        if b not in self.seen:
            a, e = self.starts[b], self.starts[b] + self.sizes[b]
            self.seen[b] = tuple(side[a:e].tolist() for side in self.leaves)
        return self.seen[b]

    @property
    def pretokens(self) -> int:
        return int(self.sizes.sum()) + sum(len(self.seen[b][0]) - int(self.sizes[b]) for b in self.changed)

    def columns(self) -> list[np.ndarray]:
        """Sizes of the blocks, widths, tokens, and the nodes' sums of both."""
        sizes, parts, at = self.sizes.copy(), [[], []], 0
        for b in sorted(self.changed):
            sizes[b] = len(self.seen[b][0])
            for side in (0, 1):
                parts[side] += [self.leaves[side][at : self.starts[b]], np.array(self.seen[b][side], np.int64)]
            at = self.starts[b] + self.sizes[b]
        widths, tokens = (np.concatenate([*parts[side], self.leaves[side][at:]]) for side in (0, 1))
        if sizes.max() > MOST:
            return [values for values, _ in layout(widths, tokens, np.array([0, len(widths)]))]
        return [sizes, widths, tokens, *(np.array(x, np.int64) for x in self.sums)]

    @property
    def chars(self) -> int:
        return self.sums[0][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, place in the block and first code point of the pre-token that holds code point `at`; the last at the end."""
        node, start = 1, 0
        at = min(at, self.chars - 1)
        while node < self.size:
            node *= 2
            if at >= start + self.sums[0][node]:
                start += self.sums[0][node]
                node += 1
        block = node - self.size
        widths = self.block(block)[0]
        for place, width in enumerate(widths):
            if at < start + width:
                return block, place, start
            start += width
        return block, len(widths), start

    def back(self, block: int, place: int, start: int, steps: int) -> tuple[int, int, int]:
        """Some pre-tokens to the left, or the first."""
        while steps:
            if place:
                place -= 1
                start -= self.block(block)[0][place]
                steps -= 1
            elif block:
                block -= 1
                place = len(self.block(block)[0])
            else:
                break
        return block, place, start

    def ahead(self, block: int, place: int, start: int):
        """(block, place, start) of each pre-token from here on, and of the end."""
        for b in range(block, len(self.sizes)):
            widths = self.block(b)[0]
            for p in range(place if b == block else 0, len(widths)):
                yield b, p, start
                start += widths[p]
        yield len(self.sizes), 0, start

    def replace(self, block: int, place: int, until: tuple[int, int], widths: list[int], tokens: list[int]) -> None:
        """Puts pre-tokens in place of those from (block, place) up to `until`; they stay in the first block."""
        last, stop = until
        for side, new in enumerate((widths, tokens)):
            sums = self.sums[side]
            for b in range(block, min(last, len(self.sizes) - 1) + 1):
                values = self.block(b)[side]
                self.changed.add(b)
                left = values[:place] + new if b == block else []
                right = values[stop:] if b == last else []
                values[:] = left + right
                node = b + self.size
                sums[node] = sum(values)
                while node > 1:
                    node //= 2
                    sums[node] = sums[2 * node] + sums[2 * node + 1]


def region(tree: Tree, pattern: regex.Pattern, text: str, start: int, stop: int, replacement: str) -> tuple[str, tuple, list[str]]:
    """The text after an edit, where the new pre-tokens go, and those pre-tokens."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    edited = text[:start] + replacement + text[stop:]
    if not text:
        return edited, (0, 0, (0, 0)), pattern.findall(edited)
    block, place, first = tree.back(*tree.find(start), CONTEXT)
    old, grown = tree.ahead(block, place, first), len(edited) - len(text)
    b, p, at = next(old)
    new, end = [], first
    while True:
        while at < stop or at + grown < end:
            b, p, at = next(old)
        if at + grown == end and at >= stop:
            return edited, (block, place, (b, p)), new
        match = pattern.match(edited, end)
        new.append(match.group())
        end = match.end()


def layout(widths: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The columns of TREE for texts whose pre-tokens are at bounds[i]:bounds[i + 1]: values of all texts, and where each text's begin."""
    n = np.diff(bounds)
    many = np.maximum(1, -(-n // BLOCK))
    at = np.concatenate([[0], np.cumsum(many)])
    sizes = np.full(at[-1], BLOCK)
    sizes[at[1:] - 1] = n - BLOCK * (many - 1)
    ends = np.cumsum(sizes)
    leaves = np.array([1 << int(m - 1).bit_length() for m in many], np.int64)
    nodes = np.concatenate([[0], np.cumsum(2 * leaves)])
    out = [(sizes, at), (widths, bounds), (tokens, bounds)]
    for values in (widths, tokens):
        total = np.concatenate([[0], np.cumsum(values)])
        of_block, sums = total[ends] - total[ends - sizes], np.zeros(nodes[-1], np.int64)
        sums[np.repeat(nodes[:-1] + leaves - at[:-1], many) + np.arange(at[-1])] = of_block
        for size in np.unique(leaves):  # all texts with as many leaves together, level by level
            rows = nodes[:-1][leaves == size][:, None]
            while size > 1:
                size //= 2
                own = np.arange(size, 2 * size)
                sums[rows + own] = sums[rows + 2 * own] + sums[rows + 2 * own + 1]
        out.append((sums, nodes))
    return out


def count_tokens(words: Vocabulary, pieces: list[str], known: dict[str, int]) -> None:
    """Puts the numbers of tokens of pieces into known."""
    fresh = list(dict.fromkeys(p for p in pieces if p not in known))
    if fresh:
        raw = [p.encode() for p in fresh]
        ends = np.cumsum([len(r) for r in raw])
        _, counts = words.encode_pieces(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
        known.update(zip(fresh, counts.tolist(), strict=True))


TREE = "sizes array<int>, widths array<int>, tokens array<int>, node_chars array<long>, node_tokens array<long>"
KEPT = f"doc_id long, text string, {TREE}, n_chars long, n_tokens long, n_pretokens long"
EDITED = "tokens_before long, pretokens_before long, reencoded long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _lists(columns: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """The columns of TREE from values and bounds."""
    return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32() if k < 3 else pa.int64())) for k, (values, at) in enumerate(columns)]


def _kept(rows: pa.RecordBatch) -> list[Tree]:
    """The trees of rows of a table of them."""
    columns = [rows.column(c) for c in _names(TREE)]
    values, bounds = [c.values.to_numpy() for c in columns], [c.offsets.to_numpy() for c in columns]
    return [Tree(*(v[at[i] : at[i + 1]] for v, at in zip(values, bounds, strict=True))) for i in range(rows.num_rows)]


def _stored(trees: list[Tree]) -> list[pa.Array]:
    """The columns of TREE of trees that have been edited."""
    columns = zip(*(t.columns() for t in trees), strict=True)
    return _lists([(np.concatenate(c), np.concatenate([[0], np.cumsum([len(x) for x in c])])) for c in columns])


def keep_trees(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, text, the columns of TREE, n_chars, n_tokens and n_pretokens of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks or default_ranks()))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for i, j, data, offsets in chunks(batch.column("text"), CHUNK):
            rows = batch.slice(i, j - i)
            starts, bounds = pretokens(data, offsets)
            ends = np.append(starts[1:], len(data))
            _, counts = words.encode_pieces(data, starts, ends)
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            widths = lead[ends] - lead[starts] if len(starts) else counts
            totals = [lead[offsets[1:]] - lead[offsets[:-1]], np.diff(np.concatenate([[0], np.cumsum(counts)])[bounds]), np.diff(bounds)]
            columns = [*_lists(layout(widths, counts, bounds)), *(pa.array(x, pa.int64()) for x in totals)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), *columns], _names(KEPT))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(texts, run, KEPT)


def edit_trees(kept: DataFrame, ranks: str | None = None, texts: bool = True) -> DataFrame:
    """kept (with a column `edits`) after the edits, in the same form, and for each row tokens_before, pretokens_before and reencoded.

    reencoded: the pre-tokens that were encoded. Without `texts`, the texts and trees are left out and only the counts are returned.
    """
    import public_tokenizers

    shared = kept.sparkSession.sparkContext.broadcast(read_ranks(ranks or default_ranks()))
    cutting, names = public_tokenizers.PATTERN, _names(TREE)
    schema = f"{KEPT}, {EDITED}" if texts else f"doc_id long, n_chars long, n_tokens long, n_pretokens long, {EDITED}"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, pattern = vocabulary(shared.value), regex.compile(cutting)
        for i, j, *_ in chunks(batch.column("text"), CHUNK):
            rows = batch.slice(i, j - i)
            trees = _kept(rows)
            plain = rows.column("text").to_pylist()
            todo = [[e for e in x or [] if e is not None] for x in rows.column("edits").to_pylist()]
            touched = np.zeros(j - i, np.int64)
            known: dict[str, int] = {}
            for turn in range(max(map(len, todo), default=0)):  # the same edit of all texts together: their pieces are encoded at once
                found = {}
                for k, own in enumerate(todo):
                    if turn < len(own):
                        e = own[turn]
                        start = e["start"] or 0
                        plain[k], *found[k] = region(trees[k], pattern, plain[k], start, e["stop"] if e["stop"] is not None else start, e["text"] or "")
                count_tokens(words, [p for _, pieces in found.values() for p in pieces], known)
                for k, ((block, place, until), pieces) in found.items():
                    trees[k].replace(block, place, until, [len(p) for p in pieces], [known[p] for p in pieces])
                    touched[k] += len(pieces)
            own = [pa.array(plain, pa.string()), *_stored(trees)] if texts else []
            chars, tokens, many = (pa.array(x, pa.int64()) for x in ([t.chars for t in trees], [t.tokens for t in trees], [t.pretokens for t in trees]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *own, chars, tokens, many, rows.column("n_tokens"), rows.column("n_pretokens"), pa.array(touched)], _names(schema))

    return map_batches(kept.select("doc_id", "text", *names, "n_tokens", "n_pretokens", F.col("edits").cast(EDITS).alias("edits")), run, schema)


def three_edits(text: str = "text") -> Column:
    """An insertion after a third of the text, a replacement in the middle of what results, and a deletion near its end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    edit = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(new).alias("text"))
    third, half, end = F.floor(n / 3), F.floor(n / 2), F.floor(n * 9 / 10)
    return F.array(edit(third, third, " it's  edited"), edit(half, half + 12, "\n new words 123"), edit(end, end + 25, ""))
