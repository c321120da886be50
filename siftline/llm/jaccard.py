"""N-gram Jaccard join: chosen paths over MinHash tokens find the pairs, exact sets of word shingles decide them.

A text's set holds its shingles of SHINGLE words (all its words, if they are fewer). Texts that are equal are one class
with one set. A set's MinHash tokens (coordinate, least hash) stand for it: two sets share a coordinate's token with
probability of their Jaccard similarity. A run splits all sets by the token of one coordinate, and now and then of a second
one. Each run has coordinates of its own for each level, so runs are independent; the sketch that decides has others. A bucket of over SMALL sets is split again, by coordinates that its path chooses, until it is small or LEVELS deep.
In a small bucket all sketches are compared by brute force, and sets whose sketches agree in LIKELY of the coordinates or
more are tied together. A large bucket of which DENSE or more are like its first set is one of near copies: it is tied as a
whole and not split, and so is a bucket that stays large, whose sets share all tokens of a path. Runs are repeated until a pair at the threshold is missed with a probability of 1 - RECALL at most.

Ties join sets into clusters, so a cluster holds every pair that any run has found. Within a cluster the exact sets of all
pairs are compared by brute force, in pairs of blocks of at most BLOCK sets, so that no task holds a whole cluster; each
block pair returns a count of links and a forest of them, not the pairs. The result is a row for each document: its class
(the least doc_id of the documents that links join, directly or not), the document that stands for its text (the least
doc_id with the same text) and how many different texts are linked with its text.

Edge cases: a null text is an empty one; texts without words have no shingles and link with nothing but are a class of
equal texts if they are equal. Null doc_ids are left out when a least doc_id is taken; a class of them alone has a null
class_id. Repeated rows each give a row, repeated doc_ids with different texts too: texts are told apart by two 64-bit hashes.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Keyed, cut, cut_observed, in_batches, join_few, join_hot, keyed, map_batches, maybe_in, plain_names, spread
from .textkit import U64, Words, buffers, chunks, mix, span_hash, windows

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999
#: Coordinates of a sketch, and the share of them that two sketches must agree in: for a similarity of 0.8, 64 coordinates
#: agree in less than 0.55 of them with a probability of 2e-6.
SKETCH, LIKELY = 64, 0.55
#: Chance of a second coordinate in a split: similar sets then keep 0.8 * 1.25 = 1 common bucket at each level on average.
SECOND = 0.25
SMALL, LEVELS = 128, 4
DENSE = 0.75
#: Edges that one task unites at most.
FEW = 1 << 18
#: Sets of a block, and shingles of a block, in the exact comparison.
BLOCK, BLOCK_SHINGLES = 128, 1 << 18


def _seeds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


_SEEDS = _seeds(SKETCH, 31)


def unlike(threshold: float = THRESHOLD) -> float:
    """Chance that the sketches of a pair at the threshold agree in less than LIKELY of the coordinates."""
    return sum(math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k) for k in range(math.ceil(LIKELY * SKETCH)))


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, second: float = SECOND, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has been tied with probability `recall`, if splits go `levels` deep.

    A pair that shares a bucket shares at least one below it with probability q = 1 - (1 - s)(1 - second + second (1 - s)).
    At the first level all sets have one path, so it is known whether a run has a second coordinate there.
    """
    met = 1 - (1 - threshold) * (1 - second * threshold)
    missed, runs = 1.0, 0
    allowed = 1 - recall - unlike(threshold)
    while missed > allowed:
        both = _coordinates(_root(runs, 1), runs, 0)[2][0]
        first = 1 - (1 - threshold) ** (2 if both else 1)
        missed, runs = missed * (1 - first * met ** (levels - 1)), runs + 1
    return runs


def shingles(data: np.ndarray, offsets: np.ndarray, different: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts by text, and n + 1 bounds of them. Different ones are sorted, others come as they stand."""
    words = Words(data, offsets)
    owner = words.owner()
    hashes = span_hash(data, words.starts, words.ends)
    keys, at = windows(hashes, owner, SHINGLE)
    of = owner[at]
    for size in range(1, SHINGLE):  # short texts are one shingle
        few = words.counts == size
        if few.any():
            more, where = windows(hashes, owner, size)
            pick = few[owner[where]]
            keys, of = np.concatenate([keys, more[pick] + U64(size)]), np.concatenate([of, owner[where][pick]])
    order = np.lexsort((keys, of)) if different else np.argsort(of, kind="stable")
    keys, of = keys[order], of[order]
    if different:
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        keys, of = keys[fresh], of[fresh]
    return keys, np.searchsorted(of, np.arange(len(offsets)))


def marked(docs: DataFrame) -> DataFrame:
    """docs with mark and mark2: two 64-bit hashes of the text, a null text as an empty one. They tell texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"mark": F.xxhash64(text), "mark2": F.xxhash64(F.lit("second"), text)})


def sketches(keys: np.ndarray, bounds: np.ndarray, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """MinHash coordinates of each set, 32 bits each; of an empty set all are 0."""
    out, full = np.zeros((len(bounds) - 1, len(seeds)), np.uint32), np.flatnonzero(np.diff(bounds))
    if len(full):
        for i, seed in enumerate(seeds):
            out[full, i] = (np.minimum.reduceat(keys * seed, bounds[full]) >> U64(32)).astype(np.uint32)
    return out


def _sketch(runs: int):
    """Of each text the sketch, the tokens of all runs for the first split (roots) and those for later ones (deep)."""
    seeds = np.concatenate([_SEEDS, _seeds(2 * LEVELS * runs, 32)])
    cuts = [SKETCH, SKETCH + 2 * runs]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for _, _, data, offsets in chunks(batch.column("text")):
            keys, bounds = shingles(data, offsets, different=False)
            parts.append((np.diff(bounds), sketches(keys, bounds, seeds)))
        n, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        columns = [pa.array(n), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in np.split(values, cuts, axis=1))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "mark", "mark2")), *columns], ["doc_id", "mark", "mark2", "n", "sketch", "roots", "deep"])

    return fn


def _root(run: int, n: int) -> np.ndarray:
    return np.full(n, mix(np.array([run + 1], U64))[0], U64)


def _coordinates(path: np.ndarray, run: int | np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token that each path chooses of its run's two for this level (counted from 0), the other one, and whether that one is used.

    Tokens of level 0 are counted among `roots`, those of other levels among `deep`.
    """
    drawn = mix(path + U64(0x51))
    base, one = 2 * ((LEVELS - 1) * run + level - 1 if level else run), (drawn & U64(1)).astype(int)
    return base + one, base + 1 - one, ((drawn >> U64(40)) & U64(0xFFFF)) < U64(int(SECOND * 0x10000))


def _split(tokens: np.ndarray, path: np.ndarray, run: int | np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the paths below `path` that each takes."""
    one, two, both = _coordinates(path, run, level)
    rows = np.arange(len(path))
    below = lambda c: mix((path * U64(0x9E3779B97F4A7C15)) ^ (tokens[rows, c].astype(U64) << U64(8)) ^ c.astype(U64))
    return np.concatenate([rows, rows[both]]), np.concatenate([below(one), below(two)[both]])


def _matrix(column: pa.Array, width: int = SKETCH) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _roots(runs: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, ids, paths, of = _matrix(batch.column("roots"), 2 * runs), [], [], []
        for run in range(runs):
            rows, path = _split(tokens, _root(run, len(tokens)), run, 0)
            ids.append(rows)
            paths.append(path)
            of.append(np.full(len(rows), run))
        columns = [pa.array(np.concatenate(paths).view(np.int64)), pa.array(np.concatenate(of), pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(np.concatenate(ids))), *columns], ["set_id", "path", "run"])

    return fn


def _deeper(runs: int, level: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        run = batch.column("run").to_numpy().astype(int)
        rows, path = _split(_matrix(batch.column("deep"), 2 * (LEVELS - 1) * runs), batch.column("path").to_numpy().view(U64), run, level)
        return pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(rows)), pa.array(path.view(np.int64)), pa.array(run[rows], pa.int32())], ["set_id", "path", "run"])

    return fn


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that lie in order of keys, as runs of whole groups: a group is never cut between two runs."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns, strict=True)], batch.schema.names)
        last = group_starts(batch, keys)[-1]
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held


def group_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def forest(links: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the first row that each row is joined with, directly or not."""
    n = len(links)
    near = links | np.eye(n, dtype=bool)
    root = np.arange(n)
    while True:
        least = np.where(near, root[None, :], n).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _compare_bucket(batches):
    for run in grouped(batches, ["path"]):
        starts, sketch, ids = group_starts(run, ["path"]), _matrix(run.column("sketch")), run.column("set_id").to_numpy()
        ends = np.append(starts[1:], run.num_rows)
        two = starts[ends - starts == 2]
        two = two[(sketch[two] == sketch[two + 1]).mean(axis=1) >= LIKELY]
        found = [np.column_stack([ids[two + 1], ids[two]])]
        for a, b in zip(starts, ends, strict=True):
            if b - a > 2:
                root = forest((sketch[a:b, None, :] == sketch[None, a:b, :]).mean(axis=2) >= LIKELY)
                tied = root != np.arange(b - a)
                found.append(np.column_stack([ids[a:b][tied], ids[a:b][root[tied]]]))
        pairs = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _alike(batch: pa.RecordBatch) -> pa.RecordBatch:
    like = (_matrix(batch.column("sketch")) == _matrix(batch.column("lead"))).mean(axis=1) >= LIKELY
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "run", "set_id", "least")), pa.array(like.astype(np.int32))], ["path", "run", "set_id", "least", "alike"])


def ties(sets: DataFrame, runs: int) -> DataFrame:
    """(a, b): ties between set_ids found by `runs` runs of chosen paths; sets: set_id, sketch, roots and deep of as many runs."""
    nodes, found = cut(map_batches(sets.select("set_id", "roots"), _roots(runs), "set_id long, path long, run int")), []
    held, tie = sets.select("set_id", "sketch", "deep"), (F.col("set_id").alias("a"), F.col("least").alias("b"))
    for level in range(1, LEVELS + 1):
        counts = keyed(nodes.groupBy("path").agg(F.count("*").alias("members"), F.min("set_id").alias("least")).where("members > 1"), "members")
        inside, seen = cut_observed(join_hot(nodes, counts, "path"), small=F.count_if(F.col("members") <= SMALL), large=F.count_if(F.col("members") > SMALL))
        small = join_few(held.select("set_id", "sketch"), inside.where(F.col("members") <= SMALL).select("path", "set_id"), "set_id", seen["small"])
        small = small.repartition(spread(sets), "path").sortWithinPartitions("path")
        found.append(cut(in_batches(small).mapInArrow(_compare_bucket, "a long, b long")))
        if counts.most <= SMALL:
            break
        large = inside.where(F.col("members") > SMALL)
        if level == LEVELS:
            found.append(large.where("set_id <> least").select(*tie))
            break
        lead = join_few(held.select(F.col("set_id").alias("least"), F.col("sketch").alias("lead")), counts.rows.where(F.col("members") > SMALL), "least", counts.keys)
        seen = join_hot(join_few(held.select("set_id", "sketch"), large.select("path", "run", "set_id"), "set_id", seen["large"]), keyed(lead, "members"), "path")
        seen = cut(map_batches(seen.select("path", "run", "set_id", "least", "sketch", "lead"), _alike, "path long, run int, set_id long, least long, alike int"))
        density = keyed(seen.groupBy("path").agg(F.count("*").alias("n"), (F.avg("alike") >= DENSE).alias("dense")))
        seen, split_on = cut_observed(join_hot(seen, density, "path"), rows=F.count_if(F.expr("NOT dense")))
        found.append(seen.where("dense AND set_id <> least").select(*tie))
        if not split_on["rows"]:
            break
        rest = seen.where("NOT dense")
        # only sets of buckets that are split go on, so later levels move few sketches
        few = split_on["rows"] <= HOT_KEYS
        held = cut(held.join(F.broadcast(rest.select("set_id")) if few else rest.select("set_id").distinct(), "set_id", "left_semi"))
        split = join_few(held.select("set_id", "deep"), rest.select("path", "run", "set_id"), "set_id", split_on["rows"])
        nodes = cut(map_batches(split.select("set_id", "path", "run", "deep"), _deeper(runs, level), "set_id long, path long, run int"))
    return reduce(DataFrame.unionByName, found)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the components of a and b, pair by pair, in place: root has the least member of each one's component."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.column_stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if found:
        ids, at = np.unique(np.concatenate(found), return_inverse=True)
        at, root = at.reshape(-1, 2), np.arange(len(ids))
        unite(root, at[:, 0], at[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for each id in edges (a, b) the least id that edges join it with, directly or not.

    Rounds of least neighbours: every id meets its least neighbour and hands its other neighbours to it. The edges shrink
    to stars, which they are when every id with a smaller neighbour has no other one. The edges of an id with very many of
    them stay spread out (join_hot). FEW edges or less are united in one task, in place of rounds of exchanges of next to nothing.
    """
    pairs, seen = cut_observed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), n=F.count("*"))
    if seen["n"] <= FEW:
        return in_batches(pairs.coalesce(1)).mapInArrow(_united, "id long, root long")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        rows, seen = cut_observed(least, total=F.sum("n"), most=F.max("n"), keys=F.count("*"), inner=F.max(F.when(F.col("m") < F.col("a"), F.col("n"))))
        if seen["inner"] <= 1:
            return rows.select(F.col("a").alias("id"), F.col("m").alias("root"))
        met = join_hot(both, Keyed(rows, "n", seen["total"], seen["most"], seen["keys"]), "a")
        handed = met.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(rows.select(F.col("a").alias("x"), F.col("m").alias("y")))
        pairs = cut(handed.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def _counts(one: list[np.ndarray], two: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of intersections between sorted sets of two lists (or of one with itself), by products of 0/1 matrices."""
    rows = one + (two or [])
    lengths = [len(r) for r in rows]
    _, token = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), lengths)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    many = np.bincount(token)
    shared = many[token] > 1  # a shingle of one set adds to no intersection
    token, owner = np.unique(token[shared], return_inverse=True)[1] if shared.any() else token[:0], owner[shared]
    out = np.zeros((len(one), len(two) if two else len(one)), np.int64)
    edges = np.searchsorted(token, np.arange(0, (token[-1] if len(token) else 0) + 4097, 4096))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            matrix = np.zeros((len(rows), 4096), np.float32)
            matrix[owner[a:b], token[a:b] % 4096] = 1
            out += (matrix[: len(one)] @ (matrix[len(one) :] if two else matrix).T).astype(np.int64)
    return out


def _exact(batches):
    """Links between the sets of each group (cluster, i, j): block i against itself, or blocks i and j."""
    keys = ["cluster", "i", "j"]
    for run in grouped(batches, keys):
        starts = group_starts(run, keys)
        ids, block, i, j = (run.column(c).to_numpy() for c in ("set_id", "block", "i", "j"))
        data, at = buffers(run.column("shingles"))
        found_a, found_n, found_root = [], [], []
        for a, b in zip(starts, np.append(starts[1:], run.num_rows), strict=True):
            own = [np.frombuffer(data[x:y].tobytes(), U64) for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
            sizes, names = np.array([len(s) for s in own]), ids[a:b]
            if i[a] == j[a]:
                shared = _counts(own, None)
                links = shared >= THRESHOLD * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
                np.fill_diagonal(links, False)
            else:
                left, right = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a])
                links = np.zeros((b - a, b - a), bool)
                if len(left) and len(right):
                    shared = _counts([own[k] for k in left], [own[k] for k in right])
                    met = shared >= THRESHOLD * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-9
                    links[np.ix_(left, right)], links[np.ix_(right, left)] = met, met.T
            some = links.any(axis=1)
            found_a.append(names[some])
            found_n.append(links[some].sum(axis=1))
            found_root.append(names[forest(links)[some]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (found_a, found_n, found_root)], ["set_id", "links", "root"])


def _with_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = []
    for _, _, data, offsets in chunks(batch.column("text")):
        keys, bounds = shingles(data, offsets)
        sets += [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    columns = [batch.column("set_id"), batch.column("cluster"), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["set_id", "cluster", "n", "shingles"])


def classes(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, mark2) of every document, and a row for each different text: mark, mark2, copies, text_id, n_links, first, alone.

    first: text_id, mark and mark2 of the text that stands for the class; alone: whether the class has one document only.
    """
    texts = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    runs = runs_for(recall)
    sketched = map_batches(texts, _sketch(runs), "doc_id long, mark long, mark2 long, n long, sketch binary, roots binary, deep binary")
    sketched = cut(sketched.withColumn("set_id", F.monotonically_increasing_id()))
    # one set for each different text: the row with the least doc_id stands for it
    row = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "set_id", "n")).alias("row")
    sets = sketched.groupBy("mark", "mark2").agg(row, F.count("*").alias("copies"))
    sets = cut(sets.select("mark", "mark2", F.col("row.doc_id").alias("text_id"), "row.set_id", "row.n", "copies"))
    tied = ties(sketched.join(sets.where("n > 0").select("set_id"), "set_id", "left_semi"), runs)
    clusters, seen = cut_observed(components(tied).select(F.col("id").alias("set_id"), F.col("root").alias("cluster")), n=F.count("*"))
    # the text of one document for each set that is in a cluster
    chosen = cut(join_few(sets, clusters, "set_id", seen["n"]).select("set_id", "cluster", "text_id", F.col("mark").alias("_mark"), F.col("mark2").alias("_mark2")))
    asked = maybe_in(texts, chosen.select(F.col("_mark").alias("mark")), "mark", "_asked").where("_asked")
    same = asked["doc_id"].eqNullSafe(chosen["text_id"]) & (asked["mark"] == chosen["_mark"]) & (asked["mark2"] == chosen["_mark2"])
    found = asked.join(chosen.hint("shuffle_hash"), same).select("set_id", "cluster", "text")
    members = cut(map_batches(found, _with_shingles, "set_id long, cluster long, n long, shingles binary").dropDuplicates(["set_id"]))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("many"), F.sum("n").alias("all"))
    blocks = F.ceil(F.greatest(F.col("many") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")
    placed = join_hot(members, keyed(sizes.select("cluster", "many", blocks.alias("blocks")), "many"), "cluster")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    # a set goes to each pair of blocks that its block is in
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.select("cluster", "set_id", "block", "shingles", other.alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "shingles")
    dealt = in_batches(dealt.repartition(spread(docs), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"))
    compared = cut(dealt.mapInArrow(_exact, "set_id long, links long, root long"))
    links = compared.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    joined = components(compared.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    order = F.struct(F.col("text_id").isNull().alias("none"), "text_id", "mark", "mark2")
    named = cut(joined.join(sets.select(F.col("set_id").alias("id"), order.alias("own")), "id"))
    roots = keyed(named.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("n")))
    of_set = join_hot(named, roots, "root").select(F.col("id").alias("set_id"), "first")
    of_set = sets.select("mark", "mark2", "set_id", "text_id", "copies").join(of_set, "set_id", "left").join(links, "set_id", "left")
    columns = (F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", order).alias("first"), (F.col("first").isNull() & (F.col("copies") == 1)).alias("alone"))
    return sketched.select("doc_id", "mark", "mark2"), of_set.select("mark", "mark2", "copies", "text_id", *columns)


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, text_id and n_links of every document."""
    rows, of_set = classes(docs, recall)
    key = F.struct("mark", "mark2").alias("key")
    return join_hot(rows.select("doc_id", key), keyed(of_set.select(key, "copies", "first", "text_id", "n_links"), "copies"), "key").select("doc_id", F.col("first.text_id").alias("class_id"), "text_id", "n_links")


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """docs, all columns, with one document of each class: the one with the least doc_id.

    Rows never leave Spark, and those that are surely alone in their class are not exchanged. Columns may have any names.
    """
    docs, back = plain_names(docs, "doc_id", "text")
    _, of_set = classes(docs, recall)
    of_set = cut(of_set.select("mark", "first", "alone"))
    own = marked(docs.select(F.col("doc_id").cast("long").alias("text_id"), "text", F.struct(*docs.columns).alias("_row")))
    rows = own.select("mark", F.struct("text_id", "mark", "mark2").alias("_own"), "_row")
    rows = maybe_in(rows, of_set.where("NOT alone"), "mark", "_met")
    # a row with the bit of a shared class by chance is alone: it is its class's first
    kept = of_set.select(F.struct("first.text_id", "first.mark", "first.mark2").alias("_kept"), "mark")
    kept = maybe_in(kept, of_set.where("NOT alone"), "mark", "_met").where("_met").select("_kept").distinct()
    met = rows.where("_met").join(kept.hint("shuffle_hash"), F.col("_own") == F.col("_kept"), "left_semi").dropDuplicates(["_own"])
    return back(rows.where("NOT _met").select("_row.*").unionByName(met.select("_row.*")))
