"""Embedding near-dedup: all pairs of vectors at a cosine of THRESHOLD or more, by cover trees that are walked in pairs.

Vectors are scaled to length 1, so a cosine of 0.9 is a distance of TAU. Equal vectors are one set with its number of copies. The tree
has nested levels whose radii halve. Its top is a net over a bounded sample of the sets (SAMPLE of them at most, those with the least
hashes), broadcast to all tasks: every set, sampled or not, goes to the cell of its nearest centre. Cells are packed, or cut, into units
of about equal size; a task nets the sets of one unit at RADII, each level within the nodes of the one above.

Two units meet in one task, and a set is sent to another unit only if it is within TAU and the covering radius of one of its cells. There
both trees are walked together, level by level: a pair of nodes whose centres are farther apart than TAU and both covering radii goes,
one that is so close that all its pairs must be links is counted as a whole, and others are opened. A level where most pairs of nodes
stay prunes little, so it is passed over for the next one; each level is a product of matrices of centres. What no level decides is
compared set by set. All bounds are taken from the distances to actual members, so the pairs are exact; they are counted and united
as they are found and never kept, and each pair of units returns a count and a root for each set.

Vectors without any structure (all at right angles, nearly) cannot be pruned by any metric bound above the lowest levels: then a set meets
all units, in as many rows, and the work is that of all pairs of nodes.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different lengths are
not linked. Repeated rows each give a row and are linked, and so are vectors that differ by a positive factor. Null vec_ids are left out
when a least id is taken; a component of them alone has a null id and keeps none. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_observed, in_batches, join_hot, keyed, map_batches, spread
from .jaccard import components, group_starts, grouped, unite
from .textkit import buffers

THRESHOLD = 0.9
TAU = math.sqrt(2 - 2 * THRESHOLD)
#: What bounds are widened by: square roots of rounded products are this exact.
SLACK = 1e-7
RADII = (1.0, 0.5, 0.25)
#: Sets of a unit at most (about), sets of the sample for each unit, and in all; long vectors make both smaller, by bytes.
UNIT, OF_UNIT, SAMPLE = 8192, 8, 4096
BYTES = 1 << 24
#: A level is passed over if more than this share of its pairs would have to be opened.
DENSE = 0.03
#: Pairs that are compared at a time, and rows of a product of matrices.
AT_ONCE, STRIP = 1 << 19, 1024
#: Nodes of either side that tell whether a level is dense.
SOME = 256


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all usable vectors of a list column, scaled to length 1; their n + 1 offsets; and which rows are usable."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    ends = np.cumsum(n)
    full = np.flatnonzero(n)
    good = np.zeros(len(n), bool)
    if len(full):
        begins = (ends - n)[full]
        finite = np.logical_and.reduceat(np.isfinite(values), begins)
        most = np.maximum.reduceat(np.abs(np.where(np.isfinite(values), values, 0)), begins)
        good[full] = finite & (most > 0)
        most = np.where(good[full], most, 1)
        values = values / np.repeat(most, n[full])
        length = np.sqrt(np.add.reduceat(values * values, begins))
        values = values / np.repeat(np.where(good[full], length, 1), n[full])
    values = values[np.repeat(good, n)] + 0.0  # no negative zeros
    return values, np.concatenate([[0], np.cumsum(np.where(good, n, 0))]), good


def _scaled(batch: pa.RecordBatch) -> pa.RecordBatch:
    values, at, good = units(batch.column("embedding"))
    vector = pa.Array.from_buffers(pa.binary(), len(good), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), pc.if_else(pa.array(good), vector, pa.scalar(None, pa.binary()))], ["vec_id", "vector"])


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    data, at = buffers(column)
    width, values = np.diff(at) // 8, np.frombuffer(data.tobytes(), np.float64)
    if len(width) and (width == width[0]).all():
        return values.reshape(len(width), -1)
    out = np.zeros((len(width), width.max(initial=1)))
    out[np.arange(out.shape[1]) < width[:, None]] = values
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """Rows, the first one among them, that are farther than radius from each other and within it of all rows."""
    close, chosen = 1 - radius * radius / 2, np.zeros(0, np.int64)
    for start in range(0, len(x), 512):
        part = x[start : start + 512]
        left = np.flatnonzero((part @ x[chosen].T).max(axis=1, initial=-2) < close)
        near, more, free = part[left] @ part[left].T >= close, [], np.ones(len(left), bool)
        for k in range(len(left)):
            if free[k]:
                more.append(start + left[k])
                free &= ~near[k]
        chosen = np.concatenate([chosen, np.array(more, np.int64)])
    return chosen


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest of the centres, and its distance."""
    of, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for start in range(0, len(x), STRIP):
        dots = x[start : start + STRIP] @ centres.T
        of[start : start + STRIP] = dots.argmax(axis=1)
        far[start : start + STRIP] = distance(dots.max(axis=1))
    return of, far


def levels(x: np.ndarray) -> np.ndarray:
    """The tree of a unit: for each row its centre (a row) at each of RADII; a centre is one at all lower levels too."""
    out, nodes = np.zeros((len(x), len(RADII)), np.int64), [np.arange(len(x))]
    for k, radius in enumerate(RADII):
        below = []
        for rows in nodes:
            if len(rows) == 1:
                out[rows, k:] = rows[0]
                continue
            places = net(x[rows], radius)
            of = nearest(x[rows], x[rows[places]])[0] if len(places) > 1 else np.zeros(len(rows), np.int64)
            of[places] = np.arange(len(places))  # equal distances do not part a centre from itself
            out[rows, k] = rows[places][of]
            order = np.lexsort((out[rows, k] != rows, of))  # centres first
            below += np.split(rows[order], np.flatnonzero(np.diff(of[order])) + 1)
        nodes = below
    return out


def _evenly(n: int, some: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, some)).astype(np.int64))


class Side:
    """A unit's tree over the rows that a task has of it: rows in order of their paths, and the nodes of each level as runs of rows."""

    def __init__(self, x: np.ndarray, paths: np.ndarray, copies: np.ndarray):
        self.x, self.copies, self.starts, self.centres, self.radii = x, copies, [], [], []
        fresh = np.zeros(len(x), bool)
        fresh[:1] = True
        for k in range(paths.shape[1]):
            fresh[1:] |= paths[1:, k] != paths[:-1, k]
            self._level(np.flatnonzero(fresh))
        self._level(np.arange(len(x)))

    def _level(self, starts: np.ndarray) -> None:
        """The first row that is there stands for a node's centre; the radius is that of the rows that are there."""
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(self.x))))
        far = distance(np.einsum("ij,ij->i", self.x, self.x[starts][of])) if len(starts) < len(self.x) else np.zeros(len(self.x))
        self.starts.append(np.append(starts, len(self.x)))
        self.centres.append(self.x[starts])
        self.radii.append(np.where(np.diff(self.starts[-1]) > 1, np.maximum.reduceat(far, starts), 0.0) if len(starts) else far)

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First node of the next level, and number of them, of each node."""
        at = np.searchsorted(self.starts[level + 1], self.starts[level])
        return at[:-1], np.diff(at)


class Walk:
    """The dual traversal of two trees, or of one with itself: counts of links (copies included) and roots over the rows of both."""

    def __init__(self, left: Side, right: Side | None):
        self.left, self.right, self.alone = left, right or left, right is None
        self.shift = 0 if self.alone else len(left.x)
        self.copies = left.copies if self.alone else np.concatenate([left.copies, right.copies])
        self.links, self.root = np.zeros(len(self.copies), np.int64), np.arange(len(self.copies))
        self.compared = 0
        if len(self.left.x) and len(self.right.x):
            self._walk()

    def _walk(self) -> None:
        last = len(RADII)
        for level in range(last + 1):
            found = self._whole(level, level == last)
            if found is not None:
                break
        for p, q in found:
            at, todo = level, [(p, q)]
            while at < last and todo:
                todo = [kept for pair in todo for chunk in self._opened(at, *pair) if len((kept := self._decided(at + 1, *chunk))[0])]
                at += 1
            # the lowest level's nodes are rows: all pairs are decided

    def _dense(self, level: int) -> bool:
        """Whether many pairs of nodes of a level would have to be opened, by some of them."""
        (c, r), (d, t) = ((side.centres[level][at], side.radii[level][at]) for side in (self.left, self.right) for at in [_evenly(len(side.centres[level]), SOME)])
        far, reach = distance(c @ d.T), r[:, None] + t[None, :]
        return np.mean((far <= reach + TAU + SLACK) & (far + reach > TAU - SLACK)) > DENSE

    def _whole(self, level: int, must: bool) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Pairs of nodes of a level that stay undecided, or None if too many would.

        Nodes are taken in order of their radii, so that one bound holds for a whole product and only what passes it is looked at.
        """
        if not must and self._dense(level):
            return None
        (a, r), (b, t) = ((side.centres[level], side.radii[level]) for side in (self.left, self.right))
        first, second, found = np.argsort(-r, kind="stable"), np.argsort(-t, kind="stable"), []
        for i in range(0, len(first), STRIP):
            strip, parts = a[first[i : i + STRIP]], []
            for j in range(i if self.alone else 0, len(second), 4 * STRIP):
                reach = r[first[i]] + t[second[j]] + TAU + SLACK
                dots = strip @ b[second[j : j + 4 * STRIP]].T
                self.compared += dots.size
                p, q = np.nonzero(dots >= 1 - reach * reach / 2)
                if self.alone:
                    p, q = p[p + i <= q + j], q[p + i <= q + j]
                far = distance(dots[p, q])
                p, q = first[p + i], second[q + j]
                near = far <= r[p] + t[q] + TAU + SLACK
                parts.append((p[near], q[near]))
            p, q = (np.concatenate(x) for x in zip(*parts, strict=True))
            if self.alone:
                p, q = np.minimum(p, q), np.maximum(p, q)
            for k in range(0, len(p), AT_ONCE):
                kept = self._decided(level, p[k : k + AT_ONCE], q[k : k + AT_ONCE])
                if len(kept[0]):
                    found.append(kept)
        return found

    def _opened(self, level: int, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of children, about AT_ONCE at a time, one pair of nodes at least."""
        (pa_, pn), (qa, qn) = self.left.children(level), self.right.children(level)
        many = pn[p] * qn[q]
        total, at = np.cumsum(many), 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            n = many[at:to]
            of = np.repeat(np.arange(at, to), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            x, y = pa_[p[of]] + k // qn[q[of]], qa[q[of]] + k % qn[q[of]]
            if self.alone:
                x, y = x[x <= y], y[x <= y]
            for i in range(0, len(x), AT_ONCE):
                yield x[i : i + AT_ONCE], y[i : i + AT_ONCE]
            at = to

    def _decided(self, level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes what can be decided; the pairs that are left."""
        a, b = self.left, self.right
        dots = np.empty(len(p))
        for i in range(0, len(p), 1 << 16):
            dots[i : i + (1 << 16)] = np.einsum("ij,ij->i", a.centres[level][p[i : i + (1 << 16)]], b.centres[level][q[i : i + (1 << 16)]])
        self.compared += len(p)
        same = (p == q) & self.alone
        if level == len(RADII):
            met = (dots >= THRESHOLD) & ~same
            self._link(level, p[met], q[met])
            return p[:0], q[:0]
        far, reach = distance(dots), a.radii[level][p] + b.radii[level][q]
        within = far + reach <= TAU - SLACK
        self._link(level, p[within], q[within])
        stay = (far <= reach + TAU + SLACK) & ~within
        return p[stay], q[stay]

    def _link(self, level: int, p: np.ndarray, q: np.ndarray) -> None:
        """Every row of p is linked with every row of q."""
        for mine, theirs, other, shift, back in ((p, q, self.right, 0, self.shift), (q, p, self.left, self.shift, 0)):
            own = self.left if other is self.right and shift == 0 else self.right
            ends = np.concatenate([[0], np.cumsum(other.copies)])
            many = (ends[other.starts[level][1:]] - ends[other.starts[level][:-1]])[theirs]
            n = np.diff(own.starts[level])[mine]
            rows = np.repeat(own.starts[level][mine] - np.cumsum(n) + n, n) + np.arange(n.sum()) + shift
            weight = np.repeat(many, n)
            if self.alone:
                self_pair = np.repeat(p == q, n)
                weight = np.where(self_pair, weight - self.copies[rows], weight)
                if shift == 0 and back == 0 and mine is q:
                    weight = np.where(self_pair, 0, weight)  # counted already
            np.add.at(self.links, rows, weight)
            unite(self.root, rows, np.repeat(other.starts[level][theirs] + back, n))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["dims", "i", "j"]
    for run in grouped(batches, keys):
        starts = group_starts(run, keys)
        i, j, unit, ids, copies = (run.column(c).to_numpy() for c in ("i", "j", "unit", "set_id", "copies"))
        paths = np.column_stack([run.column(f"l{k}").to_numpy() for k in range(len(RADII))])
        for a, b in zip(starts, np.append(starts[1:], run.num_rows), strict=True):
            x = matrix(run.column("vector").slice(a, b - a))
            m = a + int(np.searchsorted(unit[a:b], i[a], "right"))
            side = lambda s, t: Side(x[s - a : t - a], paths[s:t], copies[s:t])  # noqa: B023, E731
            walk = Walk(side(a, b), None) if i[a] == j[a] else Walk(side(a, m), side(m, b))
            some = np.flatnonzero(walk.links)
            columns = (ids[a:b][some], walk.links[some], ids[a:b][walk.root[some]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["set_id", "links", "root"])


def _pack(centres: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first unit of each cell and its number of units: cells of over `size` sets are cut, small neighbours share a unit."""
    order = np.lexsort((np.arange(len(centres)), nearest(centres, centres[net(centres, RADII[0] * 1.25)])[0]))
    first, many, at, room = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), -1, 0
    for c in order:
        if counts[c] > room or at < 0:
            many[c] = max(1, -(-counts[c] // size))
            first[c], at = at + 1, at + many[c]
            room = many[c] * size - counts[c] if many[c] == 1 else 0
        else:
            first[c], room = at, room - counts[c]
    return first, many


def linked(sets: DataFrame, n: int, width: int, unit: int = UNIT) -> DataFrame:
    """(set_id, links, root): for sets with links, how many rows each is linked with and a set that links join it with, in parts.

    sets: set_id, mark, copies, vector, of which there are n, with vectors of `width` bytes at most.
    """
    most = max(64, BYTES // max(width, 1))
    unit = min(unit, most)
    wanted = max(1, min(max(-(-n // unit), math.ceil(math.sqrt(2 * spread(sets)))), n // 64))
    sample = sets.orderBy("mark", "set_id").limit(min(SAMPLE, most, OF_UNIT * wanted)).select("vector").toArrow()  # bounded
    points = matrix(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((1, 1))
    chosen, radius = np.zeros(1, np.int64), 2.0
    while len(chosen) < wanted and radius > TAU:  # nested levels, as each net begins with the one before
        radius /= 2
        first = np.concatenate([chosen, np.setdiff1d(np.arange(len(points)), chosen)])
        chosen = first[net(points[first], radius)]
    centres = points[chosen]

    def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = matrix(column)
        width = max(x.shape[1], centres.shape[1])
        x, c = _wide(x, width), _wide(centres, width)
        return x, c, nearest(x, c)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, far = cells(batch.column("vector"))[2]
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(far)], ["cell", "far"])

    sizes = map_batches(sets.select("vector"), assign, "cell long, far double").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    counts, reach = np.zeros(len(centres), np.int64), np.full(len(centres), -4.0)  # nothing is near a cell without members
    for r in sizes.collect():  # SAMPLE rows at most
        counts[r["cell"]], reach[r["cell"]] = r["n"], r["far"]
    begin, many = _pack(centres, counts, max(1, -(-n // wanted)))
    total = int((begin + many).max())

    def home(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = cells(batch.column("vector"))[2][0]
        ids = batch.column("set_id").to_numpy()
        own = begin[of] + (ids * 0x9E3779B1 >> 16) % many[of]
        names = ["dims", "unit", "set_id", "copies", "vector"]
        return pa.RecordBatch.from_arrays([batch.column("dims"), pa.array(own), *(batch.column(c) for c in names[2:])], names)

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tree of each unit, and each of its sets once for every unit that it may have a link in."""
        for run in grouped(batches, ["dims", "unit"]):
            starts = group_starts(run, ["dims", "unit"])
            for a, b in zip(starts, np.append(starts[1:], run.num_rows), strict=True):
                rows = run.slice(a, b - a)
                x, c, _ = cells(rows.column("vector"))
                own, paths = rows.column("unit").to_numpy(), levels(x)
                for s in range(0, b - a, STRIP):
                    near = distance(x[s : s + STRIP] @ c.T) <= reach + TAU + SLACK
                    there = np.zeros((len(near), total + 1), np.int64)  # +1 where a reachable cell begins, -1 behind its units
                    row, cell = np.nonzero(near)
                    np.add.at(there, (row, begin[cell]), 1)
                    np.add.at(there, (row, begin[cell] + many[cell]), -1)
                    row, to = np.nonzero(np.cumsum(there, axis=1)[:, :total] > 0)
                    for k in range(0, len(row), 4 * STRIP):
                        at, other = row[k : k + 4 * STRIP] + s, to[k : k + 4 * STRIP]
                        taken = rows.take(pa.array(at))
                        columns = [np.minimum(own[at], other), np.maximum(own[at], other), *(paths[at, lv] for lv in range(len(RADII)))]
                        yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, columns)], [*taken.schema.names, "i", "j", *(f"l{lv}" for lv in range(len(RADII)))])

    base = "dims int, unit long, set_id long, copies long, vector binary"
    housed = map_batches(sets.select((F.octet_length("vector") / 8).cast("int").alias("dims"), "set_id", "copies", "vector"), home, base)
    housed = in_batches(housed.repartition(spread(sets), "dims", "unit").sortWithinPartitions("dims", "unit", "set_id"))
    path = [f"l{k}" for k in range(len(RADII))]
    sent = housed.mapInArrow(planted, f"{base}, i long, j long, " + ", ".join(f"{c} long" for c in path))
    met = in_batches(sent.repartition(spread(sets), "dims", "i", "j").sortWithinPartitions("dims", "i", "j", "unit", *path))
    return met.mapInArrow(_walked, "set_id long, links long, root long")


def near_dedup(embeddings: DataFrame, unit: int = UNIT) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = map_batches(rows, _scaled, "vec_id long, vector binary").withColumns({"mark": F.xxhash64("vector"), "mark2": F.xxhash64(F.lit("second"), "vector"), "row": F.monotonically_increasing_id()})
    rows, widest = cut_observed(rows, bytes=F.max(F.octet_length("vector")))
    good = rows.where("vector IS NOT NULL")
    alike = good.groupBy("mark", "mark2").agg(F.min("row").alias("set_id"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    alike, seen = cut_observed(alike, n=F.count("*"))
    sets = cut(alike.join(good.select(F.col("row").alias("set_id"), "vector"), "set_id").select("set_id", "mark", "copies", "vector"))
    compared = cut(linked(sets, seen["n"], widest["bytes"], unit))
    links = compared.groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = components(compared.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    named = cut(joined.join(alike.select(F.col("set_id").alias("id"), "least"), "id"))
    tops = keyed(named.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("n")))
    of_set = join_hot(named, tops, "root").select(F.col("id").alias("set_id"), "top")
    of_set = alike.join(of_set, "set_id", "left").join(links, "set_id", "left")
    of_set = of_set.select(F.struct("mark", "mark2").alias("key"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "least").alias("component_id"))
    found = join_hot(good.select("vec_id", F.struct("mark", "mark2").alias("key")), keyed(of_set, "copies"), "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
