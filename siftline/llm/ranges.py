"""Running sums, places and neighbours within groups of rows, where a group may take many partitions.

Rows are dealt by ranges of (group, order) and cut off, so both passes see the same partitions. The first pass returns one row
for each partition: its first and last group and the sums of the last one. The driver carries these on from partition to
partition (one row each), and the second pass starts with what its partition was handed. Only whole numbers are handled, so
memory is that of two batches, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, spread
from .textkit import U64

_WORD = 1 << 64


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2 ** 64."""
    out, square, left = np.ones(len(exponents), U64), base % _WORD, exponents.astype(U64)
    while left.any():
        out[(left & U64(1)).astype(bool)] *= U64(square)
        left, square = left >> U64(1), square * square % _WORD
    return out


class _Run:
    """What has been seen of the group at hand."""

    def __init__(self, sums: dict[str, int], behind: list[str]):
        self.bases, self.behind = sums, behind
        self.group, self.n, self.total, self.last = None, 0, dict.fromkeys(sums, 0), dict.fromkeys(behind)

    def over(self, group: np.ndarray, values: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """First rows of groups, places (from 0) and sums of a batch, which this run then has seen."""
        at = np.arange(len(group))
        fresh = np.ones(len(group), bool)
        fresh[1:], fresh[0] = group[1:] != group[:-1], self.group is None or group[0] != self.group
        begin = np.maximum.accumulate(np.where(fresh, at, -1))
        place = np.where(begin >= 0, at - begin, at + self.n)
        sums = {}
        for c, base in self.bases.items():
            total = np.cumsum(values[c].view(U64) * powers(base, place))
            sums[c] = total - np.where(begin > 0, total[np.maximum(begin - 1, 0)], U64(0)) + np.where(begin < 0, U64(self.total[c]), U64(0))
        self.group, self.n = int(group[-1]), int(place[-1]) + 1
        self.total = {c: int(s[-1]) for c, s in sums.items()}
        self.last = {c: int(values[c][-1]) for c in self.behind}
        return fresh, place, sums


def _values(batch: pa.RecordBatch, columns: list[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy() for c in columns}


def running(df: DataFrame, group: str, order: list[str | Column], columns: list[str], sums: dict[str, int] | None = None, ahead: list[str] | None = None, behind: list[str] | None = None) -> DataFrame:
    """group and columns of df (longs without nulls), and for each row, in an order within its group:

    place (from 0), last (whether it is the group's last row); sum_c, the sum of c up to this row, each c times base ** place,
    modulo 2 ** 64, for each c and base of sums; next_c and previous_c for each c of ahead and behind, null at the group's ends.
    """
    sums, ahead, behind = sums or {}, ahead or [], behind or []
    dealt = df.repartitionByRange(spread(df), group, *order).sortWithinPartitions(group, *order)
    dealt = in_batches(cut(dealt.select(F.spark_partition_id().cast("long").alias("_part"), group, *columns)))
    first = [f"first_{c}" for c in ahead]
    edge = ["_part", "head", "tail", "n", *(f"sum_{c}" for c in sums), *first, *(f"last_{c}" for c in behind)]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, head = _Run(sums, behind), None
        for batch in batches:
            if batch.num_rows:
                head = head or [batch.column(c)[0].as_py() for c in ("_part", group, *ahead)]
                run.over(batch.column(group).to_numpy(), _values(batch, columns))
        if head:
            signed = [int(np.array([run.total[c]], U64).view(np.int64)[0]) for c in sums]
            row = [head[0], head[1], run.group, run.n, *signed, *head[2:], *(run.last[c] for c in behind)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], edge)

    found = sorted(dealt.mapInArrow(edges, ", ".join(f"{c} long" for c in edge)).collect())  # one row for each partition
    handed, coming, held = {}, {}, None
    for k, row in enumerate(found):
        run = _Run(sums, behind)
        if held and held.group == row["head"]:
            run.group, run.n, run.total, run.last = held.group, held.n, held.total, held.last
        handed[row["_part"]] = run
        coming[row["_part"]] = {"head": found[k + 1]["head"], **{c: found[k + 1][f"first_{c}"] for c in ahead}} if k + 1 < len(found) else None
        held = _Run(sums, behind)
        held.group, held.n, held.last = row["tail"], row["n"], {c: row[f"last_{c}"] for c in behind}
        held.total = {c: row[f"sum_{c}"] % _WORD for c in sums}
        if row["head"] == row["tail"] and run.group is not None:
            held.n += run.n
            held.total = {c: (run.total[c] + pow(b, run.n, _WORD) * held.total[c]) % _WORD for c, b in sums.items()}

    names = [group, *columns, "place", "last", *(f"sum_{c}" for c in sums), *(f"next_{c}" for c in ahead), *(f"previous_{c}" for c in behind)]

    def work(batch: pa.RecordBatch, run: _Run, following: dict | None) -> pa.RecordBatch:
        keys, values = batch.column(group).to_numpy(), _values(batch, columns)
        before = dict(run.last)
        fresh, place, totals = run.over(keys, values)
        last = np.append(keys[1:] != keys[:-1], following is None or following["head"] != keys[-1])
        out = [batch.column(c) for c in (group, *columns)]
        out += [pa.array(place), pa.array(last), *(pa.array(s.view(np.int64)) for s in totals.values())]
        out += [pa.array(np.append(values[c][1:], 0 if last[-1] else following[c]), mask=last) for c in ahead]
        out += [pa.array(np.append(0 if fresh[0] else before[c], values[c][:-1]), mask=fresh) for c in behind]
        return pa.RecordBatch.from_arrays(out, names)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, run = None, None
        for batch in batches:
            if batch.num_rows:
                if held is None:
                    part = batch.column("_part")[0].as_py()
                    run = handed[part]
                else:
                    yield work(held, run, {"head": batch.column(group)[0].as_py(), **{c: batch.column(c)[0].as_py() for c in ahead}})
                held = batch
        if held is not None:
            yield work(held, run, coming[part])

    schema = ", ".join(f"{c} {'boolean' if c == 'last' else 'long'}" for c in names)
    return dealt.mapInArrow(run_all, schema)
