"""Spark helpers that the operators share: tables, lineage cuts, ranks over a distributed order, joins with hot keys, prefix folds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that come to Python at once, where the session does not say; Spark's own number would be up to gigabytes of long texts.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A key is hot if more rows have it than this, and than 1 / HOT_KEYS of all rows have; so HOT_KEYS of them are hot at most.
HOT_ROWS, HOT_KEYS = 4096, 50_000
#: Bits of a filter: so many for each key, and at least and at most so many as powers of two, which makes 32 MB.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 32, 20, 28
#: Items of an array that are folded together.
FOLD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named, a run on one machine gets a temporary one, a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As cut, for rows with texts: a compressed table in the shared folder, of which later steps read the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch that returns a batch, or yields several smaller ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return in_batches(df).mapInArrow(run, schema)


def in_batches(df: DataFrame) -> DataFrame:
    """df; its session hands BATCH_ROWS rows at once to Python from now on, unless it has a number of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def plain_names(df: DataFrame, *own: str, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but `own` named by their places, without those that a result replaces; and what gives a result their names back.

    Names may hold dots or back quotes, or differ in case only, as Spark's expressions and Arrow's functions do not take them.
    `replaced` are names in lower case, which count in any case.
    """
    inner = [c if c in own else f"_column{k}" for k, c in enumerate(df.columns)]
    names = dict(zip(inner, df.columns, strict=True))
    plain = df.toDF(*inner).select(*(k for k, c in names.items() if c.lower() not in replaced))
    return plain, lambda out: out.toDF(*(names.get(c, c) for c in out.columns))


def spread(df: DataFrame) -> int:
    """The number of partitions that a shuffle of this session has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """As cut, with measures that are taken on the way, so that they cost no job of their own. Without rows they are 0."""
    seen = Observation()
    kept = cut(df.observe(seen, *(F.coalesce(v, F.lit(0)).alias(k) for k, v in measures.items())))
    return kept, seen.get


@dataclass(frozen=True)
class Keyed:
    """A table with one row for each key and the number of rows elsewhere that have it as column `n`; their sum and maximum, and the number of keys."""

    rows: DataFrame
    n: str
    total: int
    most: int
    keys: int


def keyed(df: DataFrame, n: str = "n") -> Keyed:
    """df, cut, as the side of join_hot with one row for each key."""
    rows, seen = cut_observed(df, total=F.sum(n), most=F.max(n), keys=F.count("*"))
    return Keyed(rows, n, seen["total"], seen["most"], seen["keys"])


def join_hot(rows: DataFrame, by: Keyed, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a keyed table; how: inner, or left to keep rows whose key it lacks.

    A table of HOT_KEYS keys or less is broadcast whole, so no row is exchanged. Of a larger one, rows of hot keys stay where they are: the hot part of the keyed table is broadcast, HOT_KEYS rows at most. So no task
    gets more rows of one key than the greater of HOT_ROWS and 1 / HOT_KEYS of all. If there are hot keys, rows are read
    twice: cut them before.
    """
    if by.keys <= HOT_KEYS:
        return rows.join(F.broadcast(by.rows), key, how)
    most = max(HOT_ROWS, by.total // HOT_KEYS)
    if by.most <= most:
        return rows.join(by.rows, key, how)
    hot = F.broadcast(by.rows.where(F.col(by.n) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(by.rows.where(F.col(by.n) <= most), key, how)
    return rows.join(hot, key).unionByName(cold)


def join_few(rows: DataFrame, few: DataFrame, key: str, n: int) -> DataFrame:
    """rows joined with a table of n rows, which is broadcast if these are HOT_KEYS or less."""
    return rows.join(F.broadcast(few) if n <= HOT_KEYS else few, key)


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a boolean: false if the key (a 64-bit hash) is surely not among `key` of keys, true if it is or may be.

    A bitmap of the keys, of at most 2 ** FILTER_MOST bits, is broadcast, so rows that need no join need no exchange. With
    very many keys it fills up, and more rows are true; none that should be is false.
    """
    bits = min(max((keys.count() * FILTER_BITS).bit_length(), FILTER_LEAST), FILTER_MOST)
    at = lambda c: c.bitwiseAND((1 << bits) - 1)
    held = keys.select(at(F.col(key)).alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
    held = held.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    asked = rows.withColumn("_bit", at(F.col(key))).withColumn("_bucket", F.bitmap_bucket_number("_bit"))
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return asked.join(F.broadcast(held), "_bucket", "left").withColumn(flag, there).drop("_bit", "_bucket", "_map")


def before_each(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array: `merge` over zero and all items before it.

    Folded within blocks of FOLD items and over the blocks, so the work is near linear in the length.
    """

    def fold(items: Column, start: Column) -> Column:
        """start, and what becomes of it with each item."""
        seen = F.struct(start.alias("now"), F.array(start).alias("all"))

        def step(s: Column, x: Column) -> Column:
            now = merge(s["now"], x)
            return F.struct(now.alias("now"), F.concat(s["all"], F.array(now)).alias("all"))

        return F.aggregate(items, seen, step, lambda s: s["all"])

    def folded(items: Column) -> Column:
        last = F.greatest(F.ceil(F.size(items) / FOLD).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * FOLD + 1, FOLD))
        starts = F.slice(fold(F.transform(blocks, lambda b: F.aggregate(b, zero, merge)), zero), 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.slice(fold(b, s), 1, F.size(b))))

    return bound(values, folded)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def with_rank(df: DataFrame, group: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """df with the 1-based place of each row within its group under an order, as a long.

    No group meets in one task: rows are dealt by ranges of (group, order), so a group may take many partitions. A
    small table of rows per (partition, group) gives the number of rows in earlier partitions. The dealt rows are
    cut off in the checkpoint folder, so that both passes and any recomputation see the same partitions. Rows that
    are equal in group and order take neighbouring places. An empty df gives an empty result.
    """
    keys = [*group, *order]
    dealt = df.repartitionByRange(spread(df), *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    names = [f"_g{i}" for i in range(len(group))]
    parts = dealt.groupBy("_part", *(F.col(g).alias(n) for g, n in zip(group, names, strict=True))).agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first")
    )
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *names, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    match = dealt["_part"] == parts["_part"]
    for g, n in zip(group, names, strict=True):
        match &= dealt[g].eqNullSafe(parts[n])
    place = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long").alias(rank)
    return dealt.join(parts, match).select(*(dealt[c] for c in df.columns), place)
