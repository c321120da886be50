"""Rules across files: prompts of one split that appear in another, exactly or nearly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import Settings
from ..findings import ERROR, findings, union
from ..functions.arrow import slices, starts_of, text_bytes, whole_groups
from ..functions.json_values import member, once, quoted, rounded, text_of, trim
from ..functions.signing import signatures
from ..functions.text import HASHES, bands
from . import messages

#: Signatures of a block of a bucket, and how many of them are compared at a time with as many others.
BLOCK, STRIP = 2048, 128
#: Bytes by which passages without an inner word are looked up.
GRAM = 3


def prompts(docs: DataFrame, field: str) -> DataFrame:
    """(path, path_ord, row, prompt) of records whose field is a string that is not blank, trimmed."""
    said = once(docs.where("tag = 'object'"), said=text_of(member("doc", field)))
    found = once(said, prompt=trim(F.col("said")))
    keep = [c for c in ("dataset", "path", "path_ord", "row") if c in docs.columns]
    return found.where("prompt <> ''").select(*keep, "prompt")


def first_rows(found: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """The first place of each key, in order of files and rows, and more of it; places are combined before they are exchanged."""
    place = F.min(F.struct("path_ord", "path", "row")).alias("place")
    return found.groupBy(*by).agg(place, *more)


def exact_hits(found: DataFrame) -> DataFrame:
    """Rows of found (see overlaps) with each set before their own that has an equal prompt: `other`, and its first `place` there."""
    other = first_rows(found, ["prompt", "d"]).withColumnRenamed("d", "other")
    return found.join(other, "prompt").where("other < d")


def signed_rows(found: DataFrame) -> DataFrame:
    """found (see overlaps) with a `key` for its prompt, `signature` (null: no shingle) and its name `sign` in place of the prompt.

    Rows are dealt evenly before they are signed, copies too, which takes longer than moving them. They are exchanged once more
    without texts; what reads them through `only` has that exchange in common, so that Spark reads and signs every prompt once.
    """
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in found.columns if c != "prompt"]
    keyed = found.select(F.struct(*kept, F.unhex(F.sha2("prompt", 256)).alias("key")).alias("id"), "prompt").repartition(tasks, "id")
    signed = signatures(keyed, text_column="prompt", every=True).select("id.*", F.col("signature").cast("array<int>").alias("signature"))
    return signed.withColumn("sign", F.md5(F.array_join("signature", ","))).repartition(tasks, "path", "row")


def only(rows: DataFrame, *names: str) -> DataFrame:
    """Some columns of rows, chosen in tasks: Spark does not choose them below the exchange that rows come from, which stays the same for all that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(names)

    return rows.mapInArrow(run, StructType([rows.schema[n] for n in names]))


def near_hits(rows: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(key, other, place, similarity): of prompts, each set that lacks them, but has one at least this similar, before some set that has them.

    rows: as signed_rows has them; held: the first places of each key and set, and its `sign`. `place` is the first place there of the
    most similar prompt, `similarity` how similar. Ties go to the earliest band, then place. However many sets there are, all
    meet in one join of bands. Prompts of one signature go by that signature.
    """
    # the sets that have a prompt, in order; a set asks if some set before it has not: its place in the list is less than its number
    sets = only(held, "key", "d", "sign").where("sign IS NOT NULL").groupBy("key").agg(F.first("sign").alias("sign"), F.sort_array(F.collect_set("d")).alias("ds"))
    sets = sets.withColumn("asks", F.array_max(F.transform("ds", lambda d, i: F.when(d > i, d))))
    places = only(held, "sign", "d", "place").where("sign IS NOT NULL").groupBy("sign", "d").agg(F.min("place").alias("place"))
    marks = only(rows, "sign", "signature").where("sign IS NOT NULL").groupBy("sign").agg(F.first("signature").alias("signature"))
    signs = marks.join(sets.groupBy("sign").agg(F.max("asks").alias("asks"), F.min(F.col("ds")[0]).alias("least")), "sign")
    best = best_in_buckets(signs, places, threshold)
    asking = sets.where("asks IS NOT NULL").select("key", "sign", "ds")
    return asking.join(best, "sign").where("NOT array_contains(ds, other)").select("key", "other", "place", "similarity")


#: Pairs of blocks: band, bucket, and the numbers of a block of signatures that ask and of one that are asked.
PAIR = ["band", "bucket", "i", "j"]


def in_blocks(signs: DataFrame, places: DataFrame) -> DataFrame:
    """The signatures of all buckets in which someone asks a set that someone there is in, dealt and sorted by PAIR.

    signs: sign, signature, asks (it asks sets before this one; null: none), least (the first set that has it); places: sign, d, place.
    A bucket is cut into blocks of about BLOCK signatures that ask and that are asked, and a signature goes to each pair that its
    block is in. So a task gets some pairs of blocks, whatever the size of a bucket.
    """
    cut = bands(signs.select(F.struct("sign", "asks", "least").alias("id"), "signature")).select("id.*", "band", "bucket")
    sizes = cut.groupBy("band", "bucket").agg(F.max("asks").alias("last"), F.min("least").alias("first"), F.count("asks").alias("asking"), F.count("*").alias("all"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = sizes.where("first < last").select("band", "bucket", "first", "last", blocks("asking").alias("m"), blocks("all").alias("n"))
    met = cut.join(sizes, ["band", "bucket"]).withColumn("own", F.xxhash64("sign"))
    # of a signature that asks, its own block with all that are asked; of one that is asked, all that ask with its own block
    to = lambda n, asking, i, j: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda x: F.struct(F.lit(asking).alias("asking"), i(x).alias("i"), j(x).alias("j")))
    mine = lambda n: F.pmod("own", n).cast("int")
    none = F.array().cast("array<struct<asking:boolean,i:int,j:int>>")
    asking = F.when(F.col("asks") > F.col("first"), to("n", True, lambda x: mine("m"), lambda x: x)).otherwise(none)
    asked = F.when(F.col("least") < F.col("last"), to("m", False, lambda x: x, lambda x: mine("n"))).otherwise(none)
    dealt = met.select("band", "bucket", "sign", "asks", "last", F.explode(F.concat(asking, asked)).alias("to")).select("*", "to.*")
    # every signature with its first place in each set that has it
    held = places.groupBy("sign").agg(F.collect_list(F.struct("d", F.col("place").cast("struct<path_ord:int,path:string,row:bigint>").alias("place"))).alias("held"))
    known = signs.select("sign", F.col("signature").cast("array<int>").alias("signature")).join(held, "sign", "left")
    nowhere = F.array(F.struct(F.col("asks").alias("d"), F.lit(None).cast("struct<path_ord:int,path:string,row:bigint>").alias("place")))
    rows = dealt.join(known, "sign").withColumn("at", F.explode(F.when(F.col("asking"), nowhere).otherwise(F.filter("held", lambda x: x.d < F.col("last")))))
    tasks = int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that pairs which are small but long to compare are not put together
    return rows.select(*PAIR, "sign", "asking", "at.d", "at.place.*", "signature").repartition(tasks, *PAIR).sortWithinPartitions(*PAIR)


def best_in_buckets(signs: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(sign, other, place, similarity): for each signature, and each set that it asks, the most similar one there that shares a bucket.

    A pair of blocks returns a row for each signature that asks and each set, not its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, PAIR):
            yield from _best(whole, PAIR, threshold)

    best = in_blocks(signs, places).mapInArrow(run, "sign string, other int, unlike double, band int, path_ord int, path string, row long")
    best = best.groupBy("sign", "other").agg(F.min(F.struct("unlike", "band", F.struct("path_ord", "path", "row").alias("place"))).alias("best"))
    return best.select("sign", "other", "best.place", (-F.col("best.unlike")).alias("similarity"))


def _best(rows: pa.RecordBatch, key: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each group of rows: of each signature that asks and each set before it, the most similar one; ties go to the first place."""
    starts = np.append(starts_of(rows, key), rows.num_rows)
    asking, d = rows.column("asking").to_numpy(zero_copy_only=False), rows.column("d").to_numpy()
    marks = rows.column("signature").flatten().to_numpy().reshape(-1, HASHES)
    path = rows.column("path").fill_null("").dictionary_encode()
    rank = np.argsort(np.argsort(np.array(path.dictionary.to_pylist(), object)))[path.indices.to_numpy()]
    order = np.lexsort((rows.column("row").fill_null(0).to_numpy(), rank, rows.column("path_ord").fill_null(0).to_numpy(), d))
    group = np.searchsorted(starts, np.arange(rows.num_rows), "right") - 1
    order = order[np.argsort(group[order], kind="stable")]  # by group, set and place
    found = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = order[a:b]
        asks, held = own[asking[own]], own[~asking[own]]
        if not len(asks) or not len(held):
            continue
        edges = np.append(np.flatnonzero(np.diff(d[held], prepend=-1)), len(held))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            other, theirs = d[held[lo]], marks[held[lo:hi]]
            for k in range(0, len(asks), STRIP):
                mine = asks[k : k + STRIP][d[asks[k : k + STRIP]] > other]
                best, at = np.full(len(mine), -1.0), np.zeros(len(mine), np.int64)
                for m in range(0, hi - lo, STRIP):
                    like = (marks[mine][:, None, :] == theirs[None, m : m + STRIP]).sum(axis=2) / HASHES
                    top = like.argmax(axis=1)
                    more = like[np.arange(len(mine)), top] > best
                    best[more], at[more] = like[np.arange(len(mine)), top][more], top[more] + m
                near = best >= threshold
                found.append((mine[near], held[lo:hi][at[near]], -best[near]))
    if found:
        mine, theirs, unlike = (np.concatenate(x) for x in zip(*found, strict=True))
        taken = rows.take(pa.array(theirs))
        columns = [rows.column("sign").take(pa.array(mine)), taken.column("d"), pa.array(unlike), *(taken.column(c) for c in ("band", "path_ord", "path", "row"))]
        yield pa.RecordBatch.from_arrays(columns, ["sign", "other", "unlike", "band", "path_ord", "path", "row"])


def overlaps(found: DataFrame, threshold: float) -> DataFrame:
    """found: prompts with a set number `d`. Its rows, without the prompt, with each set before their own that has it, or one like it.

    Exact hits have no similarity; near ones are those of prompts that the other set lacks, if the threshold is above 0.
    """
    found, none = found.withColumn("d", F.col("d").cast("int")), F.lit(None).cast("double")
    if threshold <= 0:
        return exact_hits(found).drop("prompt").withColumn("similarity", none)
    rows = signed_rows(found)
    held = first_rows(only(rows, "key", "sign", "d", "path_ord", "path", "row"), ["key", "d"], F.first("sign").alias("sign"))
    exact = only(held, "key", "d", "place").select("key", F.col("d").alias("other"), "place", none.alias("similarity"))
    hits = exact.unionByName(near_hits(rows, held, threshold))
    return only(rows, "key", *(c for c in found.columns if c != "prompt")).join(hits, "key").where("other < d").drop("key")


def train_eval_overlap(train: DataFrame, evaluation: DataFrame, settings: Settings) -> DataFrame:
    field, threshold = settings.text("prompt_field", "prompt"), settings.number("near_dup_threshold", 0.0)
    side = lambda docs, d: prompts(docs, field).withColumn("d", F.lit(d))
    hits = overlaps(side(train, 0).unionByName(side(evaluation, 1)), threshold)
    exact = F.format_string(messages.EXACT_OVERLAP, "place.path", "place.row")
    near = F.format_string(messages.NEAR_OVERLAP, rounded(F.col("similarity"), 2), "place.path", "place.row")
    return findings(hits, "train-eval-overlap", ERROR, F.when(F.col("similarity").isNull(), exact).otherwise(near), row=F.col("row"))


def cross_dataset_overlap(datasets: DataFrame, names: list[str], settings: Settings) -> DataFrame:
    """Each pair of datasets a < b by name: rows of the later (or, by setting, the earlier) whose prompt the other has.

    All pairs are one join on the prompt, and one more on bands of signatures for near overlaps.
    """
    field, threshold = settings.text("prompt_field", "prompt"), settings.number("near_dup_threshold", 0.0)
    order = sorted(set(names), reverse=settings.text("anchor", "later") == "earlier")
    if not order:
        return union(datasets.sparkSession, [])
    listed = F.array(*map(F.lit, order))
    found = prompts(datasets, field).withColumn("d", F.array_position(listed, F.col("dataset")) - 1).where("d >= 0")
    hits = overlaps(found, threshold).withColumn("name", F.get(listed, F.col("other")))
    where = (quoted(F.col("name")), F.col("place.path"), F.col("place.row"), quoted(F.col("dataset")))
    near = F.format_string(messages.NEAR_CROSS_OVERLAP, rounded(F.col("similarity"), 2), *where)
    message = F.when(F.col("similarity").isNull(), F.format_string(messages.EXACT_CROSS_OVERLAP, *where)).otherwise(near)
    return findings(hits, "cross-dataset-overlap", ERROR, message, row=F.col("row"))


def contained(passages: DataFrame, texts: DataFrame, size: int = 8) -> DataFrame:
    """(item_id, doc_id) of passages that lie whole in a text: they meet by a run of words, then by containment.

    A passage is looked up by that of its inner runs that the fewest texts have, so runs that many texts share do not
    multiply pairs. Inner runs leave out the first and the last word, which may be part of a longer word in a text. Runs
    have `size` words; passages of fewer than size + 2 words go by single words. Passages of one or two words have no inner
    run; if there are any, they go by three bytes (or all of them, if they are shorter). An empty passage lies in every text.
    """
    words = lambda df, key: df.select(key, F.split("text", " ").alias("w"))
    asked, short = words(passages, "item_id").where(F.size("w") >= 3), passages.where(F.size(F.split("text", " ")) < 3)
    long, of_texts = F.size("w") >= size + 2, words(texts, "doc_id")
    parts = [_meet(_runs(asked.where(part), "item_id", n, 1), _runs(of_texts, "doc_id", n, 0)) for part, n in ((long, size), (~long, 1))]
    if not short.isEmpty():
        parts.append(_meet(_grams(short, "item_id", False), _grams(texts, "doc_id", True)))
    pairs = union(texts.sparkSession, parts)
    both = pairs.join(passages.select("item_id", F.col("text").alias("passage")), "item_id").join(texts.select("doc_id", "text"), "doc_id")
    return both.where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")


def _runs(df: DataFrame, key: str, size: int, skip: int) -> DataFrame:
    """(key, run): hashes of the runs of `size` words, without `skip` words at either end."""
    starts = F.sequence(F.lit(1 + skip), F.size("w") - size + 1 - skip)
    return df.where(F.size("w") >= size + 2 * skip).select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, size))))).alias("run"))


def _grams(df: DataFrame, key: str, shorter: bool) -> DataFrame:
    """(key, run): the different sequences of three bytes of each text; with `shorter` also those of two, one and none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                data, at = text_bytes(batch.column("text").slice(i, j - i))
                length, found = np.diff(at), []
                for n in range(GRAM + 1):
                    place = np.arange(max(0, len(data) - n + 1)) if n else at[:-1]
                    owner = np.searchsorted(at, place, "right") - 1 if n else np.arange(j - i)
                    whole = place + n <= at[owner + 1]
                    wanted = whole & (shorter | (n == np.minimum(length, GRAM)[owner]))
                    place, owner = place[wanted], owner[wanted]
                    code = np.full(len(place), n, np.int64)
                    for k in range(n):
                        code = code << 8 | data[place + k]
                    found.append(np.unique(np.column_stack([owner, code]), axis=0))
                rows = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, j - i).take(pa.array(rows[:, 0])), pa.array(rows[:, 1])], [key, "run"])

    asked = df.select(key, "text").where("text IS NOT NULL")
    return asked.mapInArrow(run, StructType([asked.schema[key], StructField("run", LongType())]))


def _meet(inner: DataFrame, runs: DataFrame) -> DataFrame:
    """(item_id, doc_id) that share the rarest run of a passage; inner: (item_id, run), runs: (doc_id, run)."""
    seen = runs.join(inner.select("run").distinct(), "run", "left_semi")
    often = seen.groupBy("run").agg(F.count("*").alias("n"))
    rarest = inner.join(often, "run").withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("n", "run"))).where("place = 1")
    return seen.join(rarest.select("item_id", "run"), "run").select("item_id", "doc_id").distinct()
