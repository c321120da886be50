"""The lint run: files and splits in, one table of findings out.

All JSON rules read one parsed and persisted table of records, whatever the number of rules and files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..findings import ERROR, findings, union
from ..operators.schema_rules import profile
from ..sources.jsonl import ENDINGS, kind_of, read_jsonl
from ..sources.parquet_footers import read_row_groups
from ..sources.paths import resolve
from ..sources.python_calls import calls, read_sources
from .registry import rules
from .suppress import MARKER, in_records, in_sources, without_suppressed


@dataclass
class Splits:
    """Files of the training and evaluation split, and of named datasets."""

    train: list[str] = field(default_factory=list)
    evaluation: list[str] = field(default_factory=list)
    datasets: dict[str, list[str]] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [*self.train, *self.evaluation, *(p for ps in self.datasets.values() for p in ps)]


def _active(config: Config, kind: str) -> list:
    return [r for r in rules() if r.kind == kind and config.enabled(r.id)]


def _held(df: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    """df, persisted; `held` gets it, so that who reads the findings can release it afterwards."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held.append(df)
    return df


def release(held: list[DataFrame]) -> None:
    while held:
        held.pop().unpersist()


def lint_records(docs: DataFrame, config: Config = Config(), held: list[DataFrame] | None = None) -> DataFrame:
    """Findings of all JSON rules over records. Rules over fields share one small profile, which is persisted (see `held`)."""
    active = _active(config, "jsonl")
    seen = _held(profile(docs), held) if any(r.profiled for r in active) else None
    return union(docs.sparkSession, [r.check(docs, config.settings(r.id), *([seen] if r.profiled else [])) for r in active])


def _unread(paths: DataFrame, rule_id: str) -> DataFrame:
    return findings(paths, rule_id, ERROR, F.format_string("read error: %s: %s", "path", "error"))


def lint_calls(found: DataFrame, config: Config = Config()) -> DataFrame:
    return union(found.sparkSession, [r.check(found, config.settings(r.id)) for r in _active(config, "python")])


def lint_files(spark: SparkSession, paths: list[str], config: Config = Config(), given: dict[str, str] | None = None, marker: str = MARKER, held: list[DataFrame] | None = None) -> DataFrame:
    """Findings of all files, folders and patterns; folders are searched for files of every kind.

    A given path that matches nothing is a finding (of an unknown kind: of JSON lines), so a lint of nothing is not clean.
    held: gets the tables that are persisted for the findings; release() them when these have been read.
    """
    given, parts, rows, lines = given or {}, [], None, None
    there, lost = resolve(spark, [p for p in paths if p not in given])
    folders = {x.given for x in there if not x.file and kind_of(x.given) == "unknown"}
    kinds = {k: [p for p in dict.fromkeys(paths) if p not in lost and (kind_of(p) == k or p in folders)] for k in ENDINGS}
    if kinds["jsonl"]:
        docs = _held(read_jsonl(spark, kinds["jsonl"]), held)
        parts.append(lint_records(docs, config, held))
        rows = in_records(docs, marker)
    if lost and config.enabled("jsonl-malformed-line"):
        parts.append(_unread(spark.createDataFrame([(p, "no such file") for p in lost], "path string, error string"), "jsonl-malformed-line"))
    if kinds["python"]:
        sources = _held(read_sources(spark, kinds["python"], given), held)
        parts.append(lint_calls(_held(calls(sources), held), config))
        lines = in_sources(sources, marker)
    if kinds["parquet"] and _active(config, "parquet"):
        groups = read_row_groups(spark, kinds["parquet"])
        parts += [r.check(groups, config.settings(r.id)) for r in _active(config, "parquet")]
        parts.append(_unread(groups.where("error IS NOT NULL"), _active(config, "parquet")[0].id))
    return without_suppressed(union(spark, parts), rows, lines)


def lint_splits(spark: SparkSession, splits: Splits, config: Config = Config(), marker: str = MARKER, held: list[DataFrame] | None = None) -> DataFrame:
    """Findings of the rules across files; they are suppressed by the rows they point to. Each split is parsed once (see `held`)."""
    parts, found = [], []
    lost = resolve(spark, splits.paths())[1]
    if lost and config.enabled("jsonl-malformed-line"):
        parts.append(_unread(spark.createDataFrame([(p, "no such file") for p in lost], "path string, error string"), "jsonl-malformed-line"))
    active = {r.id: r for r in _active(config, "corpus")}
    if "train-eval-overlap" in active and splits.train and splits.evaluation:
        train, evaluation = (_held(read_jsonl(spark, p), held) for p in (splits.train, splits.evaluation))
        parts.append(active["train-eval-overlap"].check(train, evaluation, config.settings("train-eval-overlap")))
        found.append(in_records(evaluation, marker))
    if "cross-dataset-overlap" in active and len(splits.datasets) > 1:
        sets = [read_jsonl(spark, paths).withColumn("dataset", F.lit(name)) for name, paths in sorted(splits.datasets.items())]
        together = _held(union(spark, sets), held)
        parts.append(active["cross-dataset-overlap"].check(together, list(splits.datasets), config.settings("cross-dataset-overlap")))
        found.append(in_records(together, marker))
    return without_suppressed(union(spark, parts), union(spark, found).distinct() if found else None)
