"""Findings: the one table that every rule returns, and helpers to build, order and gate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = (
    "rule_id string, severity int, message string, path string, line int, row bigint, col int, "
    "fix struct<description:string,level:string,edits:array<struct<line:int,insert:string>>>"
)
FIX = "struct<description:string,level:string,edits:array<struct<line:int,insert:string>>>"
INFO, WARNING, ERROR = 0, 1, 2
#: "none" lets everything through as a display filter, and nothing as a gate.
SEVERITIES = {"none": None, "info": INFO, "warning": WARNING, "error": ERROR}
ORDER = ["path", "line", "row", "rule_id", "message"]


def findings(df: DataFrame, rule_id: str, severity: int, message: Column, path: str = "path", line: Column | None = None, row: Column | None = None, col: Column | None = None, fix: Column | None = None) -> DataFrame:
    """df's rows as findings of one rule; a place that is not given is 0."""
    zero = F.lit(0)
    return df.select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.col(path).alias("path"),
        (zero if line is None else line).cast("int").alias("line"),
        (zero if row is None else row).cast("bigint").alias("row"),
        (zero if col is None else col).cast("int").alias("col"),
        (F.lit(None) if fix is None else fix).cast(FIX).alias("fix"),
    )


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(SCHEMA))


def union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else no_findings(spark)


def at_least(df: DataFrame, level: str) -> DataFrame:
    """The findings of a severity name or above; an unknown name is an error."""
    if level not in SEVERITIES:
        raise ValueError(f"unknown severity: {level}")
    return df if SEVERITIES[level] is None else df.where(F.col("severity") >= SEVERITIES[level])


def fails(df: DataFrame, level: str) -> bool:
    """Whether any finding reaches the level; "none" never fails."""
    return SEVERITIES.get(level) is not None and not at_least(df, level).isEmpty()
