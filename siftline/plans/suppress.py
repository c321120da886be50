"""Suppression: findings that a row or a line of the file itself switches off.

A JSON row lists rule ids in its member `_<marker>_disable`, an array of strings; a Python line has a comment
`# <marker>:disable=id,id`. The marker is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_values import items_of, member, trim

MARKER = "siftline"


def in_records(docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, row, rule_id) that records switch off; a list with a member that is no string counts for nothing."""
    listed = docs.where("tag = 'object'").select("path", "row", items_of(member("doc", f"_{marker}_disable")).alias("items"))
    items = listed.where(F.expr("items IS NOT NULL AND forall(items, x -> schema_of_variant(x) IN ('STRING', 'VOID'))"))
    return items.select("path", "row", F.explode("items").alias("x")).select("path", "row", F.try_variant_get("x", "$", "string").alias("rule_id")).where("rule_id IS NOT NULL").distinct()


def in_sources(sources: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, line, rule_id) that comments switch off."""
    lines = sources.select("path", F.posexplode(F.split("source", "\n")).alias("at", "text"))
    found = lines.select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("text", rf"#\s*{marker}:disable=([a-zA-Z][a-zA-Z0-9_,\- ]*[a-zA-Z0-9])", 1).alias("ids")).where("ids <> ''")
    return found.select("path", "line", F.explode(F.split("ids", ",")).alias("id")).select("path", "line", trim(F.col("id")).alias("rule_id")).where("rule_id <> ''").distinct()


def without_suppressed(found: DataFrame, rows: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """found without the findings of a (path, row, rule) or (path, line, rule) that is switched off."""
    if rows is not None:
        found = found.join(rows, ["path", "row", "rule_id"], "left_anti")
    if lines is not None:
        found = found.join(lines, ["path", "line", "rule_id"], "left_anti")
    return found.select("rule_id", "severity", "message", "path", "line", "row", "col", "fix")
