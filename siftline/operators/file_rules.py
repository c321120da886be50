"""Rules over single rows of a file: malformed lines, personal data, large Parquet row groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..findings import ERROR, WARNING, findings
from ..functions.json_values import entries, quoted, tag
from . import messages

# Kinds of personal data and their patterns; digits and word edges are ASCII.
EDGE_LEFT, EDGE_RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
PII = (
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("us-ssn", EDGE_LEFT + r"\d{3}-\d{2}-\d{4}" + EDGE_RIGHT),
    ("phone", r"(?:\+\d{1,3}[ \-]?)?\(?\d{3}\)?[ \-]\d{3}[ \-]\d{4}"),
    ("credit-card", EDGE_LEFT + r"\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}" + EDGE_RIGHT),
)
MAX_ROWS_PER_GROUP = 1_000_000


def usable(pattern: str) -> str | None:
    """A user's pattern in Java's dialect: named groups and folding are translated; look-around and back references are refused."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", pattern):
        return None
    out = pattern.replace("(?P<", "(?<").replace("(?i)", "(?iu)")
    try:
        re.compile(pattern)
    except re.error:
        return None
    return out


def first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """struct<kind, sample> of the first pattern, in their order, that the text has; else NULL."""
    hits = [F.when((m := F.regexp_substr(text, F.lit(p))).isNotNull(), F.struct(F.lit(k).alias("kind"), m.alias("sample"))) for k, p in patterns]
    return F.coalesce(*hits)


def malformed_lines(docs: DataFrame, settings: Settings) -> DataFrame:
    bad = docs.where(F.col("blank") | ~F.col("valid"))
    message = F.when(F.col("blank"), messages.BLANK_LINE).otherwise("invalid JSON: the line is not one JSON value")
    return findings(bad, "jsonl-malformed-line", ERROR, message, row=F.col("row"))


def personal_data(docs: DataFrame, settings: Settings) -> DataFrame:
    """The first hit of a row, over its top-level strings by key and the patterns in order."""
    patterns = list(PII)
    for raw in settings.texts("extra_patterns"):
        name, sep, pattern = raw.partition("=")
        ready = usable(pattern if sep else raw)
        if ready:
            patterns.append((name if sep else "custom", ready))
    strings = entries(docs).where(tag(F.col("value")) == "string").select("path", "row", "key", F.try_variant_get("value", "$", "string").alias("s"))
    if patterns == list(PII):  # each built-in pattern needs an @ or three digits
        strings = strings.where(F.contains("s", F.lit("@")) | F.col("s").rlike(r"\d{3}"))
    hits = strings.withColumn("hit", first_match(F.col("s"), patterns)).where("hit IS NOT NULL")
    first = hits.groupBy("path", "row").agg(F.min_by(F.struct("key", "hit"), "key").alias("f"))
    message = F.format_string(messages.PERSONAL_DATA, F.col("f.hit.kind"), quoted(F.col("f.key")), quoted(F.col("f.hit.sample")))
    return findings(first, "privacy-pii-detected", ERROR, message, row=F.col("row"))


def large_row_groups(groups: DataFrame, settings: Settings) -> DataFrame:
    most = settings.integer("max_rows_per_group", MAX_ROWS_PER_GROUP)
    message = F.format_string(messages.LARGE_ROW_GROUP, "idx", "num_rows", F.lit(most))
    return findings(groups.where(F.col("num_rows") > most), "parquet-row-group-too-large-for-streaming", WARNING, message, row=F.col("idx") + 1)
