"""Joins of rows with small tables of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys up to which a table of them is broadcast.
MANY = 50_000


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table that has each key once: as the fields or files of rows, of which there may be one.

    The table is counted at once, and worked out again by the join; nothing stays persisted. MANY keys or less are broadcast, so rows are not exchanged and those of one key
    stay spread over all tasks. More keys are joined by exchanging rows, where Spark splits skewed partitions.
    """
    return rows.join(F.broadcast(keys) if keys.limit(MANY + 1).count() <= MANY else keys, on, how)
