"""Record rules on streams: new JSON-lines files in a folder, findings out as they come.

Only rules that judge a record by itself run on a stream: malformed lines, personal data and the order of messages. The
number of a row in its file is not known while a file streams; a finding's row is its place in the micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..findings import union
from ..plans.registry import rules
from ..sources.jsonl import records

BY_RECORD = (
    "jsonl-malformed-line", "privacy-pii-detected", "role-inversion", "system-message-mid-conversation", "unbalanced-tool-call-id",
    "tool-result-without-tool-call", "system-prompt-leaks-eval-instructions",
)


def lint_batch(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of one batch of (path, line)."""
    placed = lines.withColumn("row", F.monotonically_increasing_id() + 1).withColumn("path_ord", F.lit(0))
    docs = records(placed)
    return union(lines.sparkSession, [r.check(docs, config.settings(r.id)) for r in rules() if r.id in BY_RECORD and config.enabled(r.id)])


def lint_stream(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, config: Config = Config(), **trigger) -> StreamingQuery:
    """Starts a query that hands each batch's findings to sink(findings, batch number)."""
    lines = spark.readStream.option("lineSep", "\n").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        sink(lint_batch(held, config), number)
        held.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
