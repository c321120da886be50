"""The rules as queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Settings
from ..findings import at_least
from ..functions.arrow import dealt
from ..functions.signing import signatures
from ..functions.text import BANDS, SCRIPTS, bands, coefficients, shingles
from ..operators import chat_rules, file_rules, leakage, schema_rules
from ..sinks.files import put_all
from ..sinks.fixes import apply, edits_of
from ..sinks.report import diff_json, summary, write_folder
from ..sinks.report import drops as drop_rows
from ..sources.jsonl import read_jsonl, read_lines, records, table_records
from ..sources.parquet_footers import read_row_groups
from ..sources.paths import address, system_of
from ..sources.python_calls import calls, read_sources
from . import diff
from .lint import Splits, lint_calls, lint_files, lint_splits
from .suppress import MARKER, in_records, in_sources, without_suppressed

DEFAULT = Settings()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("rule_id", "severity", "message", "path", "row")


def _documents(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return table_records(_table(spark, sf_dir, "documents"), F.col("doc_id") + 1, "documents", *(columns or ("text",)))


def _lines(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    """Records from JSON text made of events, in order of event_id."""
    events = _table(spark, sf_dir, "events")
    return records(events.select(F.lit("events").alias("path"), F.lit(0).alias("path_ord"), (F.col("event_id") + 1).alias("row"), F.expr(line).alias("line")))


def _chats(spark: SparkSession, sf_dir: str, role: str = "role", calls: str = "cast(array() AS array<string>)") -> DataFrame:
    """A record with messages for each conversation, in order of turn."""
    rows = _table(spark, sf_dir, "conversations")
    message = F.expr(f"struct({role} AS role, text AS content, concat('c', turn % 3) AS tool_call_id, transform({calls}, x -> struct(x AS id)) AS tool_calls)")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("said")).select("conv_id", F.transform("said", lambda s: s.m).alias("messages"))
    return table_records(chats, F.col("conv_id") + 1, "conversations", "messages")


def malformed_lines(spark, sf_dir):
    return _shown(file_rules.malformed_lines(_lines(spark, sf_dir, "CASE event_id % 50 WHEN 0 THEN concat(props, ' x') WHEN 1 THEN '  ' ELSE props END"), DEFAULT))


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share; where the session names none and runs on one machine, a temporary one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/files-{uuid.uuid4().hex}"


def _part(path: str = "path") -> Column:
    """The part that a file holds, which its folder or the file itself is named after."""
    return F.regexp_extract(path, r"/part=(\d+)[/.]", 1).cast("long").alias("part")


def _in_files(df: DataFrame, order: str, *columns: str, **options: str) -> str:
    """Writes df (with a column `part`) as one file for each part, in an order; the folder. One column is written as text, more as Parquet."""
    folder = _folder(df.sparkSession)
    rows = df.repartition("part").sortWithinPartitions("part", order).select("part", *columns).write.options(**options).partitionBy("part")
    rows.parquet(folder) if len(columns) > 1 else rows.text(folder)
    return folder


def jsonl_files(spark, sf_dir):
    """Lines of files that are written and read back, some malformed, some ending in a carriage return; rows count by file."""
    line = F.expr("CASE event_id % 50 WHEN 0 THEN concat(props, ' x') WHEN 1 THEN '  ' WHEN 2 THEN concat(props, '\\r') ELSE props END").alias("line")
    folder = _in_files(_table(spark, sf_dir, "events").select((F.col("event_id") % 16).alias("part"), "event_id", line), "event_id", "line")
    return file_rules.malformed_lines(read_jsonl(spark, [folder], ".txt"), DEFAULT).select("rule_id", "severity", "message", _part(), "row")


def row_groups(spark, sf_dir):
    """Row groups of files of several, which are written and whose footers are read."""
    docs = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 16).alias("part"), "doc_id", "n_chars")
    folder = _in_files(docs, "doc_id", "doc_id", "n_chars", **{"parquet.block.row.count.limit": "20"})
    return file_rules.large_row_groups(read_row_groups(spark, [folder]), Settings({"max_rows_per_group": 12})).select("rule_id", "severity", "message", _part(), "row")


#: Lines of a supplier's source file, and the condition on its key under which the file has each. Some do not parse.
CODE = (
    ("import random", "k >= 0"),
    ("import numpy as np", "k % 2 = 1"),
    ("random.seed(1)", "k % 3 = 0"),
    ("def broken(:", "k % 5 = 0"),
    ("    inner = (rows[: 3", "k % 10 = 5"),
    ("a, b = train_test_split(rows)", "k % 7 < 3"),
    ("random.shuffle(rows)", "k % 4 < 2 AND k % 11 > 0"),
    (f"random.shuffle(rows)  # {MARKER}:disable=random-seed-not-set", "k % 4 < 2 AND k % 11 = 0"),
    ("print(np.random.choice(rows), [unique(x) for x in rows]", "k % 8 = 6"),
    ("frame.drop_duplicates()", "k % 2 = 0"),
    ("for x in names: x.lower()", "k % 9 = 0"),
)


#: Folders that the many small files of code are spread over, so that their list takes few steps.
FOLDERS = 64


def _code_folder(spark, sf_dir, ending: str = ".txt") -> str:
    """A folder with a file for each supplier."""
    key = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    lines = F.array(*(F.when(F.expr(condition), F.lit(line)) for line, condition in CODE))
    files = key.select(F.col("k").alias("part"), "k", F.array_join(F.array_compact(lines), "\n").alias("source"))
    folder = address(spark, _folder(spark))
    try:
        system_of(folder)
    except (OSError, pa.ArrowException):  # a file system that only Spark knows
        folder = _in_files(files, "k", "source")
        return folder if ending == ".txt" else _ending(spark, folder, ending)
    # a number is given, so that many small rows are not put together
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").groupBy("part").agg(F.array_join(F.collect_list("source"), "\n").alias("source"))
    name = F.concat(F.lit("group="), F.pmod(F.xxhash64("part"), F.lit(FOLDERS)), F.lit("/part="), F.coalesce(F.col("part").cast("string"), F.lit("null")), F.lit(ending))
    put_all(files.select(name.alias("name"), F.concat("source", F.lit("\n")).alias("content")), folder)
    return folder


def _code_findings(spark, folder: str) -> DataFrame:
    """Findings of all code rules, but those that a comment on their line switches off. Files are read and parsed once."""
    sources = read_sources(spark, [folder], ending=".txt").persist(StorageLevel.MEMORY_AND_DISK)
    return without_suppressed(lint_calls(calls(sources).persist(StorageLevel.MEMORY_AND_DISK)), lines=in_sources(sources))


def code_files(spark, sf_dir):
    return _code_findings(spark, _code_folder(spark, sf_dir)).select("rule_id", "severity", "message", _part(), "line", "col")


def fix_edits(spark, sf_dir):
    return edits_of(_code_findings(spark, _code_folder(spark, sf_dir))).select(_part(), "line", "insert")


def fixed_files(spark, sf_dir):
    """The lines of the files after the fixes have been written."""
    folder = _code_folder(spark, sf_dir)
    apply(_code_findings(spark, folder))
    return read_lines(spark, [folder], ".txt").select(_part(), "row", "line")


def _ending(spark, folder: str, ending: str) -> str:
    """folder, its text files renamed to another ending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(hadoop.Path(f"{folder}/part=*/*.txt")):
        system.rename(found.getPath(), hadoop.Path(found.getPath().toString().removesuffix(".txt") + ending))
    return folder


def lint_folders(spark, sf_dir):
    """Findings of some rules over folders with JSON lines, Python and Parquet, each file by its ending."""
    events = _table(spark, sf_dir, "events").select((F.col("event_id") % 16).alias("part"), "event_id", F.when(F.col("event_id") % 50 == 0, "{").otherwise(F.col("props")).alias("line"))
    docs = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 16).alias("part"), "doc_id", "n_chars")
    folders = [_ending(spark, _in_files(events, "event_id", "line"), ".jsonl"), _code_folder(spark, sf_dir, ".py"), _in_files(docs, "doc_id", "doc_id", "n_chars")]
    large = "parquet-row-group-too-large-for-streaming"
    config = Config(rules={large: {"max_rows_per_group": 12}}, enable=("jsonl-malformed-line", "random-seed-not-set", large))
    return lint_files(spark, folders, config).select("rule_id", "severity", _part(), "line", "row")


def split_files(spark, sf_dir):
    """Overlaps of a training and an evaluation split and of two datasets, read from files of JSON lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("kind"), (F.col("doc_id") % 5).alias("part"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("line"))
    train, evaluation, a, b = (_ending(spark, _in_files(docs.where(F.col("kind") == k), "doc_id", "line"), ".jsonl") for k in range(4))
    return lint_splits(spark, Splits([train], [evaluation], {"a": [a], "b": [b]})).select("rule_id", "severity", _part(), "row")


def user_patterns(spark, sf_dir):
    """Personal data and two patterns of a user's own, one of them named; a third cannot be used."""
    own = Settings({"extra_patterns": ["year=(?:19|20)[0-9]{2}", "(?i)licen[cs]e [a-z]+", "(?=x)"]})
    return _shown(file_rules.personal_data(_documents(spark, sf_dir), own))


def _report_parts(spark, sf_dir, form: str) -> DataFrame:
    """The parts of a report that is written as a folder, each as one string."""
    folder = _folder(spark)
    write_folder(_two_rules(spark, sf_dir)[0], form, folder)
    return spark.read.text(f"{folder}/part-*", wholetext=True)


def _report_items(spark, sf_dir, form: str, schema: str) -> DataFrame:
    array = F.concat(F.lit("["), F.regexp_replace("value", r"\A\s*,", ""), F.lit("]"))
    return _report_parts(spark, sf_dir, form).select(F.explode(F.from_json(array, f"array<struct<{schema}>>")).alias("x")).select("x.*")


def report_json(spark, sf_dir):
    return _report_items(spark, sf_dir, "json", "rule_id string, severity int, message string, path string, row bigint")


def report_sarif(spark, sf_dir):
    place = "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>"
    found = _report_items(spark, sf_dir, "sarif", f"ruleId string, level string, message struct<text:string>, {place}").withColumn("at", F.col("locations")[0]["physicalLocation"])
    return found.select(F.col("ruleId").alias("rule_id"), "level", F.col("message.text").alias("message"), F.col("at.artifactLocation.uri").alias("path"), F.col("at.region.startLine").alias("row"))


def report_html(spark, sf_dir):
    """The rows of the page's tables, as they are written."""
    rows = _report_parts(spark, sf_dir, "html").select(F.explode(F.regexp_extract_all("value", F.lit("<tr>(.*?)</tr>"), F.lit(1))).alias("tr"))
    return rows.select(F.regexp_extract("tr", "^<td>(.*?)</td>", 1).alias("place"), F.regexp_extract("tr", "</td><td>(.*)</td>$", 1).alias("message"))


def diff_report(spark, sf_dir):
    """The comparison of two versions, as its JSON form has it: rows, fields and the commonest values."""
    events = _table(spark, sf_dir, "events")
    old = table_records(events.where("event_id % 3 = 0"), F.col("event_id"), "old", "event_type", F.col("props").alias("gone"))
    new = table_records(events.where("event_id % 3 > 0"), F.col("event_id"), "new", "event_type", F.col("props").alias("fresh"))
    found = json.loads(diff_json(diff.compare(old, new)))
    rows = [("rows", side, str(found[f"{side}Rows"]), None) for side in ("Old", "New")] + [("field", kind, key, None) for kind in ("Added", "Removed", "Common") for key in found[kind] or ()]
    rows += [(f"top {side} {d['Field']}", str(i), v["Value"], v["Count"]) for d in found["Distributions"] for side in ("Old", "New") for i, v in enumerate(d[f"{side}Top"])]
    return spark.createDataFrame(rows, "section string, name string, value string, n long")


def pii_scan(spark, sf_dir):
    return _shown(file_rules.personal_data(_documents(spark, sf_dir), DEFAULT))


def type_mixed(spark, sf_dir):
    return _shown(schema_rules.mixed_types(_lines(spark, sf_dir, """CASE WHEN event_id % 97 = 0 THEN '{"k": "x"}' ELSE props END"""), DEFAULT))


def type_mismatch(spark, sf_dir):
    """Two declarations that hold and three that are not valid and count for nothing."""
    return _shown(schema_rules.mismatched_types(_lines(spark, sf_dir, """CASE WHEN event_id % 97 = 0 THEN '{"k": "x", "m": [{"a": 1}, {"a": "s"}]}' ELSE props END"""), Settings({"field_types": {"k": "string", "m[].a": "number", "k..x": "string", "event": "word", "k.": "number"}})))


def optional_field(spark, sf_dir):
    lines = """CASE WHEN event_id % 10 = 3 THEN '{"a": 1}' ELSE '{"a": 1, "b": 2}' END"""
    return _shown(schema_rules.optional_fields(_lines(spark, sf_dir, lines), Settings({"required_fields": ["c", "a"]})))


def enum_drift(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return _shown(schema_rules.enum_drift(table_records(events, F.col("event_id") + 1, "events", "event_type"), Settings({"lock_in_rows": 3})))


INVERTED = "CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN 'assistant' ELSE role END"


def role_inversion(spark, sf_dir):
    return _shown(chat_rules.role_inversion(_chats(spark, sf_dir, role=INVERTED), DEFAULT))


def system_mid(spark, sf_dir):
    return _shown(chat_rules.system_mid_conversation(_chats(spark, sf_dir, role="CASE WHEN (conv_id + turn) % 7 = 0 THEN 'system' ELSE role END"), DEFAULT))


TOOL_ROLE = "CASE WHEN (conv_id + turn) % 4 = 0 THEN 'tool' ELSE role END"


def tool_without_call(spark, sf_dir):
    return _shown(chat_rules.tool_results_without_calls(_chats(spark, sf_dir, role=TOOL_ROLE, calls="CASE WHEN (conv_id + turn) % 3 = 0 THEN array(concat('c', turn % 2)) ELSE cast(array() AS array<string>) END"), DEFAULT))


def unbalanced_tool_call(spark, sf_dir):
    return _shown(chat_rules.unbalanced_tool_calls(_chats(spark, sf_dir, role=TOOL_ROLE, calls="CASE WHEN (conv_id + turn) % 3 = 0 THEN array(concat('c', turn % 2)) ELSE cast(array() AS array<string>) END"), DEFAULT))


def eval_leaks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 40 == 0, F.concat(F.col("text"), F.lit(" Answer only with the LETTER of it"))).otherwise(F.col("text"))
    messages = F.array(F.struct(F.lit("system").alias("role"), text.alias("content")))
    return _shown(chat_rules.system_prompt_leaks(table_records(docs, F.col("doc_id") + 1, "documents", messages.alias("messages")), DEFAULT))


def _split(spark, sf_dir, condition: str, name: str) -> DataFrame:
    return table_records(_table(spark, sf_dir, "documents").where(condition), F.col("doc_id") + 1, name, "text")


def exact_overlap(spark, sf_dir):
    return _shown(leakage.train_eval_overlap(_split(spark, sf_dir, "doc_id % 2 = 0", "train"), _split(spark, sf_dir, "doc_id % 2 = 1", "eval"), Settings({"prompt_field": "text"})))


def near_overlap(spark, sf_dir):
    settings = Settings({"prompt_field": "text", "near_dup_threshold": 0.7})
    return _shown(leakage.train_eval_overlap(_split(spark, sf_dir, "doc_id % 2 = 0", "train"), _split(spark, sf_dir, "doc_id % 2 = 1", "eval"), settings))


def cross_dataset(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    sets = table_records(docs, F.col("doc_id") + 1, "documents", "text", "doc_id")
    sets = sets.withColumn("dataset", F.concat(F.lit("d"), F.try_variant_get("doc", "$.doc_id", "long") % 3))
    return _shown(leakage.cross_dataset_overlap(sets, ["d0", "d1", "d2"], Settings({"prompt_field": "text"})))


def cross_near(spark, sf_dir):
    """As cross_dataset, with near overlaps at 0.7, the earlier dataset being told."""
    docs = _table(spark, sf_dir, "documents")
    sets = table_records(docs, F.col("doc_id") + 1, "documents", "text", "doc_id")
    sets = sets.withColumn("dataset", F.concat(F.lit("d"), F.try_variant_get("doc", "$.doc_id", "long") % 3))
    return _shown(leakage.cross_dataset_overlap(sets, ["d0", "d1", "d2"], Settings({"prompt_field": "text", "near_dup_threshold": 0.7, "anchor": "earlier"})))


def benchmark_contained(spark, sf_dir):
    return leakage.contained(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def shingle_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(shingles(F.col("text"))).cast("long").alias("n_shingles"), F.md5(F.array_join(shingles(F.col("text")), "|")).alias("digest"))


def minhash(spark, sf_dir):
    signed = signatures(dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id")
    return signed.select(F.col("id").alias("doc_id"), F.col("signature")[0].alias("h0"), F.col("signature")[127].alias("h127"), F.aggregate("signature", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def band_buckets(spark, sf_dir):
    """Documents by band with another in their bucket; the buckets are hashes of Spark's own."""
    cut = bands(signatures(dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id"))
    shared = cut.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    return shared.groupBy("band").agg(F.sum("n").alias("n_docs")).where(F.col("band") < BANDS)


def _strings(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("side"), F.col("lang").alias("key"), F.col("text").alias("v"))


def script_mix(spark, sf_dir):
    return diff.script_mix(_strings(spark, sf_dir))


def length_stats(spark, sf_dir):
    shown = diff.length_stats(_strings(spark, sf_dir))
    return shown.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p90", "p99")})


def _event_members(spark, sf_dir) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    old = table_records(events.where("event_id % 3 = 0"), F.col("event_id"), "old", "event_type", "user_id", F.col("props").alias("gone"))
    new = table_records(events.where("event_id % 3 > 0"), F.col("event_id"), "new", "event_type", "user_id", F.col("props").alias("fresh"))
    return diff.members(old, new)


def field_sets(spark, sf_dir):
    """Fields named by the users of events, so that the table says which of them both versions have."""
    docs = _lines(spark, sf_dir, """concat('{"u', user_id, '": ', event_id, '}')""")
    return diff.field_sets(diff.members(docs.where("(row - 1) % 3 = 0"), docs.where("(row - 1) % 3 > 0")))


def top_values(spark, sf_dir):
    return diff.top_values(diff.shared_strings(_event_members(spark, sf_dir)))


def _two_rules(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Errors of personal data and warnings of drift in the language field of documents, and these records."""
    docs = _documents(spark, sf_dir, "text", "lang", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("privacy-pii-detected"))).alias(f"_{MARKER}_disable"))
    drift = schema_rules.enum_drift(_documents(spark, sf_dir, "lang"), Settings({"lock_in_rows": 2}))
    return file_rules.personal_data(docs, DEFAULT).unionByName(drift), docs


def drops(spark, sf_dir):
    return drop_rows(_two_rules(spark, sf_dir)[0])


def severity_filter(spark, sf_dir):
    return _shown(at_least(_two_rules(spark, sf_dir)[0], "error"))


def suppressed(spark, sf_dir):
    found, docs = _two_rules(spark, sf_dir)
    return _shown(without_suppressed(found, in_records(docs)))


def rule_summary(spark, sf_dir):
    return summary(_two_rules(spark, sf_dir)[0])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        malformed_lines, jsonl_files, row_groups, code_files, fix_edits, fixed_files, lint_folders, split_files, user_patterns, report_json, report_sarif, report_html, diff_report, pii_scan, type_mixed, type_mismatch, optional_field, enum_drift, role_inversion, system_mid, tool_without_call, unbalanced_tool_call, eval_leaks,
        exact_overlap, near_overlap, cross_dataset, cross_near, benchmark_contained, shingle_counts, minhash, band_buckets, script_mix, length_stats, field_sets, top_values, drops,
        severity_filter, suppressed, rule_summary,
    )
}

_TRIM = r"regexp_replace(text, '^[\t-\r \x{85}\pZ]+|[\t-\r \x{85}\pZ]+$', '', 'g')"
_PII = r"""
hits AS (SELECT doc_id, regexp_extract(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}') AS e, regexp_extract(text, '\b\d{3}-\d{2}-\d{4}\b') AS s,
  regexp_extract(text, '(?:\+\d{1,3}[ \-]?)?\(?\d{3}\)?[ \-]\d{3}[ \-]\d{4}') AS p, regexp_extract(text, '\b\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}\b') AS c FROM documents),
kinds AS (SELECT doc_id, CASE WHEN e <> '' THEN 'email' WHEN s <> '' THEN 'us-ssn' WHEN p <> '' THEN 'phone' WHEN c <> '' THEN 'credit-card' END AS kind, CASE WHEN e <> '' THEN e WHEN s <> '' THEN s WHEN p <> '' THEN p ELSE c END AS sample FROM hits),
pii AS (SELECT 'privacy-pii-detected' AS rule_id, 2 AS severity, kind || ' pattern matched in field "text" (sample: "' || sample || '"); training data should not carry user PII' AS message, 'documents' AS path, doc_id + 1 AS row FROM kinds WHERE kind IS NOT NULL)"""
_DRIFT = """
langs AS (SELECT lang AS v, min(doc_id + 1) AS first FROM documents GROUP BY lang),
lock AS (SELECT max(doc_id + 1) AS last FROM (SELECT doc_id FROM documents WHERE lang IS NOT NULL ORDER BY doc_id LIMIT 2)),
drift AS (SELECT 'enum-drift' AS rule_id, 1 AS severity, 'field "lang" gained value "' || v || '" not seen in the first 2 lock-in rows' AS message, 'documents' AS path, first AS row FROM langs, lock WHERE first > last),
both_rules AS (SELECT * FROM pii UNION ALL SELECT * FROM drift)"""


def _chat_sql(role: str, calls: str = "[]") -> str:
    return f"""WITH said AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, {role} AS role, 'c' || turn % 3 AS used, {calls} AS calls FROM conversations)"""


_CALLS = "CASE WHEN (conv_id + turn) % 3 = 0 THEN ['c' || turn % 2] ELSE [] END"
_PLACE = "'conversations' AS path, conv_id + 1 AS row"

ORACLES: dict[str, str] = {
    "malformed_lines": "SELECT 'jsonl-malformed-line' AS rule_id, 2 AS severity, CASE event_id % 50 WHEN 0 THEN 'invalid JSON: the line is not one JSON value' ELSE 'blank line in JSONL' END AS message, 'events' AS path, event_id + 1 AS row FROM events WHERE event_id % 50 < 2",
    "pii_scan": f"WITH {_PII} SELECT * FROM pii",
    "type_mixed": """WITH t AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'string' ELSE 'number' END AS kind, count(*) AS n, min(event_id + 1) AS first FROM events GROUP BY 1), top AS (SELECT kind AS k, n AS m FROM t ORDER BY n DESC, kind LIMIT 1)
SELECT 'field-type-mixed-across-rows' AS rule_id, 1 AS severity, 'field "k" has mixed types: ' || k || ' dominant (' || m || ' rows); ' || kind || ' first seen here (' || n || ' rows)' AS message, 'events' AS path, first AS row FROM t, top WHERE kind <> k""",
    "type_mismatch": """WITH a AS (SELECT count(*) AS n, min(event_id + 1) AS first, 'path "k" declared as string but observed as number in ' AS head FROM events WHERE event_id % 97 <> 0 UNION ALL SELECT count(*), min(event_id + 1), 'path "m[].a" declared as number but observed as string in ' FROM events WHERE event_id % 97 = 0)
SELECT 'field-type-mismatch-with-schema' AS rule_id, 1 AS severity, head || n || ' value(s); first at row ' || first AS message, 'events' AS path, first AS row FROM a""",
    "optional_field": """WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 10 <> 3) AS n, min(event_id + 1) FILTER (WHERE event_id % 10 = 3) AS missing FROM events)
SELECT 'optional-field-required-by-downstream' AS rule_id, 1 AS severity, 'schema declares "c" as required but ' || total || '/' || total || ' rows are missing it' AS message, 'events' AS path, CAST(1 AS BIGINT) AS row FROM t
UNION ALL SELECT 'optional-field-required-by-downstream', 1, 'field "b" appears in ' || n || '/' || total || ' rows (' || printf('%.1f', 100.0 * n / total) || '%); either mark it required or check the missing rows', 'events', missing FROM t""",
    "enum_drift": """WITH v AS (SELECT event_type AS v, min(event_id + 1) AS first FROM events GROUP BY 1), l AS (SELECT max(event_id + 1) AS last FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 3))
SELECT 'enum-drift' AS rule_id, 1 AS severity, 'field "event_type" gained value "' || v || '" not seen in the first 3 lock-in rows' AS message, 'events' AS path, first AS row FROM v, l WHERE first > last""",
    "role_inversion": _chat_sql(INVERTED) + f""", l AS (SELECT conv_id, i, role, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM said), f AS (SELECT conv_id, min(i) AS i FROM l WHERE role = 'assistant' AND before = 'assistant' GROUP BY conv_id)
SELECT 'role-inversion' AS rule_id, 2 AS severity, 'assistant message at index ' || i || ' follows assistant at index ' || i - 1 || ' with no user/tool between' AS message, {_PLACE} FROM f""",
    "system_mid": _chat_sql("CASE WHEN (conv_id + turn) % 7 = 0 THEN 'system' ELSE role END") + f""", f AS (SELECT conv_id, min(i) AS i FROM said WHERE role = 'system' AND i > 0 GROUP BY conv_id)
SELECT 'system-message-mid-conversation' AS rule_id, 2 AS severity, 'system message at index ' || i || ' (only index 0 is conventional); likely a misformatted prompt template' AS message, {_PLACE} FROM f""",
    "tool_without_call": _chat_sql(TOOL_ROLE, calls=_CALLS) + f""", f AS (SELECT conv_id, min(i) FILTER (WHERE role = 'tool') AS i, min(i) FILTER (WHERE role = 'assistant' AND len(calls) > 0) AS call FROM said GROUP BY conv_id)
SELECT 'tool-result-without-tool-call' AS rule_id, 2 AS severity, 'tool message at index ' || i || ' has no preceding assistant message with tool_calls' AS message, {_PLACE} FROM f WHERE i IS NOT NULL AND (call IS NULL OR call > i)""",
    "unbalanced_tool_call": _chat_sql(TOOL_ROLE, calls=_CALLS) + f""", d AS (SELECT conv_id, unnest(calls) AS id, i FROM said WHERE role = 'assistant'), s AS (SELECT conv_id, id, min(i) AS since FROM d GROUP BY 1, 2),
u AS (SELECT said.conv_id, i, used FROM said LEFT JOIN s ON s.conv_id = said.conv_id AND s.id = used WHERE role = 'tool' AND (since IS NULL OR since > i)), f AS (SELECT conv_id, min(i) AS i, arg_min(used, i) AS id FROM u GROUP BY conv_id)
SELECT 'unbalanced-tool-call-id' AS rule_id, 2 AS severity, 'tool message at index ' || i || ' references tool_call_id "' || id || '" with no preceding assistant tool_calls entry' AS message, {_PLACE} FROM f""",
    "exact_overlap": f"""WITH p AS (SELECT doc_id, {_TRIM} AS prompt FROM documents), t AS (SELECT prompt, min(doc_id + 1) AS place FROM p WHERE doc_id % 2 = 0 AND prompt <> '' GROUP BY prompt)
SELECT 'train-eval-overlap' AS rule_id, 2 AS severity, 'eval prompt also appears in train at train row ' || place AS message, 'eval' AS path, doc_id + 1 AS row FROM p JOIN t USING (prompt) WHERE doc_id % 2 = 1""",
    "cross_dataset": f"""WITH p AS (SELECT doc_id, 'd' || doc_id % 3 AS ds, {_TRIM} AS prompt FROM documents), f AS (SELECT ds, prompt, min(doc_id + 1) AS place FROM p WHERE prompt <> '' GROUP BY ds, prompt)
SELECT 'cross-dataset-overlap' AS rule_id, 2 AS severity, 'prompt also appears in dataset "' || f.ds || '" at documents row ' || place || ' (this row is in dataset "' || p.ds || '")' AS message, 'documents' AS path, doc_id + 1 AS row FROM p JOIN f ON f.prompt = p.prompt AND f.ds < p.ds""",
    "benchmark_contained": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "shingle_counts": r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[\t-\r \x{85}\pZ]+') IF x <> ''] AS w FROM documents)
SELECT doc_id, CAST(greatest(len(w) - 2, 0) AS BIGINT) AS n_shingles, md5(coalesce(array_to_string([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)], '|'), '')) AS digest FROM w""",
    "minhash": r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[\t-\r \x{85}\pZ]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS s FROM w WHERE len(w) >= 3), x AS (SELECT doc_id, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % 2147483647 AS x FROM s),
h AS (SELECT doc_id, """ + ", ".join(f"min(({a} * x + {b}) % 2147483647) AS h{i}" for i, (a, b) in enumerate(coefficients())) + " FROM x GROUP BY doc_id) SELECT doc_id, h0, h127, CAST(" + " + ".join(f"h{i}" for i in range(128)) + " AS BIGINT) AS total FROM h",
    "script_mix": "WITH s AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, lang AS key, text FROM documents WHERE text IS NOT NULL), c AS (" + " UNION ALL ".join(f"SELECT side, key, '{x}' AS script, CAST(sum(len(regexp_extract_all(text, '\\p{{{x}}}'))) AS BIGINT) AS n FROM s GROUP BY ALL" for x in SCRIPTS) + r"), o AS (SELECT side, key, 'Other' AS script, CAST(sum(len(regexp_extract_all(text, '\pL'))) AS BIGINT) AS letters FROM s GROUP BY ALL), a AS (SELECT * FROM c UNION ALL SELECT side, key, script, letters - (SELECT sum(n) FROM c WHERE c.side = o.side AND c.key = o.key) FROM o), t AS (SELECT side, key, sum(n) AS total FROM a GROUP BY ALL) SELECT side, key, script, CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS ratio FROM a JOIN t USING (side, key) WHERE n > 0 AND key IN (SELECT key FROM t WHERE total >= 50)",
    "length_stats": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, lang AS key, count(*) AS count, round(CAST(sum(strlen(text)) AS DOUBLE) / count(*), 6) AS mean, CAST(min(strlen(text)) AS INTEGER) AS min, round(quantile_cont(strlen(text), 0.5), 6) AS p50, round(quantile_cont(strlen(text), 0.9), 6) AS p90, round(quantile_cont(strlen(text), 0.99), 6) AS p99, CAST(max(strlen(text)) AS INTEGER) AS max FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "field_sets": "SELECT 'u' || user_id AS key, CASE WHEN bool_and(event_id % 3 = 0) THEN 'removed' WHEN bool_and(event_id % 3 > 0) THEN 'added' ELSE 'common' END AS status FROM events GROUP BY user_id",
    "top_values": """WITH c AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'old' ELSE 'new' END AS side, 'event_type' AS key, event_type AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY side, key ORDER BY n DESC, v) AS INTEGER) AS place FROM c) WHERE place <= 5 AND (SELECT count(DISTINCT v) FROM c) <= 20""",
    "drops": f"WITH {_PII}, {_DRIFT} SELECT path, row, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM both_rules GROUP BY path, row",
    "severity_filter": f"WITH {_PII}, {_DRIFT} SELECT * FROM both_rules WHERE severity >= 2",
    "suppressed": f"WITH {_PII}, {_DRIFT} SELECT * FROM both_rules WHERE NOT (rule_id = 'privacy-pii-detected' AND row % 2 = 1)",
    "rule_summary": f"WITH {_PII}, {_DRIFT} SELECT rule_id, count(*) AS n, CAST(min(severity) AS INTEGER) AS severity FROM both_rules GROUP BY rule_id",
}

_SIGNED = r"""
w AS (SELECT prompt, [x FOR x IN regexp_split_to_array(lower(prompt), '[\t-\r \x{85}\pZ]+') IF x <> ''] AS w FROM (SELECT DISTINCT prompt FROM p)),
s AS (SELECT prompt, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS s FROM w WHERE len(w) >= 3),
x AS (SELECT prompt, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % 2147483647 AS x FROM s),
g AS (SELECT prompt, [""" + ", ".join(f"min(({a} * x + {b}) % 2147483647)" for a, b in coefficients()) + """] AS h FROM x GROUP BY prompt),
b AS (SELECT prompt, h, unnest(range(32)) AS band FROM g), k AS (SELECT prompt, band, h[4 * band + 1:4 * band + 4] AS bucket FROM b)"""

ORACLES["band_buckets"] = f"""WITH p AS (SELECT doc_id, text AS prompt FROM documents), {_SIGNED}, shared AS (SELECT band, count(*) AS n FROM k JOIN p USING (prompt) GROUP BY band, bucket HAVING count(*) > 1)
SELECT CAST(band AS INTEGER) AS band, CAST(sum(n) AS BIGINT) AS n_docs FROM shared GROUP BY band"""

def _code_sql() -> str:
    """lines: (k, i, line, n) of the lines of each file; found: the calls that count, each on a line of its own, with its column."""
    lines = " UNION ALL ".join(f"SELECT s_suppkey AS k, {i} AS i, '{line}' AS line FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier) WHERE {condition}" for i, (line, condition) in enumerate(CODE))
    return f"""WITH all_lines AS ({lines}), lines AS (SELECT k, i, line, CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS INTEGER) AS n FROM all_lines),
files AS (SELECT k, bool_or(line LIKE '%.seed(%') AS seeded, bool_or(line LIKE '%.lower(%') AS normal, min(n) FILTER (WHERE line LIKE '%train_test_split(%') AS split, max(n) FILTER (WHERE line LIKE 'import %') AS imports FROM lines GROUP BY k),
found AS (SELECT k, n, line, seeded, normal, split, imports, regexp_extract(line, '^(random|np\\.random)\\.(shuffle|choice)') AS name FROM lines JOIN files USING (k) WHERE line NOT LIKE 'print(%'),
unseeded AS (SELECT * FROM found WHERE name <> '' AND NOT seeded AND line NOT LIKE '%:disable=random-seed-not-set')"""


ORACLES["code_files"] = _code_sql() + """
SELECT 'random-seed-not-set' AS rule_id, 1 AS severity, name || ' called without random.seed/np.random.seed earlier in this file; pipeline output is non-reproducible' AS message, CAST(k AS BIGINT) AS part, n AS line, 1 AS col FROM unseeded
UNION ALL SELECT 'shuffle-after-split', 2, name || ' called after train/eval split; either shuffle before splitting or seed each split''s RNG explicitly', k, n, 1 FROM found WHERE name LIKE '%.shuffle' AND n > split
UNION ALL SELECT 'dedup-key-misses-normalization', 1, 'drop_duplicates called with no string normalization (lower/strip/casefold/unicodedata.normalize) elsewhere in this file; near-duplicates may slip through', k, n, 1 FROM found WHERE line LIKE '%.drop_duplicates()' AND NOT normal"""
ORACLES["fixed_files"] = _code_sql() + """, fixed AS (SELECT DISTINCT k, imports FROM unseeded)
SELECT CAST(lines.k AS BIGINT) AS part, CAST(n + CASE WHEN n > imports THEN 1 ELSE 0 END AS BIGINT) AS row, line FROM lines LEFT JOIN fixed USING (k) UNION ALL SELECT k, imports + 1, 'random.seed(0)' FROM fixed"""
ORACLES["lint_folders"] = _code_sql() + """, e AS (SELECT event_id, event_id % 16 AS part, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS row FROM events),
d AS (SELECT doc_id % 16 AS part, count(*) AS n FROM documents GROUP BY 1)
SELECT 'jsonl-malformed-line' AS rule_id, 2 AS severity, part, 0 AS line, row FROM e WHERE event_id % 50 = 0
UNION ALL SELECT 'random-seed-not-set', 1, CAST(k AS BIGINT), n, 0 FROM unseeded UNION ALL SELECT 'parquet-row-group-too-large-for-streaming', 1, part, 0, 1 FROM d WHERE n > 12"""
ORACLES["split_files"] = f"""WITH p AS (SELECT doc_id % 4 AS kind, doc_id % 5 AS part, row_number() OVER (PARTITION BY doc_id % 4, doc_id % 5 ORDER BY doc_id) AS row, {_TRIM} AS prompt FROM documents)
SELECT 'train-eval-overlap' AS rule_id, 2 AS severity, part, row FROM p WHERE kind = 1 AND prompt <> '' AND prompt IN (SELECT prompt FROM p WHERE kind = 0)
UNION ALL SELECT 'cross-dataset-overlap', 2, part, row FROM p WHERE kind = 3 AND prompt <> '' AND prompt IN (SELECT prompt FROM p WHERE kind = 2)"""
ORACLES["user_patterns"] = f"""WITH {_PII}, more AS (SELECT doc_id, regexp_extract(text, '(?:19|20)[0-9]{{2}}') AS y, regexp_extract(text, '(?i)licen[cs]e [a-z]+') AS o FROM documents WHERE doc_id NOT IN (SELECT row - 1 FROM pii))
SELECT * FROM pii UNION ALL SELECT 'privacy-pii-detected', 2, CASE WHEN y <> '' THEN 'year' ELSE 'custom' END || ' pattern matched in field "text" (sample: "' || CASE WHEN y <> '' THEN y ELSE o END || '"); training data should not carry user PII', 'documents', doc_id + 1 FROM more WHERE y <> '' OR o <> ''"""
ORACLES["report_json"] = f"WITH {_PII}, {_DRIFT} SELECT rule_id, severity, message, path, row FROM both_rules"
ORACLES["report_sarif"] = f"WITH {_PII}, {_DRIFT} SELECT rule_id, CASE severity WHEN 2 THEN 'error' ELSE 'warning' END AS level, message, path, row FROM both_rules"
ORACLES["report_html"] = f"""WITH {_PII}, {_DRIFT} SELECT path || ':' || row AS place, replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS message FROM both_rules"""
ORACLES["diff_report"] = """WITH c AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'Old' ELSE 'New' END AS side, event_type AS v, count(*) AS n FROM events GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, v) - 1 AS i FROM c)
SELECT 'rows' AS section, side AS name, CAST(sum(n) AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS n FROM c GROUP BY side
UNION ALL SELECT 'field', kind, key, NULL FROM (SELECT DISTINCT unnest(CASE side WHEN 'Old' THEN ['Common', 'Removed'] ELSE ['Common', 'Added'] END) AS kind, unnest(CASE side WHEN 'Old' THEN ['event_type', 'gone'] ELSE ['event_type', 'fresh'] END) AS key FROM c)
UNION ALL SELECT 'top ' || side || ' event_type', CAST(i AS VARCHAR), v, n FROM top WHERE i < 5 AND (SELECT count(DISTINCT v) FROM c) <= 20"""
ORACLES["fix_edits"] = _code_sql() + " SELECT DISTINCT CAST(k AS BIGINT) AS part, imports + 1 AS line, 'random.seed(0)' || chr(10) AS insert FROM unseeded"


def _leak_sql() -> str:
    """All phrases on the whole text of every row; the first one in order that is there counts."""
    hits = ", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in chat_rules.EVAL_PHRASES)
    return f"""WITH texts AS (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN text || ' Answer only with the LETTER of it' ELSE text END AS text FROM documents), hits AS (SELECT doc_id, coalesce({hits}) AS hit FROM texts)
SELECT 'system-prompt-leaks-eval-instructions' AS rule_id, 1 AS severity, 'system message at index 0 matches eval-instruction pattern "' || hit || '"' AS message, 'documents' AS path, doc_id + 1 AS row FROM hits WHERE hit IS NOT NULL"""


ORACLES["eval_leaks"] = _leak_sql()
ORACLES["jsonl_files"] = """WITH e AS (SELECT event_id, event_id % 16 AS part, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS row FROM events)
SELECT 'jsonl-malformed-line' AS rule_id, 2 AS severity, CASE event_id % 50 WHEN 0 THEN 'invalid JSON: the line is not one JSON value' ELSE 'blank line in JSONL' END AS message, part, row FROM e WHERE event_id % 50 < 2"""
ORACLES["row_groups"] = """WITH d AS (SELECT doc_id % 16 AS part, (row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) - 1) // 20 AS g FROM documents)
SELECT 'parquet-row-group-too-large-for-streaming' AS rule_id, 1 AS severity, 'row group ' || g || ' has ' || count(*) || ' rows (>12); streaming readers will buffer the whole group before projecting columns' AS message, part, g + 1 AS row
FROM d GROUP BY part, g HAVING count(*) > 12"""

ORACLES["near_overlap"] = f"""WITH p AS (SELECT doc_id, {_TRIM} AS prompt FROM documents), t AS (SELECT prompt, min(doc_id + 1) AS place FROM p WHERE doc_id % 2 = 0 AND prompt <> '' GROUP BY prompt),
e AS (SELECT doc_id, prompt FROM p WHERE doc_id % 2 = 1 AND prompt <> ''), {_SIGNED},
pairs AS (SELECT l.prompt AS a, r.prompt AS c, min(l.band) AS band FROM k l JOIN k r ON l.band = r.band AND l.bucket = r.bucket WHERE l.prompt IN (SELECT prompt FROM e) AND l.prompt NOT IN (SELECT prompt FROM t) AND r.prompt IN (SELECT prompt FROM t) GROUP BY 1, 2),
sims AS (SELECT a, band, place, list_sum([CASE WHEN ga.h[i] = gc.h[i] THEN 1 ELSE 0 END FOR i IN range(1, 129)]) / 128 AS sim FROM pairs JOIN g ga ON ga.prompt = a JOIN g gc ON gc.prompt = c JOIN t ON t.prompt = c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, band, place) AS n FROM sims WHERE sim >= 0.7) WHERE n = 1),
near AS (SELECT doc_id, 'eval prompt is a near-duplicate (similarity ' || printf('%.2f', sim) || ') of train at train row ' || place AS message FROM e JOIN best ON a = prompt),
found AS (SELECT doc_id, 'eval prompt also appears in train at train row ' || place AS message FROM e JOIN t USING (prompt) UNION ALL SELECT * FROM near)
SELECT 'train-eval-overlap' AS rule_id, 2 AS severity, message, 'eval' AS path, doc_id + 1 AS row FROM found"""

ORACLES["cross_near"] = f"""WITH p AS (SELECT doc_id, doc_id % 3 AS ds, {_TRIM} AS prompt FROM documents), f AS (SELECT ds, prompt, min(doc_id + 1) AS place FROM p WHERE prompt <> '' GROUP BY ds, prompt), {_SIGNED},
pairs AS (SELECT l.prompt AS a, r.prompt AS c, min(l.band) AS band FROM k l JOIN k r ON l.band = r.band AND l.bucket = r.bucket WHERE l.prompt <> r.prompt GROUP BY 1, 2),
sims AS (SELECT a, f.ds, band, place, list_sum([CASE WHEN ga.h[i] = gc.h[i] THEN 1 ELSE 0 END FOR i IN range(1, 129)]) / 128 AS sim FROM pairs JOIN g ga ON ga.prompt = a JOIN g gc ON gc.prompt = c JOIN f ON f.prompt = c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, ds ORDER BY sim DESC, band, place) AS n FROM sims WHERE sim >= 0.7) WHERE n = 1),
near AS (SELECT p.doc_id, p.ds, best.ds AS other, place, sim FROM p JOIN best ON a = prompt AND best.ds > p.ds WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.prompt = p.prompt AND f.ds = best.ds)),
found AS (SELECT p.doc_id, p.ds, f.ds AS other, place, NULL AS sim FROM p JOIN f ON f.prompt = p.prompt AND f.ds > p.ds UNION ALL SELECT * FROM near)
SELECT 'cross-dataset-overlap' AS rule_id, 2 AS severity, CASE WHEN sim IS NULL THEN 'prompt also appears in' ELSE 'prompt is a near-duplicate (similarity ' || printf('%.2f', sim) || ') of' END || ' dataset "d' || other || '" at documents row ' || place || ' (this row is in dataset "d' || ds || '")' AS message,
  'documents' AS path, doc_id + 1 AS row FROM found"""
