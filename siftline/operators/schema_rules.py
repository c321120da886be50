"""Rules over the fields of a whole file: mixed types, declared types, optional fields, drifting enums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..findings import WARNING, findings, union
from ..functions.joins import join_keys
from ..functions.json_values import PathTree, entries, is_string, kinds_at, parse_path, quoted, rounded, tag
from . import messages

TYPES = ("string", "number", "boolean", "array", "object", "null")


def rows_of(docs: DataFrame) -> DataFrame:
    """Rows that count: objects, and the literal null, which stands for one without members."""
    return docs.where(F.col("tag").isin("object", "null"))


def profile(docs: DataFrame) -> DataFrame:
    """(path, key, kind, n, first): for each field of a file and type of its values, the number of rows and the first of them.

    One aggregation, combined before it is exchanged; rules about types and presence of fields read it instead of the rows.
    """
    seen = entries(docs).select("path", "row", "key", tag(F.col("value")).alias("kind"))
    return seen.groupBy("path", "key", "kind").agg(F.count("*").alias("n"), F.min("row").alias("first"))


def mixed_types(docs: DataFrame, settings: Settings, seen: DataFrame | None = None) -> DataFrame:
    """A finding for each type of a field but its commonest; ties go to the least name. Nulls do not count. seen: the profile of docs."""
    counts = (seen or profile(docs)).where("kind <> 'null'")
    order = Window.partitionBy("path", "key").orderBy(F.desc("n"), "kind")
    ranked = counts.withColumn("place", F.row_number().over(order)).withColumn("top", F.first(F.struct("kind", "n")).over(order))
    message = F.format_string(messages.MIXED_TYPES, quoted(F.col("key")), F.col("top.kind"), F.col("top.n"), F.col("kind"), F.col("n"))
    return findings(ranked.where("place > 1"), "field-type-mixed-across-rows", WARNING, message, row=F.col("first"))


def mismatched_types(docs: DataFrame, settings: Settings) -> DataFrame:
    """A finding for each declared path and type seen there that is not the declared one. Each row is walked once for all paths."""
    declared = {p: t for p, t in sorted(settings.text_map("field_types").items()) if t in TYPES and parse_path(p)}
    if not declared:
        return union(docs.sparkSession, [])
    wanted = F.create_map(*(F.lit(x) for pair in declared.items() for x in pair))
    seen = docs.where("tag = 'object'").select("path", "row", F.explode(kinds_at(F.col("doc"), PathTree.of(list(declared)))).alias("x"))
    found = seen.select("path", "row", "x.at", "x.kind", wanted[F.col("x.at")].alias("want")).where("kind <> want")
    found = found.groupBy("path", "at", "want", "kind").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    message = F.format_string(messages.MISMATCHED_TYPE, quoted(F.col("at")), "want", "kind", "n", "first")
    return findings(found, "field-type-mismatch-with-schema", WARNING, message, row=F.col("first"))


def presence(docs: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per (path, key): rows with the field and the first of them; per path: all rows and the first of them."""
    total = rows_of(docs).groupBy("path").agg(F.count("*").alias("total"), F.min("row").alias("first_row"))
    return (seen or profile(docs)).groupBy("path", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first_seen")), total


def optional_fields(docs: DataFrame, settings: Settings, seen: DataFrame | None = None) -> DataFrame:
    """Required fields that rows lack, and fields that most rows have and some lack. seen: the profile of docs.

    The row of a finding is 1 if the file's first row lacks the field, else the first row without it.
    """
    least = settings.number("min_presence_ratio", 0.8)
    required = settings.texts("required_fields")
    seen, total = presence(docs, seen)
    total = total.where(F.col("total") >= settings.integer("min_rows", 5))
    names = F.array(*(F.lit(r) for r in required)) if required else F.array().cast("array<string>")
    wanted = total.withColumn("key", F.explode(names))
    wanted = wanted.join(seen, ["path", "key"], "left").select("path", "key", F.coalesce("n", F.lit(0)).alias("n"), "first_seen", "total", "first_row", F.lit(True).alias("required")).where("n < total")
    ratio = F.col("n") / F.col("total")
    usual = seen.join(total, "path").where((ratio >= least) & (ratio < 1) & ~F.col("key").isin(required)).select("path", "key", "n", "first_seen", "total", "first_row", F.lit(False).alias("required"))
    fields = wanted.unionByName(usual)
    # the first row without the field, only for fields that are reported and that the first row has; rows are tested in place
    asked = fields.where("first_seen = first_row").select("path", "key").distinct().groupBy("path").agg(F.collect_set("key").alias("asked"))
    held = F.coalesce(F.json_object_keys(F.to_json("doc")), F.array().cast("array<string>"))
    lacking = join_keys(rows_of(docs), asked, ["path"]).select("path", "row", F.explode(F.array_except("asked", held)).alias("key"))
    missing = lacking.groupBy("path", "key").agg(F.min("row").alias("missing"))
    fields = fields.join(missing, ["path", "key"], "left").withColumn("at", F.coalesce("missing", F.lit(1)))
    must = F.format_string(messages.MISSING_REQUIRED, quoted(F.col("key")), F.col("total") - F.col("n"), "total")
    may = F.format_string(messages.MOSTLY_PRESENT, quoted(F.col("key")), "n", "total", rounded(ratio * 100, 1))
    return findings(fields, "optional-field-required-by-downstream", WARNING, F.when(F.col("required"), must).otherwise(may), row=F.col("at"))


def enum_drift(docs: DataFrame, settings: Settings) -> DataFrame:
    """Values that a string field takes after its first `lock_in_rows` occurrences and not among them.

    Fields with more than `max_distinct` values among the first are free text. The first occurrences are ranked without
    their values, and Spark limits the ranks before it exchanges rows; then only values that are new to an enum are exchanged.
    """
    asked, most = settings.integer("lock_in_rows", 5), settings.integer("max_distinct", 8)
    lock_in = max(1, asked)  # one row locks an enum at least
    strings = entries(docs).where(is_string(F.col("value"))).select("path", "key", "row", F.try_variant_get("value", "$", "string").alias("v"))
    place = F.row_number().over(Window.partitionBy("path", "key").orderBy("row"))
    first = strings.select("path", "key", "row").withColumn("place", place).where(F.col("place") <= lock_in)
    last = first.groupBy("path", "key").agg(F.max("row").alias("last"), F.count("*").alias("n")).where(F.col("n") >= lock_in).drop("n")
    locked = join_keys(strings, last, ["path", "key"]).where("row <= last").groupBy("path", "key", "last").agg(F.collect_set("v").alias("locked"))
    enums = locked.where(F.size("locked") <= most)
    fresh = join_keys(strings, enums, ["path", "key"]).where("row > last AND NOT array_contains(locked, v)")
    drifted = fresh.groupBy("path", "key", "v").agg(F.min("row").alias("first"))
    message = F.format_string(messages.ENUM_DRIFT, quoted(F.col("key")), quoted(F.col("v")), F.lit(asked))
    return findings(drifted, "enum-drift", WARNING, message, row=F.col("first"))
