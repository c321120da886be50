"""Comparison of two versions of a dataset: rows, fields, and the distributions of shared string fields.

Three aggregations over one table of members with a side; the driver only sees the small report.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_keys
from ..functions.json_values import entries, is_string
from ..functions.scripts import script_counts
from ..operators.schema_rules import rows_of

TOP = 5
#: Fields with more different values over both sides are free text and get no list of values.
MOST_VALUES = 20
#: Letters that one side needs at least for the scripts to be shown.
LEAST_LETTERS = 50


def members(old: DataFrame, new: DataFrame) -> DataFrame:
    """(side, path, row, key, value) of both versions."""
    part = lambda docs, side: entries(docs).withColumn("side", F.lit(side))
    return part(old, "old").unionByName(part(new, "new"))


def field_sets(found: DataFrame) -> DataFrame:
    """(key, status): added, removed or common."""
    sides = found.groupBy("key").agg(F.max(F.col("side") == "old").alias("o"), F.max(F.col("side") == "new").alias("n"))
    return sides.select("key", F.when(F.col("o") & F.col("n"), "common").when(F.col("n"), "added").otherwise("removed").alias("status"))


def shared_strings(found: DataFrame) -> DataFrame:
    """(side, key, v) of the string values of fields that both versions have."""
    common = field_sets(found).where("status = 'common'").select("key")
    strings = found.where(is_string(F.col("value"))).select("side", "key", F.try_variant_get("value", "$", "string").alias("v"))
    return join_keys(strings, common, ["key"], "left_semi")


def top_values(strings: DataFrame) -> DataFrame:
    """(side, key, v, n, place): the commonest values by count, then value; none for free text."""
    # hashes tell which fields have few values, so that free text is never a key
    kinds = strings.select("key", F.xxhash64("v").alias("h")).distinct().groupBy("key").agg(F.count("*").alias("values"))
    few = kinds.where(F.col("values") <= MOST_VALUES).select("key")
    counts = join_keys(strings, few, ["key"], "left_semi").groupBy("key", "side", "v").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("side", "key").orderBy(F.desc("n"), "v")).cast("int")
    return counts.withColumn("place", place).where(F.col("place") <= TOP).select("side", "key", "v", "n", "place")


def length_stats(strings: DataFrame) -> DataFrame:
    """(side, key, count, mean, min, p50, p90, p99, max) of lengths in bytes, percentiles interpolated and exact.

    Lengths are counted first, so the percentiles run over different lengths with their frequencies.
    """
    lengths = strings.groupBy("side", "key", F.octet_length("v").alias("n")).agg(F.count("*").alias("many"))
    cut = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("many")).alias("p")
    stats = lengths.groupBy("side", "key").agg(F.sum("many").alias("count"), (F.sum(F.col("n") * F.col("many")) / F.sum("many")).alias("mean"), F.min("n").alias("min"), cut, F.max("n").alias("max"))
    return stats.select("side", "key", "count", "mean", "min", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "max")


def script_mix(strings: DataFrame) -> DataFrame:
    """(side, key, script, n, ratio); left out if neither side has enough letters."""
    counts = script_counts(strings, "v", ["side", "key"]).groupBy("side", "key", "script").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("side", "key").agg(F.sum("n").alias("total"))
    shown = totals.groupBy("key").agg(F.max("total").alias("most")).where(F.col("most") >= LEAST_LETTERS)
    return counts.join(totals, ["side", "key"]).join(shown, "key", "left_semi").select("side", "key", "script", "n", (F.col("n") / F.col("total")).alias("ratio"))


@dataclass
class Distribution:
    """What is known of one shared string field, for each side."""

    field: str
    top: dict[str, list[tuple[str, int]]] = field(default_factory=lambda: {"old": [], "new": []})
    length: dict[str, dict] = field(default_factory=lambda: {"old": {"count": 0}, "new": {"count": 0}})
    scripts: dict[str, list[tuple[str, int, float]]] = field(default_factory=lambda: {"old": [], "new": []})


@dataclass
class Report:
    old_path: str
    new_path: str
    old_rows: int
    new_rows: int
    added: list[str]
    removed: list[str]
    common: list[str]
    distributions: list[Distribution]

    def as_json(self) -> dict:
        """Keys capitalised, as the JSON form of the report has them."""
        stats = ("count", "mean", "min", "p50", "p90", "p99", "max")
        length = lambda s: {k.capitalize(): s.get(k, 0) for k in stats}
        values = lambda t: [{"Value": v, "Count": n} for v, n in t]
        scripts = lambda t: [{"Script": s, "Count": n, "Ratio": r} for s, n, r in t]
        made = [
            {"Field": d.field} | {f"{side.capitalize()}{name}": f(getattr(d, attr)[side]) for name, attr, f in (("Top", "top", values), ("Length", "length", length), ("Scripts", "scripts", scripts)) for side in ("old", "new")}
            for d in self.distributions
        ]
        return {"OldPath": self.old_path, "NewPath": self.new_path, "OldRows": self.old_rows, "NewRows": self.new_rows, "Added": self.added, "Removed": self.removed, "Common": self.common, "Distributions": made}

    def as_dict(self) -> dict:
        return asdict(self)


def compare(old: DataFrame, new: DataFrame, old_path: str = "old", new_path: str = "new") -> Report:
    """The report on two tables of records."""
    found = members(old, new).persist()
    strings = shared_strings(found).persist()
    fields: dict[str, list[str]] = {"added": [], "removed": [], "common": []}
    for r in field_sets(found).orderBy("key").collect():
        fields[r.status].append(r.key)
    made: dict[str, Distribution] = {}
    at = lambda key: made.setdefault(key, Distribution(key))
    for r in length_stats(strings).collect():
        at(r.key).length[r.side] = {k: r[k] for k in ("count", "mean", "min", "p50", "p90", "p99", "max")}
    for r in top_values(strings).orderBy("side", "key", "place").collect():
        at(r.key).top[r.side].append((r.v, r.n))
    for r in script_mix(strings).orderBy("side", "key", F.desc("n"), "script").collect():
        at(r.key).scripts[r.side].append((r.script, r.n, r.ratio))
    report = Report(old_path, new_path, rows_of(old).count(), rows_of(new).count(), fields["added"], fields["removed"], fields["common"], [made[k] for k in sorted(made)])
    strings.unpersist()
    found.unpersist()
    return report
