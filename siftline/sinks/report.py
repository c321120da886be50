"""Findings as JSON, SARIF, HTML and lists of rows to drop; dataset comparisons as text and JSON."""

from __future__ import annotations

import html
import io
import json
import textwrap
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import TextIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..findings import ORDER
from ..plans.diff import Report
from .files import put

TOOL = "siftline"
# Fixed values of the SARIF format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
LEVELS = {2: "error", 1: "warning", 0: "note"}
NAMES = {2: "error", 1: "warning", 0: "info"}


def ordered(found: DataFrame) -> Iterator[Row]:
    """Findings in a fixed order, partition by partition: the driver never holds all of them."""
    return found.orderBy(*ORDER).toLocalIterator()


def _json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _items(items: Iterator[dict], indent: str, out: TextIO) -> None:
    """A JSON array of items, one after the other."""
    some = False
    for item in items:
        out.write((",\n" if some else "[\n") + textwrap.indent(_json(item), indent + "  "))
        some = True
    out.write(f"\n{indent}]" if some else "[]")


def write_json(found: DataFrame, out: TextIO) -> None:
    _items((r.asDict(recursive=True) for r in ordered(found)), "", out)


def _sarif_result(r: Row) -> dict:
    """A row stands for a line where there is no line; no place without a path, no region without a line."""
    result = {"ruleId": r.rule_id, "level": LEVELS.get(r.severity, "none"), "message": {"text": r.message}}
    if r.path:
        place: dict = {"artifactLocation": {"uri": r.path}}
        if r.line or r.row:
            place["region"] = {"startLine": r.line or r.row}
        result["locations"] = [{"physicalLocation": place}]
    return result


def _sarif_frame(version: str) -> list[str]:
    """What stands before and behind the list of results."""
    driver = {"name": TOOL} | ({"version": version} if version else {})
    return _json({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": driver}, "results": []}]}).split("[]")


def write_sarif(found: DataFrame, out: TextIO, version: str = "") -> None:
    head, tail = _sarif_frame(version)
    out.write(head)
    _items(map(_sarif_result, ordered(found)), "      ", out)
    out.write(tail)


def summary(found: DataFrame) -> DataFrame:
    """(rule_id, n, severity): findings by rule, with the severity of the first."""
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.min_by("severity", F.struct(*ORDER[:3])).cast("int").alias("severity"))


def _html_row(r: Row) -> str:
    at = r.line or r.row
    return f"<tr><td>{html.escape(r.path or '')}{f':{at}' if at else ''}</td><td>{html.escape(r.message)}</td></tr>"


def _html_heading(rule_id: str) -> str:
    return f"<h2 id='{html.escape(rule_id)}'>{html.escape(rule_id)}</h2>"


def _html_head(found: DataFrame, out: TextIO) -> None:
    totals = summary(found).orderBy("rule_id").collect()
    out.write(f"<!doctype html><html><head><meta charset='utf-8'><title>{TOOL} report</title></head><body><h1>Findings</h1>")
    out.write(f"<p>{sum(t.n for t in totals)} findings, {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}</p><ul>")
    for t in totals:
        out.write(f"<li><a href='#{html.escape(t.rule_id)}'>{html.escape(t.rule_id)}</a>: {t.n} ({NAMES.get(t.severity, '')})</li>")
    out.write("</ul>")


def write_html(found: DataFrame, out: TextIO) -> None:
    _html_head(found, out)
    last = None
    for r in found.orderBy("rule_id", *ORDER[:3], "message").toLocalIterator():
        if r.rule_id != last:
            out.write(("" if last is None else "</table>") + _html_heading(r.rule_id) + "<table>")
            last = r.rule_id
        out.write(_html_row(r))
    out.write(("" if last is None else "</table>") + "</body></html>")


def drops(found: DataFrame) -> DataFrame:
    """(path, row, rules): rows with findings and the rules they break, comma-joined; findings without a row or path are left out."""
    rows = found.where("row > 0 AND path <> ''").groupBy("path", "row").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    return rows.select("path", "row", "rules")


def write_drops(found: DataFrame, out: TextIO) -> None:
    for r in drops(found).orderBy("path", "row").toLocalIterator():
        out.write(f"{r.path}\t{r.row}\t{r.rules}\n")


FORMATS = {"json": write_json, "sarif": write_sarif, "html": write_html, "drops": write_drops}


def _lines(render: Callable[[Row, bool, str | None], str], begin: int | None = None, close: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as lines. render gets a row, whether it is the report's first, and the rule of the one before it in its partition.

    begin: the first partition with rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = TaskContext.get().partitionId() == begin, None
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                lines.append(render(Row(**r), first, last))
                first, last = False, r["rule_id"]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if close and last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([close])], ["value"])

    return run


def _array_line(item: Callable[[Row], dict], indent: str) -> Callable[[Row, bool, str | None], str]:
    return lambda r, first, _: ("" if first else ",\n") + textwrap.indent(_json(item(r)), indent)


def write_folder(found: DataFrame, form: str, path: str, version: str = "") -> None:
    """A report of any size as a folder: its files one after the other, in order of their names, are the report.

    Tasks render and write their own ranges of the findings, so none passes through the driver, which adds what stands before
    and behind them when all are written. In a page (html), a rule's table may be cut in two.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    spark, head, tail, kept = found.sparkSession, io.StringIO(), "", None
    if form == "drops":
        lines = drops(found).orderBy("path", "row").select(F.concat_ws("\t", "path", "row", "rules").alias("value"))
    elif form == "html":
        _html_head(found, head)
        tail = "</body></html>"
        row = lambda r, first, last: ("" if r.rule_id == last else ("" if last is None else "</table>") + _html_heading(r.rule_id) + "<table>") + _html_row(r)
        lines = found.orderBy("rule_id", *ORDER[:3], "message").mapInArrow(_lines(row, close="</table>"), "value string")
    else:
        before, tail = ("", "") if form == "json" else _sarif_frame(version)
        head.write(before + "[\n")
        line = _array_line(lambda r: r.asDict(recursive=True), "  ") if form == "json" else _array_line(_sarif_result, " " * 8)
        tail = ("]" if form == "json" else " " * 6 + "]") + tail
        kept = found.orderBy(*ORDER).persist()
        begin = kept.select(F.spark_partition_id().alias("part")).agg(F.min("part")).first()[0]
        lines = kept.mapInArrow(_lines(line, begin), "value string")
    lines.write.text(path)
    if kept is not None:
        kept.unpersist()
    for name, text in (("head", head.getvalue()), ("tail", tail)):  # their names lie before and behind those of the parts
        if text:
            put(spark, f"{path}/{name}", text.encode())


def write(found: DataFrame, form: str, out: TextIO) -> None:
    """Writes findings piece by piece, so that the driver holds one partition of them at a time."""
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    FORMATS[form](found, out)


def rendered(found: DataFrame, form: str, *args: str) -> str:
    """The whole report as a string, for few findings."""
    out = io.StringIO()
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    FORMATS[form](found, out, *args)
    return out.getvalue()


def as_json(found: DataFrame) -> str:
    return rendered(found, "json")


def as_sarif(found: DataFrame, version: str = "") -> str:
    return rendered(found, "sarif", version)


def as_html(found: DataFrame) -> str:
    return rendered(found, "html")


def as_drops(found: DataFrame) -> str:
    return rendered(found, "drops")


def diff_text(r: Report) -> str:
    # The labels and the layout, as scripts read this report line by line.
    delta = r.new_rows - r.old_rows
    out = [
        f"{TOOL} diff", f"  old: {r.old_path}  ({r.old_rows} rows)", f"  new: {r.new_path}  ({r.new_rows} rows; {'+' if delta > 0 else ''}{delta})",
        *(f"  {name + ':':<17}[{', '.join(fields)}]" for name, fields in (("fields added", r.added), ("fields removed", r.removed), ("fields in both", r.common))),
    ]
    if r.distributions:
        out.append("  field distributions (shared string fields):")
    for d in r.distributions:
        out.append(f"    {d.field}:")
        both = lambda name, shown: [f"      {f'{side} {name}:':<13}{shown[side]}" for side in ("old", "new") if shown[side]]
        if d.top["old"] or d.top["new"]:
            out += both("top", {s: "[" + ", ".join(f"{v}:{n}" for v, n in d.top[s]) + "]" for s in d.top})
        out += both("length", {s: "count={count} mean={mean:.1f} min={min} p50={p50:.1f} p90={p90:.1f} p99={p99:.1f} max={max}".format(**x) if x["count"] else "" for s, x in d.length.items()})
        if d.scripts["old"] or d.scripts["new"]:
            out += both("scripts", {s: "[" + ", ".join(f"{k}:{n} ({100 * q:.0f}%)" for k, n, q in d.scripts[s]) + "]" for s in d.scripts})
    return "\n".join(out) + "\n"


def diff_json(r: Report) -> str:
    return json.dumps(r.as_json(), indent=2, ensure_ascii=False)
