"""Command line: lint files and splits, or compare two versions of a dataset."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import config
from .findings import SEVERITIES, at_least, fails
from .plans.diff import compare
from .plans.lint import Splits, lint_files, lint_splits, release
from .plans.suppress import MARKER
from .sinks.fixes import apply
from .sinks.report import diff_json, diff_text, write, write_folder
from .sources.jsonl import read_jsonl
from .sources.paths import readable


def _datasets(values: list[str]) -> dict[str, list[str]]:
    """NAME=PATH[,PATH...], repeatable; the same name adds files."""
    out: dict[str, list[str]] = {}
    for v in values:
        name, sep, paths = v.partition("=")
        if not sep or not name or not paths:
            raise ValueError(f"expected NAME=PATH[,PATH...]: {v}")
        out.setdefault(name, []).extend(p for p in paths.split(",") if p)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", description=__doc__)
    p.add_argument("paths", nargs="*")
    p.add_argument("--format", default="json", help="json, sarif, html or drops")
    p.add_argument("--out", help="folder for a report of any size, in place of standard output")
    p.add_argument("--config")
    p.add_argument("--fail-on", default="none", help="exit with 1 if a finding has this severity or above")
    p.add_argument("--min-severity", default="none", help="show findings of this severity or above")
    p.add_argument("--fix", action="store_true")
    p.add_argument("--diff-old")
    p.add_argument("--diff-new")
    p.add_argument("--diff-format", default="text", choices=("text", "json"))
    p.add_argument("--train", action="append", default=[])
    p.add_argument("--eval", action="append", default=[])
    p.add_argument("--dataset", action="append", default=[])
    p.add_argument("--marker", default=MARKER, help="word that suppression comments and members start with")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 for errors and for the gate, or 2 for bad values of flags."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siftline").getOrCreate()
    if args.diff_old or args.diff_new:
        for p in (args.diff_old, args.diff_new):
            if not p or not readable(spark, p):
                print(f"siftline: cannot read {p}", file=sys.stderr)
                return 1
        report = compare(read_jsonl(spark, [args.diff_old]), read_jsonl(spark, [args.diff_new]), args.diff_old, args.diff_new)
        print(diff_text(report) if args.diff_format == "text" else diff_json(report))
        return 0
    try:
        datasets = _datasets(args.dataset)
        if {args.fail_on, args.min_severity} - set(SEVERITIES):
            raise ValueError(f"unknown severity: {({args.fail_on, args.min_severity} - set(SEVERITIES)).pop()}")
    except ValueError as e:
        print(f"siftline: {e}", file=sys.stderr)
        return 2
    held: list[DataFrame] = []
    try:
        settings = config.load(args.config)
        found = lint_files(spark, args.paths, settings, marker=args.marker, held=held)
        splits = Splits(args.train, args.eval, datasets)
        if splits.paths():
            found = found.unionByName(lint_splits(spark, splits, settings, args.marker, held))
        held.append(found.persist())
        shown = at_least(found, args.min_severity)
        if args.out:
            write_folder(shown, args.format, args.out)
        else:
            write(shown, args.format, sys.stdout)
            if args.format != "drops":  # its lines end by themselves
                print()
        if args.fix:
            apply(found)
        return int(fails(found, args.fail_on))
    except (OSError, ValueError) as e:
        print(f"siftline: {e}", file=sys.stderr)
        return 1
    finally:
        release(held)


if __name__ == "__main__":
    sys.exit(main())
