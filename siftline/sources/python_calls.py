"""Calls in Python source files: one row for each call, from the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import ENDINGS, union
from .paths import groups, named, packed, reader, resolve

CALLS = "path string, dotted string, base_name string, line int, col int, start_off bigint, preorder int, nested boolean, last_import int"


def dotted_name(node: ast.expr) -> str:
    """a.b.c of names and attributes only, else nothing."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


#: Lines that a statement may lose one by one before what is left of it is tried less and less often, to keep the work in bounds.
PATIENCE = 50
#: What ends or quotes code within a line.
_MARKS = re.compile(r"""#.*|\"\"\"|'''|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[()\[\]{}]""")
_OPENS = re.compile(r"(?:import|from|def|class|async|return|if|for|while|with|try|raise|assert|del|global|nonlocal|pass|break|continue)\b|@")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t\f"))


def _statements(lines: list[str], lo: int, hi: int) -> list[int]:
    """Where the statements of the block that begins at line lo begin: a line that is not deeper, outside brackets and long strings.

    Brackets may never be closed in broken code, so a line that only can begin a statement does so.
    """
    base, found, depth, quote = _indent(lines[lo]), [], 0, ""
    for n in range(lo, hi):
        line = lines[n]
        text = line.strip()
        if not quote and text and not text.startswith("#") and _indent(line) <= base:
            if depth and _OPENS.match(text):
                depth = 0
            if not depth and not (found and _GOES_ON.match(text)):
                found.append(n)
        at = 0
        while at < len(line):
            if quote:
                at = line.find(quote, at)
                if at < 0:
                    break
                quote, at = "", at + 3
                continue
            m = _MARKS.search(line, at)
            if not m:
                break
            at, mark = m.end(), m.group()
            if mark in ('"""', "'''"):
                quote = mark
            elif mark in "([{":
                depth += 1
            elif mark in ")]}":
                depth = max(0, depth - 1)
    return found


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _block(lines: list[str], lo: int, hi: int, more: str = "") -> tuple[ast.Module, int] | None:
    """The tree of some lines, and what its line numbers have to be raised by. An indented block is put under a line of its own."""
    above = "if 1:\n" if _indent(lines[lo]) else ""
    tree = _parsed(above + "\n".join(lines[lo:hi]) + more)
    return tree and (tree, lo - bool(above))


def trees_of(source: str) -> list[tuple[ast.Module, int]]:
    """The tree of a source, or those of its parts that parse if the whole does not, each with what its line numbers have to be raised by.

    A block that does not parse is cut into its statements; of a statement that does not, the first line goes, after it was tried
    with an empty body, and what is under it is a block again. So one bad line costs what stands on it.
    """
    whole = _parsed(source)
    if whole is not None:
        return [(whole, 0)]
    lines, found = source.split("\n"), []
    todo = [(0, len(lines), 0)]
    while todo:
        lo, hi, lost = todo.pop()
        while lo < hi and not lines[lo].strip():
            lo += 1
        if lo == hi:
            continue
        if lost < PATIENCE or not lost & (lost - 1):
            tree = _block(lines, lo, hi)
            if tree:
                found.append(tree)
                continue
            starts = _statements(lines, lo, hi)
            if len(starts) > 1:
                todo += [(a, b, 0) for a, b in zip(starts, [*starts[1:], hi], strict=True)]
                continue
        head = _block(lines, lo, lo + 1, " pass") if lines[lo].rstrip().endswith(":") else _block(lines, lo, lo + 1)
        if head:
            found.append(head)
        todo.append((lo + 1, hi, lost + 1))
    return found


def calls_of(source: str) -> list[tuple]:
    """(dotted, base_name, line, col, start_off, preorder, nested, last_import) of each call in source order.

    Code that does not parse, or is nested too deeply for the parser, has no calls; the rest of its file has (see trees_of).
    """
    found, last_import, starts = [], 0, [0]
    for line in source.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    for tree, shift in trees_of(source):
        todo = [(tree, False)]
        while todo:
            node, nested = todo.pop()
            if isinstance(node, ast.Import) or isinstance(node, ast.ImportFrom) and node.module != "__future__":
                last_import = max(last_import, node.end_lineno + shift)
            if isinstance(node, ast.Call):
                begin = starts[node.lineno + shift - 1] + node.col_offset
                found.append((begin, -(starts[node.end_lineno + shift - 1] + node.end_col_offset), node, node.lineno + shift, nested))
                nested = True
            todo += [(below, nested) for below in ast.iter_child_nodes(node)]
    found.sort(key=lambda x: x[:2])
    base = lambda f: f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
    return [(dotted_name(n.func), base(n.func), line, n.col_offset + 1, begin, i, nested, last_import) for i, (begin, _, n, line, nested) in enumerate(found)]


def _text(raw: bytes) -> str:
    """Source text; a byte that is no UTF-8 is a question mark, so that places stay."""
    return re.sub("[\udc80-\udcff]", "?", raw.decode("utf-8", "surrogateescape"))


def calls(sources: DataFrame) -> DataFrame:
    """sources: (path, source). The calls of all files."""

    def run(batches):
        for batch in batches:
            sources = [_text(s or b"") for s in batch.column("source").cast(pa.binary()).to_pylist()]
            rows = [(p, *c) for p, s in zip(batch.column("path").to_pylist(), sources, strict=True) for c in calls_of(s)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CALLS.split(", ")])

    return sources.select("path", "source").mapInArrow(run, CALLS)


def read_sources(spark: SparkSession, paths: list[str], given: dict[str, str] | None = None, ending: str | None = ENDINGS["python"]) -> DataFrame:
    """(path, source) of files and of folders' files, or of texts that are given in the place of a path's file."""
    given = given or {}
    parts = [spark.createDataFrame([(p, given[p]) for p in paths if p in given], "path string, source string")]
    for group in groups(resolve(spark, [p for p in paths if p not in given])[0]):
        read = reader(spark, group, ending).text([x.given for x in group], wholetext=True)
        read = packed(read.select(F.col("value").alias("source"), F.col("_metadata.file_path").alias("_uri")))
        parts.append(named(read, "_uri", group).select("path", "source"))
    return union(parts)
