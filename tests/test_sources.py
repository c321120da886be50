"""Inputs by any path, deep sources, line ends kept by fixes, band layouts."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siftline.cli import main
from siftline.config import Config
from siftline.findings import SCHEMA
from siftline.functions.text import bands
from siftline.plans.lint import Splits, lint_files, lint_splits
from siftline.sinks.fixes import apply
from siftline.sources.jsonl import read_jsonl, read_lines
from siftline.sources.parquet_footers import read_row_groups
from siftline.sources.python_calls import calls_of, read_sources


@pytest.fixture
def folder(tmp_path):
    deep = tmp_path / "in put+%20" / "deep"
    deep.mkdir(parents=True)
    (deep.parent / "a.jsonl").write_bytes(b'{"a": 1}\r\n\n{"b": 2}')
    (deep / "b.jsonl").write_text('{"a": 1}\nnot json\n')
    (deep / "c.py").write_text("import random\nrandom.shuffle(a)\n")
    (deep / "other.txt").write_text("not read\n")
    pq.write_table(pa.table({"id": list(range(25))}), deep / "d.parquet", row_group_size=10)
    return deep.parent


def places(found):
    return sorted((r.rule_id, r.path.rsplit("/", 1)[-1], r.row or r.line) for r in found.collect())


def test_folders_patterns_and_uris(spark, folder):
    for given in (str(folder), f"file://{folder}", f"file:{folder}"):
        assert sorted(r.row for r in read_jsonl(spark, [given]).collect()) == [1, 1, 2, 2, 3], given
    found = lint_files(spark, [str(folder)])
    assert places(found) == [("jsonl-malformed-line", "a.jsonl", 2), ("jsonl-malformed-line", "b.jsonl", 2), ("random-seed-not-set", "c.py", 2)]
    assert {r.path for r in found.collect()} == {str(folder / "a.jsonl"), str(folder / "deep/b.jsonl"), str(folder / "deep/c.py")}
    for given in (f"{folder}/*.jsonl", f"{folder}/a.jsonl", f"file:{folder}/a.jsonl"):
        (r,) = lint_files(spark, [given]).collect()
        assert r.row == 2 and r.path == (str(folder / "a.jsonl") if "*" in given else given)
    both = read_lines(spark, [f"{folder}/a.jsonl", f"file:{folder}/deep/b.jsonl", f"{folder}/a.jsonl"]).collect()
    assert sorted((r.path_ord, r.row) for r in both) == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)]


def test_paths_that_match_nothing_are_findings(spark, folder, capsys):
    gone = [f"{folder}/gone.jsonl", f"{folder}/gone.py", f"{folder}/no*.jsonl", "nosuch://host/x.jsonl", f"{folder}/nothing"]
    found = lint_files(spark, [*gone, f"{folder}/deep/c.py"]).collect()
    assert sorted(r.path for r in found if "read error" in r.message) == sorted(gone) and len(found) == len(gone) + 1
    found = lint_splits(spark, Splits(train=[gone[0]], evaluation=[f"{folder}/a.jsonl"])).collect()
    assert [r.path for r in found] == [gone[0]]
    assert main([gone[0]], spark) == 0 and json.loads(capsys.readouterr().out)[0]["path"] == gone[0]
    assert main(["--diff-old", gone[0], "--diff-new", f"{folder}/a.jsonl"], spark) == 1


def test_row_groups_of_files_folders_and_what_cannot_be_read(spark, folder):
    expected = [(0, 10), (1, 10), (2, 5)]
    (folder / "broken.parquet").write_text("no parquet")
    for given in (f"{folder}/deep/d.parquet", f"file:{folder}/deep/d.parquet", str(folder), f"{folder}/deep/*.parquet"):
        assert sorted((r.idx, r.num_rows) for r in read_row_groups(spark, [given]).collect()) == expected, given
    (r,) = read_row_groups(spark, [f"{folder}/gone.parquet"]).collect()
    assert r.idx is None and r.error == "no such file"


def test_sources_of_a_folder_and_given_texts(spark, folder):
    got = {r.path: r.source for r in read_sources(spark, [str(folder), "open.py"], {"open.py": "x = 1"}).collect()}
    assert got == {str(folder / "deep/c.py"): "import random\nrandom.shuffle(a)\n", "open.py": "x = 1"}


def test_deep_sources_do_not_break():
    long_sum = "x = f(1)" + " + f(1)" * 3000
    assert len(calls_of(long_sum)) in (0, 3001)
    chain = "a" + ".b" * 3000 + "()"
    assert calls_of(chain) == [] or calls_of(chain)[0][1] == "b"
    assert calls_of("(" * 5000 + ")" * 5000) == []


def test_fixes_keep_line_ends_and_bytes(spark, tmp_path):
    path = tmp_path / "p.py"
    path.write_bytes(b"import random\r\nx = '\xe9'\r\n\r\nrandom.shuffle(x)\r\n")
    row = ("r", 1, "m", str(path), 4, None, 1, ("d", "l", [(2, "random.seed(0)\n")]))
    done = apply(spark.createDataFrame([row, row], SCHEMA))
    assert (done.files, done.edits) == (1, 1) and [p.name for p in tmp_path.iterdir()] == ["p.py"]
    assert path.read_bytes() == b"import random\r\nrandom.seed(0)\nx = '\xe9'\r\n\r\nrandom.shuffle(x)\r\n"


def test_band_layouts(spark):
    signed = spark.createDataFrame([("long", list(range(128))), ("short", [1, 2, 3])], "id string, signature array<bigint>")
    counted = lambda *layout: {r.id: r["count"] for r in bands(signed, *layout).groupBy("id").count().collect()}
    assert counted() == {"long": 32} and counted(16, 8) == {"long": 16} and counted(1, 3) == {"long": 1, "short": 1}
    assert counted(1000, 1000) == counted(0, 4) == {"long": 32}


def test_a_byte_order_mark_makes_the_first_line_malformed(spark, tmp_path):
    (tmp_path / "a b+%20.jsonl").write_bytes(b'\xef\xbb\xbf{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.jsonl").write_bytes(b'{"a": 1}\n\xef\xbb\xbf\n')
    found = lint_files(spark, [str(tmp_path)], Config(enable=("jsonl-malformed-line",)))
    assert places(found) == [("jsonl-malformed-line", "a b+%20.jsonl", 1), ("jsonl-malformed-line", "b.jsonl", 2)]
    assert read_lines(spark, [f"{tmp_path}/a b+%20.jsonl"]).where("row = 1").first().line == '\ufeff{"a": 1}'
