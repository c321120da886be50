"""Dataset comparison, sinks, fixes, command line, streams and text functions."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.cli import main
from siftline.config import Config, load
from siftline.findings import SCHEMA, at_least, fails
from siftline.functions.scripts import script_counts
from siftline.functions.signing import signatures
from siftline.functions.text import shingles, similarity
from siftline.plans.diff import compare
from siftline.plans.lint import lint_files
from siftline.sinks.fixes import apply, inserted
from siftline.sinks.report import as_drops, as_html, as_json, as_sarif, diff_json, diff_text, rendered
from siftline.sources.jsonl import read_jsonl
from siftline.streaming.records import lint_stream


@pytest.fixture
def write(tmp_path):
    def make(name, lines):
        path = tmp_path / name
        path.write_text("".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in lines))
        return str(path)

    return make


def report(spark, old, new):
    return compare(read_jsonl(spark, [old]), read_jsonl(spark, [new]), old, new)


def test_rows_fields_and_values(spark, write):
    old = write("old.jsonl", [{"id": 1, "name": "a", "score": 2}, "bad", {"id": 2, "name": "b"}, "null", "[1]"])
    new = write("new.jsonl", [{"id": 1, "name": "a", "label": "x"}, *({"id": i, "name": n} for i, n in enumerate("bbaac"))])
    r = report(spark, old, new)
    assert (r.old_rows, r.new_rows, r.added, r.removed, r.common) == (3, 6, ["label"], ["score"], ["id", "name"])
    (d,) = r.distributions
    assert d.field == "name" and d.top == {"old": [("a", 1), ("b", 1)], "new": [("a", 3), ("b", 2), ("c", 1)]} and d.scripts == {"old": [], "new": []}
    text = diff_text(r)
    assert "(6 rows; +3)" in text and "fields added:    [label]" in text and "old top:     [a:1, b:1]" in text and "count=2 mean=1.0 min=1" in text
    made = json.loads(diff_json(r))
    assert made["OldRows"] == 3 and made["Distributions"][0]["NewTop"][0] == {"Value": "a", "Count": 3} and made["Distributions"][0]["OldLength"]["P50"] == 1.0


def test_lengths_are_bytes_and_percentiles_interpolate(spark, write):
    path = write("l.jsonl", [{"t": "éé"}, {"t": "sixsix"}])
    (d,) = report(spark, path, path).distributions
    s = d.length["old"]
    assert (s["count"], s["mean"], s["min"], s["p50"], s["max"]) == (2, 5.0, 4, 5.0, 6) and abs(s["p90"] - 5.8) < 1e-9 and abs(s["p99"] - 5.98) < 1e-9


def test_free_text_has_no_values_and_scripts_need_letters(spark, write):
    many = write("m.jsonl", [{"n": f"v{i}"} for i in range(25)])
    (d,) = report(spark, many, many).distributions
    assert d.top == {"old": [], "new": []} and d.length["old"]["count"] == 25
    latin, mixed = write("a.jsonl", [{"t": "a" * 60}]), write("b.jsonl", [{"t": "a" * 30 + "я" * 25}])
    (d,) = report(spark, latin, mixed).distributions
    assert d.scripts["old"] == [("Latin", 60, 1.0)] and [s[:2] for s in d.scripts["new"]] == [("Latin", 30), ("Cyrillic", 25)]


def test_script_classes(spark):
    row = spark.createDataFrame([("abé 漢字 ひ カー 한 дя ع א न ω ก 1!Ⅷ𝒜",)], "t string")
    got = {c.script: c.n for c in script_counts(row, "t", []).collect()}
    assert got == {"Latin": 3, "Han": 2, "Hiragana": 1, "Katakana": 1, "Hangul": 1, "Cyrillic": 2, "Arabic": 1, "Hebrew": 1, "Devanagari": 1, "Greek": 1, "Thai": 1, "Other": 2}


def test_minhash_estimates(spark):
    a, b, c = "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy cat today", "nothing of this is like the other words at all"
    df = spark.createDataFrame([("a", a), ("a2", a), ("b", b), ("c", c), ("short", "two words")], "id string, text string")
    assert spark.createDataFrame([(a,), ("x y",), (None,)], "t string").select(F.size(shingles(F.col("t"))).alias("n")).collect()[0].n == 7
    s = signatures(df).collect()
    assert {r.id for r in s} == {"a", "a2", "b", "c"}
    pairs = spark.createDataFrame([(x.signature, y.signature) for x, y in [(s[0], s[0])]] + [(None, s[0].signature)], "x array<bigint>, y array<bigint>")
    assert [r.v for r in pairs.select(similarity(F.col("x"), F.col("y")).alias("v")).collect()] == [1.0, 0.0]
    by = {r.id: r.signature for r in s}
    share = lambda x, y: sum(p == q for p, q in zip(by[x], by[y], strict=True)) / 128
    assert share("a", "a2") == 1 and 0.55 <= share("a", "b") <= 0.9 and share("a", "c") <= 0.1


ROWS = [("r2", 2, 'bad "<x>"', "b.jsonl", 0, 2, 0, None), ("r1", 1, "warn", "b.jsonl", 0, 2, 0, None), ("r1", 1, "warn", "b.jsonl", 0, 2, 0, None), ("p", 0, "code", "a.py", 7, 0, 3, None), ("none", 2, "no path", "", 0, 4, 0, None)]


def test_sinks(spark):
    found = spark.createDataFrame(ROWS, SCHEMA)
    empty = found.limit(0)
    assert json.loads(as_json(empty)) == [] and [r["rule_id"] for r in json.loads(as_json(found))] == ["none", "p", "r1", "r1", "r2"]
    sarif = json.loads(as_sarif(found, "1"))
    results = sarif["runs"][0]["results"]
    assert sarif["version"] == "2.1.0" and [r["level"] for r in results] == ["error", "note", "warning", "warning", "error"]
    assert "locations" not in results[0] and results[1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 7} and results[4]["locations"][0]["physicalLocation"]["region"] == {"startLine": 2}
    assert json.loads(as_sarif(empty))["runs"][0]["results"] == []
    assert as_drops(found) == "b.jsonl\t2\tr1,r2\n"
    page = as_html(found)
    assert page.index("<h2 id='none'") < page.index("<h2 id='p'") < page.index("<h2 id='r1'") and "a.py:7" in page and "&lt;x&gt;" in page and "r1</a>: 2 (warning)" in page
    with pytest.raises(ValueError):
        rendered(found, "xml")


def test_severity_filter_and_gate(spark):
    found = spark.createDataFrame(ROWS, SCHEMA)
    assert [at_least(found, s).count() for s in ("none", "info", "warning", "error")] == [5, 5, 4, 2]
    assert fails(found, "error") and not fails(found.where("severity < 2"), "error") and not fails(found, "none")
    with pytest.raises(ValueError):
        at_least(found, "fatal")


def test_fix_and_lint_again(spark, tmp_path):
    path = tmp_path / "f.py"
    path.write_text("import numpy as np\n\nx = np.random.rand(3)\ny = np.random.rand(4)\n")
    config = Config(enable=("random-seed-not-set",))
    done = apply(lint_files(spark, [str(path)], config))
    assert (done.files, done.edits) == (1, 1) and path.read_text().split("\n")[1] == "np.random.seed(0)"
    assert lint_files(spark, [str(path)], config).count() == 0
    assert inserted("a\nb", [(1, "x\n"), (99, "z"), (2, "y")]) == "x\na\ny\nb\nz"


def test_command_line(spark, write, tmp_path, capsys):
    path = write("c.jsonl", [{"a": 1}, "bad"])
    config = tmp_path / "own.yml"
    assert main([path, "--fail-on", "error"], spark) == 1 and json.loads(capsys.readouterr().out)[0]["row"] == 2
    assert main([path, "--fail-on", "none", "--format", "drops"], spark) == 0 and capsys.readouterr().out.strip() == f"{path}\t2\tjsonl-malformed-line"
    assert main([path, "--fail-on", "worst"], spark) == 2 and main([path, "--dataset", "x"], spark) == 2 and main(["--diff-old", path, "--diff-new", "/none"], spark) == 1
    assert main(["--diff-old", path, "--diff-new", path], spark) == 0 and "fields in both:  [a]" in capsys.readouterr().out
    pytest.importorskip("yaml")
    config.write_text("disable: [jsonl-malformed-line]\nrules: {enum-drift: {lock_in_rows: 2}}\n")
    assert main([path, "--config", str(config), "--fail-on", "error"], spark) == 0
    assert load(str(config)).settings("enum-drift").integer("lock_in_rows", 5) == 2


def test_stream_of_records(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"prompt": "me@example.org"}\nbad\n{"messages": [{"role": "assistant"}, {"role": "assistant"}]}\n')
    query = lint_stream(spark, str(folder), lambda found, n: seen.extend(r.rule_id for r in found.collect()), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(seen) == ["jsonl-malformed-line", "privacy-pii-detected", "role-inversion"]


def test_smoke_corpus(spark, write, tmp_path):
    """Counts per rule over a small corpus of every kind of file."""
    chat = lambda *roles: {"messages": [{"role": r} for r in roles]}
    conversations = write("conversations.jsonl", [{"prompt": "p", "completion": "c"}, "not json", chat("assistant", "assistant"), {"messages": [{"role": "system", "content": "Answer with the letter"}]}, chat("user", "tool"), {"messages": [{"role": "tool", "tool_call_id": "x"}]}])
    labels = write("labels.jsonl", [{"label": v} for v in ["a", "b", "a", "b", "a", "c", 3]] + [{"label": "a", "note": "x"}])
    code = tmp_path / "pipeline.py"
    code.write_text("import random\nfrom sklearn.model_selection import train_test_split\na = train_test_split(x)\nrandom.shuffle(a)\nrandom.choice(a)\nset(a)\n")
    counts = {r.rule_id: r["count"] for r in lint_files(spark, [conversations, labels, str(code)]).groupBy("rule_id").count().collect()}
    assert counts == {"jsonl-malformed-line": 1, "role-inversion": 1, "system-prompt-leaks-eval-instructions": 1, "tool-result-without-tool-call": 2, "unbalanced-tool-call-id": 1, "enum-drift": 1, "field-type-mixed-across-rows": 1, "random-seed-not-set": 2, "shuffle-after-split": 1, "dedup-key-misses-normalization": 1, "optional-field-required-by-downstream": 1}
