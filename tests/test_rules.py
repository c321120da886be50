"""The rules on small files of each fixture's shape: positive, negative and configured cases."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.config import Config, Settings
from siftline.operators import schema_rules
from siftline.plans import registry
from siftline.plans.lint import Splits, lint_files, lint_splits
from siftline.sources.jsonl import kind_of, read_jsonl, read_lines


@pytest.fixture
def write(tmp_path):
    def make(name, lines):
        path = tmp_path / name
        path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
        return str(path)

    return make


def rows(spark, paths, rule, config=None, **kw):
    config = config or {}
    found = lint_files(spark, paths if isinstance(paths, list) else [paths], Config(rules={rule: config}, enable=(rule,)), **kw)
    return sorted((r.row or r.line, r.message) for r in found.collect())


def at(found):
    return [r for r, _ in found]


def test_malformed_lines(spark, write, tmp_path):
    bad = write("a.jsonl", [{"id": 1}, "{broken", {"id": 3}, "   ", '{"a":1} x', "1,2", "null", "42", "[]", '{"a":1,"a":2}', "1e999", '{"a": -1e999}', '"1e999"'])
    assert at(rows(spark, bad, "jsonl-malformed-line")) == [2, 4, 5, 6, 11, 12]
    assert rows(spark, bad, "jsonl-malformed-line")[1][1] == "blank line in JSONL"
    missing = rows(spark, str(tmp_path / "none.jsonl"), "jsonl-malformed-line")
    assert len(missing) == 1 and missing[0][0] == 0 and missing[0][1].startswith("read error: ")


def test_lines_are_physical_rows(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_bytes(b'{"a":1}\r\n\n{"a":"x\\ry"}\rz\n' + b'{"a":3}')
    got = [(r.row, r.line) for r in read_lines(spark, [str(path)]).orderBy("row").collect()]
    assert got == [(1, '{"a":1}'), (2, ""), (3, '{"a":"x\\ry"}\rz'), (4, '{"a":3}')]
    many = tmp_path / "many files +%20.jsonl"
    many.write_text("".join(f'{{"i": {i}}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        docs = read_jsonl(spark, [str(many), str(path)])
        assert docs.where(F.col("path") == str(many)).where(F.try_variant_get("doc", "$.i", "long") + 1 != F.col("row")).count() == 0
        assert docs.count() == 5004 and {r.path_ord for r in docs.select("path_ord").distinct().collect()} == {0, 1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [kind_of(p) for p in ("a.jsonl", "a.py", "a.parquet", "a.JSONL")] == ["jsonl", "python", "parquet", "unknown"]


def test_personal_data(spark, write):
    path = write("p.jsonl", [{"prompt": "hello"}, {"prompt": "mail me@example.org"}, {"prompt": "ssn 123-45-6789"}, {"prompt": "call +1 555-123-4567"}, {"prompt": "card 1234-5678-9012-3456"}, {"prompt": "12-3", "id": 5551234567}, {"m": [{"c": "x@y.org"}]}, {"b": "a@b.co", "a": "c@d.io"}, {"prompt": "é123-45-6789"}])
    found = rows(spark, path, "privacy-pii-detected")
    assert at(found) == [2, 3, 4, 5, 8, 9]
    assert found[4][1] == 'email pattern matched in field "a" (sample: "c@d.io"); training data should not carry user PII'
    more = rows(spark, path, "privacy-pii-detected", {"extra_patterns": ["greet=hel+o", "(?=x)", "["]})
    assert more[0] == (1, 'greet pattern matched in field "prompt" (sample: "hello"); training data should not carry user PII')


def test_mixed_types_and_declared_types(spark, write):
    path = write("m.jsonl", [{"score": 1, "t": []}, {"score": 2.5}, {"score": "3"}, {"score": None}, "[1]", "nope", {"score": 1e3, "t": "x"}])
    assert rows(spark, path, "field-type-mixed-across-rows") == [
        (3, 'field "score" has mixed types: number dominant (3 rows); string first seen here (1 rows)'),
        (7, 'field "t" has mixed types: array dominant (1 rows); string first seen here (1 rows)'),
    ]
    nested = write("n.jsonl", [{"meta": {"author": "a"}, "messages": [{"role": "u", "content": "x"}]}, {"meta": {"author": 3}, "messages": [{"role": 1}, {"role": "u", "content": None}]}, {"meta": [], "messages": {}}])
    found = rows(spark, nested, "field-type-mismatch-with-schema", {"field_types": {"meta.author": "string", "messages[].role": "string", "messages[].content": "string", "": "string", "x": "date"}})
    assert found == [(2, f'path "{p}" declared as string but observed as {k} in 1 value(s); first at row 2') for p, k in (("messages[].content", "null"), ("messages[].role", "number"), ("meta.author", "number"))]


def test_optional_fields(spark, write):
    most = write("o.jsonl", [{"id": i, "name": "x"} if i != 4 else {"id": 4} for i in range(6)])
    assert rows(spark, most, "optional-field-required-by-downstream") == [(5, 'field "name" appears in 5/6 rows (83.3%); either mark it required or check the missing rows')]
    half = write("h.jsonl", [{"id": i} | ({"name": "x"} if i % 2 == 0 else {}) for i in range(6)])
    assert rows(spark, half, "optional-field-required-by-downstream") == []
    assert at(rows(spark, half, "optional-field-required-by-downstream", {"required_fields": ["name", "gone", "gone"]})) == [1, 1, 2]
    assert rows(spark, write("few.jsonl", [{"a": 1}, {}, {}, {}]), "optional-field-required-by-downstream", {"required_fields": ["a"]}) == []
    late = write("late.jsonl", ["bad", {"id": 1}, *({"id": 1, "n": 1} for _ in range(9))])
    assert at(rows(spark, late, "optional-field-required-by-downstream")) == [1]


def test_enum_drift(spark, write):
    labels = ["a", "b", "a", "b", "a", "c", "a", "c"]
    path = write("e.jsonl", [{"label": v} for v in labels])
    assert rows(spark, path, "enum-drift") == [(6, 'field "label" gained value "c" not seen in the first 5 lock-in rows')]
    assert rows(spark, path, "enum-drift", {"lock_in_rows": 10}) == [] and rows(spark, path, "enum-drift", {"max_distinct": 1}) == []
    assert at(rows(spark, path, "enum-drift", {"lock_in_rows": 0})) == [2, 6]


def chat(*roles, **kw):
    return {"messages": [{"role": r, "content": f"{r} says"} for r in roles]} | kw


def test_conversation_order(spark, write):
    path = write("c.jsonl", [chat("user", "assistant"), chat("user", "assistant", "assistant"), chat("assistant", "tool", "assistant"), {"messages": []}, {}, chat("system", "user", "system"), {"messages": [{"role": "assistant"}, {"role": "assistant"}, {"role": 42}]}, {"messages": {"role": "x"}}, chat("assistant"), "null"])
    assert rows(spark, path, "role-inversion") == [(2, "assistant message at index 2 follows assistant at index 1 with no user/tool between")]
    assert rows(spark, path, "system-message-mid-conversation") == [(6, "system message at index 2 (only index 0 is conventional); likely a misformatted prompt template")]


def test_tool_calls(spark, write):
    call, tool = lambda *ids: {"role": "assistant", "tool_calls": [{"id": i, "type": "f"} for i in ids]}, lambda i=None: {"role": "tool"} | ({"tool_call_id": i} if i is not None else {})
    path = write("t.jsonl", [{"messages": m} for m in ([{"role": "user"}, tool("a")], [call("b"), tool("a")], [tool("a"), call("a")], [call("a", "b"), tool("b"), tool("a")], [call("a"), tool()], [{"role": "assistant"}, tool("")], [call("a"), tool(7)])])
    assert at(rows(spark, path, "unbalanced-tool-call-id")) == [1, 2, 3]
    assert rows(spark, path, "unbalanced-tool-call-id")[1][1] == 'tool message at index 1 references tool_call_id "a" with no preceding assistant tool_calls entry'
    assert at(rows(spark, path, "tool-result-without-tool-call")) == [1, 3, 6]


def test_eval_instructions_in_system_prompts(spark, write):
    says = lambda t, role="system": {"messages": [{"role": role, "content": t}]}
    path = write("s.jsonl", [says("Respond only with the letter."), says("be kind"), says("THE correct answer is B", "user"), says("Pick the best one"), {"messages": [{"role": "user", "content": ["x"]}, {"role": "system", "content": "answer in the format"}]}])
    assert rows(spark, path, "system-prompt-leaks-eval-instructions") == [(1, 'system message at index 0 matches eval-instruction pattern "Respond only with the letter"'), (4, 'system message at index 0 matches eval-instruction pattern "Pick the best"')]
    assert at(rows(spark, path, "system-prompt-leaks-eval-instructions", {"extra_patterns": ["(?i)BE kind"]})) == [1, 2, 4]


def test_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "g.parquet")
    pq.write_table(pa.table({"id": range(300)}), path, row_group_size=100)
    broken = tmp_path / "broken.parquet"
    broken.write_text("no")
    rule = "parquet-row-group-too-large-for-streaming"
    assert rows(spark, [path, str(broken)], rule) == [] and rows(spark, path, rule, {"max_rows_per_group": 100}) == []
    assert at(rows(spark, path, rule, {"max_rows_per_group": 50})) == [1, 2, 3]


CODE = "import random\nimport numpy as np\nfrom sklearn.model_selection import train_test_split\n\na, b = train_test_split(xs)\nrandom.shuffle(a)\n"


def test_python_rules(spark, tmp_path):
    path = tmp_path / "p.py"
    path.write_text(CODE + "p = np.random.permutation(3)\ndf.drop_duplicates()\nfoo(random.shuffle(b))\n")
    seeds = lint_files(spark, [str(path)], Config(enable=("random-seed-not-set",))).orderBy("line").collect()
    assert [(r.line, r.col) for r in seeds] == [(6, 1), (7, 5), (9, 5)] and seeds[0].fix.edits[0].insert == "random.seed(0)\n" and seeds[0].fix.edits[0].line == 4
    assert at(rows(spark, str(path), "shuffle-after-split")) == [6, 7]
    assert at(rows(spark, str(path), "dedup-key-misses-normalization")) == [8]
    quiet = tmp_path / "q.py"
    quiet.write_text("import random\nrandom.seed(1)\nrandom.shuffle(x)\nset(y.strip())\n")
    broken = tmp_path / "b.py"
    broken.write_text("def (")
    assert lint_files(spark, [str(quiet), str(broken)]).count() == 0
    given = rows(spark, "buffer.py", "shuffle-after-split", given={"buffer.py": CODE})
    assert at(given) == [6]


def test_suppression(spark, write, tmp_path):
    path = write("x.jsonl", [chat("user"), chat("assistant", "assistant", _siftline_disable=["role-inversion", "other"]), chat("assistant", "assistant"), chat("assistant", "assistant", _siftline_disable="role-inversion")])
    assert at(rows(spark, path, "role-inversion")) == [3, 4]
    code = tmp_path / "s.py"
    code.write_text(CODE.replace("random.shuffle(a)", "random.shuffle(a)  # siftline:disable=shuffle-after-split, x") + "np.random.shuffle(b)\n")
    assert at(rows(spark, str(code), "shuffle-after-split")) == [7]
    own = write("own.jsonl", [chat("assistant", "assistant", _mine_disable=["role-inversion"])])
    assert rows(spark, own, "role-inversion", marker="mine") == []


def overlap(spark, splits, rule, **settings):
    found = lint_splits(spark, splits, Config(rules={rule: settings}))
    return sorted((r.path.rsplit("/", 1)[-1], r.row, r.message) for r in found.collect())


def test_train_eval_overlap(spark, write):
    train = write("train.jsonl", [{"prompt": "first"}, {"prompt": "what is it"}, {"prompt": "what is it"}, {"prompt": "the quick brown fox jumps over the lazy dog"}])
    evaluation = write("eval.jsonl", [{"prompt": "new"}, {"prompt": " what is it \n"}, {"prompt": 3}, {"prompt": "the quick brown fox jumps over the lazy cat today"}])
    splits = Splits(train=[train], evaluation=[evaluation])
    assert overlap(spark, splits, "train-eval-overlap") == [("eval.jsonl", 2, f"eval prompt also appears in train at {train} row 2")]
    near = overlap(spark, splits, "train-eval-overlap", near_dup_threshold=0.4)
    assert [r[1] for r in near] == [2, 4] and "near-duplicate (similarity 0." in near[1][2] and near[1][2].endswith(f"{train} row 4")
    assert overlap(spark, splits, "train-eval-overlap", prompt_field="input") == []


def test_cross_dataset_overlap(spark, write):
    sets = {n: [write(f"{n}.jsonl", [{"prompt": p} for p in ps])] for n, ps in {"eval": ["a b c", "x"], "test": ["x", "q"], "train": ["w", "a b c", "x"]}.items()}
    later = overlap(spark, Splits(datasets=sets), "cross-dataset-overlap")
    assert [(p, r) for p, r, _ in later] == [("test.jsonl", 1), ("train.jsonl", 2), ("train.jsonl", 3), ("train.jsonl", 3)]
    assert later[1][2] == f'prompt also appears in dataset "eval" at {sets["eval"][0]} row 1 (this row is in dataset "train")'
    earlier = overlap(spark, Splits(datasets=sets), "cross-dataset-overlap", anchor="earlier")
    assert [(p, r) for p, r, _ in earlier] == [("eval.jsonl", 1), ("eval.jsonl", 2), ("eval.jsonl", 2), ("test.jsonl", 1)]
    near = overlap(spark, Splits(datasets={"a": [write("na.jsonl", [{"prompt": "one two three four five six"}])], "b": [write("nb.jsonl", [{"prompt": "one two three four five six seven"}])]}), "cross-dataset-overlap", near_dup_threshold=0.4)
    assert len(near) == 1 and near[0][0] == "nb.jsonl"


def test_registry_and_settings():
    assert len(registry.rules()) == 17 and registry.by_id("enum-drift").category == "schema"
    with pytest.raises(ValueError):
        registry.register(registry.by_id("enum-drift"))
    s = Settings({"a": 2.7, "b": "x", "c": ["p", 3], "d": {"k": "v", "n": 1}, "e": True})
    assert (s.integer("a", 0), s.integer("b", 4), s.integer("e", 5), s.number("a", 0), s.text("a", "d"), s.texts("c"), s.text_map("d")) == (2, 4, 5, 2.7, "d", ["p"], {"k": "v"})
    c = Config(enable=("a",), disable=("b",))
    assert c.enabled("a") and not c.enabled("b") and not c.enabled("z") and Config(disable=("x",)).enabled("y")


def test_empty_files(spark, write):
    empty = write("empty.jsonl", [])
    assert lint_files(spark, [empty]).count() == 0
    assert schema_rules.enum_drift(read_jsonl(spark, [empty]), Settings()).count() == 0
