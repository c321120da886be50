"""Rules that read their rows once: declared paths, the profile of fields; broken Python; names in any case; fixes in any file system."""

import json
import random

import pytest

from siftline.config import Config, Settings
from siftline.functions.json_values import entries, parse_path
from siftline.operators import chat_rules, schema_rules
from siftline.plans.lint import lint_files, lint_records, release
from siftline.sinks.fixes import apply
from siftline.sinks.report import rendered, write_folder
from siftline.sources.jsonl import records
from siftline.sources.python_calls import calls_of


def docs_of(spark, values):
    rows = [("f", 0, i + 1, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return records(spark.createDataFrame(rows, "path string, path_ord int, row long, line string").repartition(2))


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def at_path(value, steps):
    """All values at a path, plainly."""
    if not steps:
        return [value]
    if steps[0].name is None:
        return [x for v in value for x in at_path(v, steps[1:])] if isinstance(value, list) else []
    return at_path(value[steps[0].name], steps[1:]) if isinstance(value, dict) and steps[0].name in value else []


KINDS = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object", type(None): "null"}


def test_many_declared_paths_take_one_walk(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.choice(["s", "n", "b", "0", "list", "dict", "dict", "list"] if depth else ["dict"])
        if kind == "list":
            return [value(depth + 1) for _ in range(rng.randint(0, 3))] if depth < 4 else []
        if kind == "dict":
            return {k: value(depth + 1) for k in ("a", "b", 'q"x', "c d") if rng.random() < 0.7} if depth < 4 else {}
        return {"s": "x", "n": 1, "b": True, "0": None}[kind]

    values = [value(0) for _ in range(120)] + [None, 3, [1]]
    paths = ["a", "b", "a.a", "a.b", "a.a.a", "a.b.c d", "b.a", "b.b.b", "b[]", "a[]", "a[].a", "a[].b", "a[][]", "b[].a.b", 'q"x', 'q"x.a', 'q"x[].b', "c d", "c d.a[]", "c d[].a"]
    wanted = {p: rng.choice(["string", "number", "boolean", "array", "object", "null"]) for p in paths}
    found = schema_rules.mismatched_types(docs_of(spark, values), Settings({"field_types": wanted}))
    want = []
    for p, declared in wanted.items():
        seen = {}
        for row, v in enumerate(values, 1):
            for x in at_path(v, parse_path(p)) if isinstance(v, dict) else []:
                if KINDS[type(x)] != declared:
                    n, first = seen.get(KINDS[type(x)], (0, row))
                    seen[KINDS[type(x)]] = (n + 1, first)
        want += [(p.replace('"', '\\"'), k, n, first) for k, (n, first) in seen.items()]
    got = [(m[6 : m.index('" declared')], m.split("observed as ")[1].split(" ")[0], int(m.split(" in ")[-1].split(" ")[0]), r) for m, r in ((x.message, x.row) for x in found.collect())]
    assert sorted(got) == sorted(want) and len(want) > 40
    assert executed(found).count("Scan ExistingRDD") <= 2  # of the initial and the final plan


def test_rules_over_fields_share_one_profile(spark, monkeypatch):
    reads = []
    monkeypatch.setattr(schema_rules, "entries", lambda docs: reads.append(1) or entries(docs))
    values = [{"id": i, "v": i if i % 3 else str(i), **({"o": 1} if i % 9 else {})} for i in range(40)]
    docs, held = docs_of(spark, values), []
    found = lint_records(docs, Config(enable=("field-type-mixed-across-rows", "optional-field-required-by-downstream")), held)
    assert sorted(r.rule_id for r in found.collect()) == ["field-type-mixed-across-rows", "optional-field-required-by-downstream"]
    assert len(reads) == len(held) == 1
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 1
    release(held)
    assert not held and not spark.sparkContext._jsc.getPersistentRDDs()


def test_the_given_setting_is_in_the_message(spark):
    found = schema_rules.enum_drift(docs_of(spark, [{"l": "a"}, {"l": "b"}]), Settings({"lock_in_rows": -3}))
    assert [r.message for r in found.collect()] == ['field "l" gained value "b" not seen in the first -3 lock-in rows']


def test_names_of_chat_members_in_any_case(spark):
    values = [
        {"Messages": [{"Role": "assistant"}, {"ROLE": "assistant"}]},
        {"MESSAGES": [{"role": "assistant"}, {"role": "user"}], "messages": [{"role": "assistant"}, {"role": "assistant"}]},
        {"meſſages": [{"role": "assistant"}, {"role": "assistant"}]},
        {"Messages": [{"role": "assistant"}, {"Role": 3}]},
        {"Messages": {"role": "assistant"}},
        {"messages": [{"role": "user"}, {"Role": "tool", "Tool_Call_Id": "x"}]},
    ]
    docs = docs_of(spark, values)
    assert sorted(r.row for r in chat_rules.role_inversion(docs, Settings()).collect()) == [1, 2, 3]
    assert [r.row for r in chat_rules.unbalanced_tool_calls(docs, Settings()).collect()] == [6]


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("import random\ndef f(:\n    random.shuffle(a)\nset(b)\n", [("random.shuffle", 3, 5), ("set", 4, 1)]),
        ("class A:\n    def g(self):\n        x = foo(1,\n          2)\n        if x y:\n            bar(b)\n        else:\n            c.baz(d)\n", [("foo", 3, 13), ("bar", 6, 13), ("c.baz", 8, 13)]),
        ("f(\n  a b,\n  g(x),\n)\nh(y)\n", [("g", 3, 3), ("h", 5, 1)]),
        ("x = (1, 2\nimport os\nos.stat(y)\n", [("os.stat", 3, 1)]),
        ("x = '''abc\nf(a)\ng(h(b))", [("f", 2, 1), ("g", 3, 1), ("h", 3, 3)]),
        ("try:\n    f(a)\nexcept E\n    g(b)\nelse:\n    h(c)\n", [("f", 2, 5), ("g", 4, 5), ("h", 6, 5)]),
        ("é = f(a) b\né = g(é, h(b))\n", [("g", 2, 6), ("h", 2, 12)]),
        ("\x00\nf(a)\n", [("f", 2, 1)]),
        ("f(\n" * 400 + "g(x)\n", [("g", 401, 1)]),
        ("for x in f(y): z z\nwhile g(a):\n    b b\n    h(c)\n", [("g", 2, 7), ("h", 4, 5)]),
        ("not python at all", []),
        ("", []),
    ],
)
def test_code_around_what_does_not_parse(source, found):
    got = calls_of(source)
    assert [(c[0], c[2], c[3]) for c in got] == found
    raw = source.encode()
    assert all(raw[c[4] :].startswith(c[0].encode()) for c in got)


def test_a_source_that_parses_is_as_before():
    source = "import random\nfrom os import path\nrandom.shuffle(f(a))\n"
    assert calls_of(source) == [("random.shuffle", "shuffle", 3, 1, 34, 0, False, 2), ("f", "f", 3, 16, 49, 1, True, 2)]


@pytest.mark.parametrize("scheme", ["", "file://", "viewfs://fixes"])
def test_fixes_are_written_through_the_file_system_of_the_path(spark, tmp_path, scheme):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.fixes.link./in", f"file://{tmp_path}")
    text = b"import random\r\n# \xff\r\nrandom.shuffle(a)"
    path = tmp_path / "a.py"
    path.write_bytes(text)
    path.chmod(0o640)
    name = "viewfs://fixes/in/a.py" if scheme.startswith("viewfs") else f"{scheme}{path}"
    done = apply(lint_files(spark, [name], Config(enable=("random-seed-not-set",))))
    assert (done.files, done.edits) == (1, 1)
    assert path.read_bytes() == b"import random\r\nrandom.seed(0)\n# \xff\r\nrandom.shuffle(a)"
    assert path.stat().st_mode & 0o777 == 0o640 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.py"]


@pytest.mark.parametrize("form", ["json", "sarif", "html", "drops"])
def test_reports_are_written_by_their_tasks(spark, tmp_path, form):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    schema = found_schema(spark)
    rows = [(f"rule-{i % 3}", i % 3, f'message "{i}" <é>', f"p{i % 5}.jsonl", 0, i, 0, None) for i in range(1, 300)]
    for name, n in (("many", len(rows)), ("one", 1), ("none", 0)):
        found = spark.createDataFrame(rows[:n], schema).repartition(4)
        write_folder(found, form, f"{tmp_path}/{name}")
        files = sorted(p for p in (tmp_path / name).iterdir() if not p.name.startswith((".", "_")))
        text = "".join(p.read_text() for p in files)
        assert n < 300 - 1 or len([p for p in files if p.name.startswith("part-") and p.stat().st_size]) > 1
        whole = rendered(found, form)
        if form in ("json", "sarif"):
            assert json.loads(text) == json.loads(whole)
        elif form == "drops":
            assert text == whole
        else:
            cells = lambda t: sorted(x for x in t.replace("\n", "").replace("</table>", "").replace("<tr>", "\n<tr>").replace("<h2", "\n<h2").split("\n") if x.startswith("<tr>"))
            assert cells(text) == cells(whole) and text.count("<table>") == text.count("</table>") >= min(n, 3)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError, match="unknown format"):
        write_folder(found, "xml", f"{tmp_path}/x")


def found_schema(spark):
    return lint_records(docs_of(spark, ["bad"])).schema
