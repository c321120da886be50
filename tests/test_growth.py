"""Rows of one field or file stay spread over tasks, and a line is parsed once."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.config import Settings
from siftline.functions.json_values import PathTree, kinds_at
from siftline.operators import schema_rules
from siftline.plans import diff
from siftline.sources.jsonl import records, table_records


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)


def lines(spark, texts):
    rows = [("a", 0, i + 1, t) for i, t in enumerate(texts)]
    return records(spark.createDataFrame(rows, "path string, path_ord int, row long, line string"))


def test_rows_of_one_field_are_not_exchanged(spark, no_broadcast):
    docs = table_records(spark.range(40), F.col("id"), "t", F.when(F.col("id") == 30, "z").otherwise("a").alias("e"))
    drift = schema_rules.enum_drift(docs, Settings({"lock_in_rows": 3}))
    assert [r.row for r in drift.collect()] == [30]
    top = diff.top_values(diff.shared_strings(diff.members(docs.where("row % 2 = 0"), docs.where("row % 2 = 1"))))
    assert sorted((r.side, r.v, r.n) for r in top.collect()) == [("new", "a", 20), ("old", "a", 19), ("old", "z", 1)]
    for found in (drift, top):
        assert "BroadcastHashJoin" in plan_of(found) and "SortMergeJoin" not in plan_of(found)


def test_rows_of_one_file_are_not_exchanged(spark, no_broadcast):
    found = schema_rules.optional_fields(lines(spark, ['{"a": 1}' if i == 6 else '{"a": 1, "b": 2}' for i in range(20)]), Settings())
    assert [r.row for r in found.collect()] == [7]
    assert "BroadcastHashJoin [" in plan_of(found)


def test_a_line_is_parsed_once(spark):
    texts = ['{"k": "x"}', "[1] [2]", "", None, "null", "1e999", '{"k": 1}', '{"k": 1, "k": 2}', "[1]", '"s"', "true", "2.5"]
    docs = lines(spark, texts).where("tag = 'object'").select("row", "tag", F.to_json("doc").alias("doc"))
    assert [(r.row, json.loads(r.doc)) for r in docs.orderBy("row").collect()] == [(1, {"k": "x"}), (7, {"k": 1}), (8, {"k": 2})]
    assert plan_of(docs).split("Initial Plan")[0].count("parseJson") == 1
    kinds = {r.row: r.tag for r in lines(spark, texts).collect()}
    assert kinds == {1: "object", 2: None, 3: None, 4: None, 5: "null", 6: None, 7: "object", 8: "object", 9: "array", 10: "string", 11: "boolean", 12: "number"}


def test_paths_end_at_wrong_shapes(spark):
    docs = lines(spark, ['[{"k": 1}]', '"k"', "3", "null", '{"k": [1]}', '{"k": {"m": "s"}}'])
    got = docs.select("row", F.transform(kinds_at(F.col("doc"), PathTree.of(["k.m"])), lambda x: x.kind).alias("kinds")).collect()
    assert {r.row: r.kinds for r in got} == {1: [], 2: [], 3: [], 4: [], 5: [], 6: ["string"]}
