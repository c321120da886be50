import random

from pyspark.sql import functions as F

from siftline.llm.chat import canonical_turns, format_chat, gather, loss_text, read_back, with_fingerprint

ROWS = "conv_id long, turn long, role string, text string, layout string"
HARD = ["\\### Assistant: </turn> ok", "###", "####", "\\\\###", "</turn>", "\n</turn>\n", "\\</turn>\\", "### user:\nx\n</turn>\n", "", "ends with \\", "#\\#\\##", "é𝒜\n\n"]


def test_formatted_conversations_read_back(spark):
    rng = random.Random(6)
    alphabet = ["#", "##", "\\", "</turn>", "\n", "a", "é", "### ", ":"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd role:\n", None]), rng.choice([*HARD, None, "".join(rng.choice(alphabet) for _ in range(9))]), "x") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id", "x"), (7, None, "assistant", "null turn", "x"), (8, 2, "user", "tie", "x"), (8, 2, "user", "tie", "x"), (None, None, None, None, None)]
    chats = gather(spark.createDataFrame(rows, ROWS).repartition(4))
    done = format_chat(chats).withColumns({"turns": read_back(F.col("formatted")), "learnt": loss_text(F.col("formatted"), F.col("loss"))}).collect()
    by, alone = {}, []
    for c, t, role, text, _ in rows:
        said = (-(2**62) if t is None else t, role or "", text or "")
        if c is None:  # a conversation by itself
            alone.append([said[1:]])
        else:
            by.setdefault(c, []).append(said)
    assert sorted([(t.role, t.text) for t in r.turns] for r in done if r.conv_id is None) == sorted(alone)
    done = [r for r in done if r.conv_id is not None]
    assert len(done) == len(by)
    for r in done:
        expected = sorted(by[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in expected]
        assert r.learnt == "".join(text for _, role, text in expected if role == "assistant")
        plain = "".join(r.formatted[s.start : s.stop] for s in r.loss)
        assert "\n</turn>\n" not in plain


def test_layouts_meet_in_canonical_turns(spark, tmp_path):
    records = [
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "other": 1}',
        '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}',
        '{"prompt": "hi", "completion": "yo"}', '{"prompt": "hi", "response": "yo"}', '{"question": "hi", "answer": "yo"}',
        '{"instruction": "hi", "input": "more", "output": "yo", "system": "be brief"}', '{"instruction": "hi", "output": "yo"}', '{"unknown": 3}', '{"prompt": "hi"}',
    ]
    path = tmp_path / "r.json"
    path.write_text("\n".join(records))
    got = canonical_turns(spark.read.json(str(path)).coalesce(1)).collect()
    plain = [r.turns and [(t.role, t.text) for t in r.turns] for r in got]
    both = [("user", "hi"), ("assistant", "yo")]
    assert plain == [both] * 5 + [[("system", "be brief"), ("user", "hi\n\nmore"), ("assistant", "yo")], both, None, [("user", "hi")]]
    assert [r.layout for r in got][:3] == ["messages", "from and value", "prompt and completion"]
    marks = [r.fingerprint for r in with_fingerprint(spark.read.json(str(path)).coalesce(1)).collect()]
    assert marks[2] != marks[3] and marks[5] != marks[6]


def test_roles_of_plain_rows_stand(spark):
    rows = [(1, 0, "Human", "a", "x"), (1, 1, "gpt", "b", "x"), (1, 2, "assistant", "c", "x")]
    (r,) = format_chat(gather(spark.createDataFrame(rows, ROWS))).withColumns({"turns": read_back(F.col("formatted")), "learnt": loss_text(F.col("formatted"), F.col("loss"))}).collect()
    assert [t.role for t in r.turns] == ["Human", "gpt", "assistant"] and r.learnt == "c"


def test_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("9 conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('é ', id, ' ### \\n') text", "'x' layout")
    (r,) = format_chat(gather(rows)).withColumns({"turns": read_back(F.col("formatted")), "learnt": loss_text(F.col("formatted"), F.col("loss"))}).collect()
    assert len(r.turns) == n and r.learnt == "".join(f"é {i} ### \n" for i in range(1, n, 2))
    assert all(r.formatted[s.start : s.stop] == f"é {2 * k + 1} \\### \n" for k, s in enumerate(r.loss))


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert format_chat(gather(empty)).count() == 0
