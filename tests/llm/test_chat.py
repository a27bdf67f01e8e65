import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strider.llm import chat

TRICKY = ["", "\\", "\\\\", "\\l", "\\b", "\\n", "a\nb", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<<SYS>>\\<</SYS>>", "<", "[", "<s", "é\U0001f600", "\r\n\t", "\\\\l<s>\\", "[/INST][INST]"]


def back(spark, convs):
    rows = [(i, k, r, t) for i, turns in enumerate(convs) for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    return {r["conv_id"]: r for r in chat.digest(chat.format_records(chat.conversations(df)).select("conv_id", "formatted")).collect()}


def check(got, turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    assert got["n_turns"] == len(turns)
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got["loss_chars"], got["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_round_trip(spark):
    convs = [[("user", a), ("assistant", b)] for a in TRICKY for b in TRICKY] + [[("system", TRICKY[7]), ("user", "x"), ("assistant", TRICKY[8])], [(None, None)], [("assistant", "a"), ("assistant", "b")], [("we<|im_end|>ird\nrole", "t")], [("user", "x" * 200_000), ("assistant", "<s>" * 50_000)]]
    got = back(spark, convs)
    for i, turns in enumerate(convs):
        check(got[i], turns)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.text(alphabet="<|im_startend>[]/INST\\lbn\n é", max_size=30)), min_size=1, max_size=6), min_size=20, max_size=20))
def test_round_trip_of_any_text(spark, convs):
    got = back(spark, convs)
    for i, turns in enumerate(convs):
        check(got[i], turns)


def test_no_control_string_is_left_in_a_body(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY + ["".join(chat.CONTROL)]], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


@pytest.mark.parametrize("record,mapping,turns", [
    ('{"messages":[{"role":"user","content":"a"},{"content":null,"role":"assistant"}]}', "messages", [("user", "a"), ("assistant", "")]),
    ('{"chat":[{"text":"a","role":"u"}],"id":7}', "chat", [("u", "a")]),
    ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "sharegpt", [("user", "a"), ("assistant", "b")]),
    ('{"prompt":"a","completion":"b"}', "prompt", [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"a","input":"","output":"c"}', "instruction", [("user", "a"), ("assistant", "c")]),
    ('{"instruction":"a","input":"b","output":"c"}', "instruction", [("user", "a\n\nb"), ("assistant", "c")]),
    ('{"messages":[]}', "empty_messages", []),
    ('{"id":3,"messages":[{"role":"user","content":"a","name":"n"},{"role":"assistant","content":"b","name":null}]}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}', "parts", [("user", "ab")]),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a","image_url":null},{"type":"image","text":null,"image_url":"u"}]}]}', "parts", [("user", "a")]),
    ('{"system":"s","conversations":[{"from":"human","value":"a"}]}', "sharegpt_system", [("system", "s"), ("user", "a")]),
    ('{"turns":[{"speaker":"gpt","utterance":"a"}]}', "turns", [("assistant", "a")]), ('{"dialog":["a","b","c"]}', "dialog", [("user", "a"), ("assistant", "b"), ("user", "c")]),
    ('{"prompt":"a","chosen":"b","rejected":"c"}', "preference", [("user", "a"), ("assistant", "b")]), ('{"question":"a","answer":"b","id":1}', "question", [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"a","output":"c"}', "instruction", [("user", "a"), ("assistant", "c")]), ('{"system":"s","prompt":"a","completion":"b"}', "system_prompt", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ('{"prompt":"a","response":"b"}', "response", [("user", "a"), ("assistant", "b")]),
    ('{"unknown":1}', None, None),
    ("not json", None, None),
])
def test_layouts(spark, record, mapping, turns):
    r = chat.canonical(spark.createDataFrame([(record,)], "j string").select(F.try_parse_json("j").alias("record"))).first()
    assert r["mapping"] == mapping
    assert (None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) == turns


def test_order_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "b", "2"), (1, None, "z", "0"), (1, 1, "a", "1"), (1, 1, "b", "2")], "conv_id long, turn long, role string, text string")
    got = chat.format_records(chat.conversations(df)).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("z", "0"), ("a", "1"), ("b", "2"), ("b", "2")]
    assert chat.digest(chat.format_records(chat.conversations(df.limit(0))).select("conv_id", "formatted")).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 1, "b", "2")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_records(chat.conversations(df)).select("conv_id", "formatted"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_conversations_are_linear(spark):
    """Offsets across blocks are right, and four times the turns take no sixteen times as long."""
    took = {}
    for n in (2000, 8000, 32_000):
        turns = [(("user", "assistant", "assistant")[k % 3], f"é{k}<s>") for k in range(n)]
        rows = spark.range(n).selectExpr("1L conv_id", "id turn", "element_at(array('user', 'assistant', 'assistant'), int(id % 3) + 1) role", "concat('é', id, '<s>') text").repartition(1).cache()
        rows.count()
        began = time.time()
        check(chat.digest(chat.format_records(chat.conversations(rows)).select("conv_id", "formatted")).first(), turns)
        took[n] = time.time() - began
    assert took[32_000] < 8 * took[8000] + 1


def test_every_layout_is_used_and_the_rest_is_counted(spark):
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["assistant", "user"], ["tool", "user"]]
    rows = [(10 * i + k, j, r, f"text {j}") for i in range(12) for k, shape in enumerate(shapes) for j, r in enumerate(shape)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["mapping"] for r in chat.format_records(chat.conversations(df)).collect()}
    assert got == {"prompt", "instruction", "question", "system_prompt", "dialog", "sharegpt", "messages", "parts", "chat"}
    records = spark.createDataFrame([('{"a":1}',), ('{"a":2}',), ('{"prompt":"x","completion":"y"}',), ('{"b":[1]}',)], "j string").select(F.try_parse_json("j").alias("record"))
    assert sorted((r["layout"], r["n_records"]) for r in chat.unmapped(records).collect()) == [("OBJECT<a: BIGINT>", 2), ("OBJECT<b: ARRAY<BIGINT>>", 1)]


def test_rows_without_a_conversation_id_are_one(spark):
    df = spark.createDataFrame([(None, 2, "assistant", "b"), (None, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.format_records(chat.conversations(df)).select("conv_id", "formatted")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(None, 2)]
    check(got[0], [("user", "a"), ("assistant", "b")])
