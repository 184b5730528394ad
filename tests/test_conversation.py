import pytest
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.operators import messages as M
from casebook.fixed_values import NO_CONTEXT_MESSAGE
from casebook.operators.routing import dispatch_tool_calls, route
from casebook.schemas import MESSAGE, TOOL_CALLS

LOG = "conv_id bigint, msg_id string, seq bigint, role string, text string"


def test_upsert_replaces_in_place(spark):
    log = spark.createDataFrame([(1, "a", 0, "user", "x"), (1, "b", 1, "assistant", "y")], LOG)
    new = spark.createDataFrame([(1, "a", 5, "user", "x2"), (1, "c", 6, "user", "z"), (1, "a", 7, "user", "x3")], LOG)
    got = [(r.msg_id, r.text) for r in M.upsert(log, new).orderBy("position").collect()]
    assert got == [("a", "x3"), ("b", "y"), ("c", "z")]


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "user", "hi"),
        (1, 2, "assistant", "hello"),
        (1, 3, "assistant", "bye"),
        (2, 0, "user", " ﻿ "),
        (2, 1, "system", "clear"),
        (2, 2, "user", "again"),
    ]
    return spark.createDataFrame(rows, MESSAGE).repartition(4)


def test_prepend_system(log):
    got = M.prepend_system(log, "P").orderBy("conv_id", "turn").collect()
    assert len(got) == 8
    assert [(r.turn, r.role, r.text) for r in got if r.turn == -1] == [(-1, "system", "P")]
    assert {r.conv_id for r in got if r.turn == -1} == {2}


def test_last_answer(log):
    got = {r.conv_id: r.answer for r in M.last_answer(log).collect()}
    assert got == {1: "bye", 2: V.NO_ANSWER_MESSAGE}


def test_history_pages_join_to_whole(log):
    pages = M.history_pages(log, 2).orderBy("conv_id", "page").collect()
    assert max(len(p.messages) for p in pages) == 2
    assert [m.turn for p in pages if p.conv_id == 1 for m in p.messages] == [0, 1, 2, 3]


def test_clear_history(log):
    got = M.clear_history(log, F.col("text") == "clear")
    assert sorted((r.conv_id, r.turn) for r in got.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 2)]


def test_blank_and_bot(log):
    assert log.count() - M.drop_blank(log).count() == 1
    assert {r.conv_id: r.has_bot for r in M.has_bot(log).collect()} == {1: True, 2: False}


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Xin chào!", "direct"),
        ("Cảm ơn bạn nhiều", "direct"),
        ("Tóm tắt lại câu trả lời vừa rồi", "direct"),
        ("Đánh bài phạt bao nhiêu tiền?", "retrieve"),
        ("Điều 472 quy định gì?", "retrieve"),
        ("Hôm nay trời đẹp", "direct"),
    ],
)
def test_default_routes(one, text, expected):
    assert one(route(F.lit(text))) == expected


def test_tool_dispatch(spark):
    def call(name, query, cid):
        return (name, {"query": query}, cid)

    rows = [
        (1, 1, []),
        (1, 2, [call("rag_retrieval", "q1", "c1")]),
        (1, 3, [call("other", "q1", "c2")]),
        (1, 4, [call("rag_retrieval", "q2", None), call("other", "q", "x"), call("rag_retrieval", "q1", "c4")]),
        (1, 5, [call("rag_retrieval", "q9", "c5"), call("rag_retrieval", None, "c6")]),
    ]
    messages = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, tool_calls {TOOL_CALLS}")
    results = spark.createDataFrame([("q1", "r1"), ("q2", "r2")], "query string, result string")
    got = dispatch_tool_calls(messages, results).orderBy("turn", "call_no").collect()
    assert [(r.turn, r.call_no, r.tool_call_id, r.content) for r in got] == [
        (2, 0, "c1", "r1"),
        (4, 0, "", "r2"),
        (4, 2, "c4", "r1"),
        (5, 0, "c5", NO_CONTEXT_MESSAGE),
        (5, 1, "c6", NO_CONTEXT_MESSAGE),
    ]
