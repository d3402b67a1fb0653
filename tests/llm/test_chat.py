import json

import pytest

from postlark.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string, content string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}}}}


@pytest.mark.parametrize("value, errors", [({"a": 1}, 0), ({"a": True}, 1), ({}, 1), ({"a": -1, "b": 1}, 2), ({"a": 1, "tags": ["x", 2]}, 1), ([], 1)])
def test_schema(value, errors):
    assert len(chat.schema_errors(value, SCHEMAS["add"])) == errors


def test_link(spark):
    chain = [(2, f"c{i}", i, "add", '{"a": 1}', f"c{i - 1}" if i else None, "x") for i in range(40)]
    calls = [(1, "x", 1, "add", '{ "tags": ["ü"], "a":1}', None, "-"), (1, "x", 3, "add", "{}", None, "-"), (1, "y", 2, "sub", "[]", "x", "-"), (1, "z", 4, "add", "not json", "gone", "-"),
             (3, "p", 1, "add", '{"a": 1}', "q", "-"), (3, "q", 2, "add", '{"a": 1}', "p", "-"), (None, "n", 1, "add", '{"a": 2}', None, "-"), (1, None, None, None, None, None, None)]
    results = [(1, "x", 2, "three"), (1, "x", 1, "two"), (1, "nobody", 5, "lost"), (2, "c5", 9, None), (None, None, None, None)]
    out = chat.link_calls(spark.createDataFrame(calls + chain, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    by = {(r.conv_id, r.call_id, r.status): r for r in out}
    x = by[1, "x", "linked"]
    assert (x.turn, x.result_turn, x.depth, x.valid, x.copies_of_call, x.copies_of_result) == (1, 1, 1, True, 2, 2)
    assert x.json == '{"arguments":{"a":1,"tags":["ü"]},"id":"x","name":"add","result":"two","status":"linked"}'
    assert by[1, "y", "unanswered"].depth == 2 and by[1, "y", "unanswered"].errors == "$: no such tool"
    assert by[1, "z", "unanswered"].depth == 1 and json.loads(by[1, "z", "unanswered"].json)["arguments"] == "not json"
    assert by[1, "nobody", "orphan"].result_turn == 5 and by[1, "nobody", "orphan"].valid is None
    assert by[3, "p", "unanswered"].depth is None and by[3, "q", "unanswered"].depth is None
    assert by[2, "c5", "linked"].depth == 6
    assert [by[2, f"c{i}", "linked" if i == 5 else "unanswered"].depth for i in range(40)] == list(range(1, 41))
    assert sum(r.status == "anonymous" for r in out) == 3


@pytest.mark.parametrize("at_once", [2, 1000])
def test_every_call_and_result_has_its_row(spark, monkeypatch, at_once):
    monkeypatch.setattr(chat, "COPIES_AT_ONCE", at_once, raising=False)
    calls = [(1, "x", 1, "add", '{"a": 1}', None, "-")] * 6 + [(1, "x", 3, "add", '{"a": 2}', None, "-")] * 2 + [(1, "x", 3, None, None, None, "-"), (1, "y", 1, "add", "{}", "x", "-"), (None, "x", 1, "add", "{}", None, "-")]
    results = [(1, "x", 2, "one")] * 3 + [(1, "x", 4, "two"), (1, "w", 2, None), (1, "w", 2, None), (1, "w", 3, "z"), (1, None, 3, "z")]
    out = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    called = [(r.conv_id, r.call_id, r.turn, r.name, json.loads(r.json)["arguments"]) for r in out if r.turn is not None]
    assert sorted(called, key=str) == sorted([(c, i, t, n, a and json.loads(a)) for c, i, t, n, a, _, _ in calls], key=str)
    answered = [(r.conv_id, r.call_id, r.result_turn, json.loads(r.json)["result"]) for r in out if r.result_turn is not None]
    assert sorted(answered, key=str) == sorted(results, key=str)
    assert len(out) == len(calls) + len(results) - 1
    status = [r.status for r in out]
    assert (status.count("linked"), status.count("duplicate"), status.count("orphan"), status.count("anonymous")) == (1, 8, 6, 2)


def test_exchanges(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (2, 0, "assistant", "first"), (3, 0, "user", "do"),
             (3, 1, "assistant", '{"tool_calls": [{"id": "t1", "name": "add", "arguments": "{\\"a\\": 4}"}]}'), (3, 2, "tool", '{"tool_call_id": "t1", "content": "5"}'), (3, 3, "assistant", "five"), (None, None, None, None)]
    calls, results = chat.exchanges(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = {(r.conv_id, r.call_id): r for r in chat.link_calls(calls, results, SCHEMAS | chat.REPLY_SCHEMAS).collect()}
    assert out[1, "1"].status == "linked" and out[1, "1"].valid and json.loads(out[1, "1"].json)["arguments"] == {"prompt": "hi", "turn": 1, "system": "be kind"}
    assert out[1, "3"].status == "unanswered" and out[1, "3"].depth == 2 and not out[1, "3"].valid
    assert out[2, None].status == "anonymous" and out[3, "t1"].status == "linked" and out[3, "0"].result_turn == 3
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link_calls(*chat.exchanges(empty), SCHEMAS).count() == 0


def test_lone_surrogates_unknown_types_and_long_conversations(spark, monkeypatch):
    calls = spark.createDataFrame([("c", "1", 0, "t", '{"a":"\\ud800"}', None), ("c", "2", 1, "odd", "{}", None)], "conv_id string, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    got = {r.call_id: r for r in chat.link_calls(calls, results, {"t": {"type": "object"}, "odd": {"type": "nothing known"}}).collect()}
    assert "\\ud800" in got["1"].json and got["1"].valid and got["2"].errors == "$: not nothing known"
    turns = [("c", t, ("system", "user", "assistant", "user", "assistant", "assistant")[t % 6], f"text {t}") for t in range(60)] + [(None, 0, "user", "x"), (None, 1, "assistant", "y")]
    table = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    whole = [sorted(map(str, t.collect())) for t in chat.exchanges(table)]
    monkeypatch.setattr(chat, "TURNS", 4)
    assert [sorted(map(str, t.collect())) for t in chat.exchanges(table)] == whole
