"""Tool calls that are no text or no JSON never end a job; schemas are obeyed or refused."""

import json
import random

import pytest

from tidemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_turns_of_any_kind(spark):
    rng = random.Random(2)
    bits = ['{"id":"a"', '"\\ud800"', '"\\udc00x"', "\\ud83d\\ude00", ',"name":"search"', ',"arguments":{"query":"\\ud800"}', "}", "[", "NaN", "1e999", '"tool_call_id":"a"', ":", ",", "<tool_call>", "</tool_call>", '"content":"\\uDBFF"', "null", "\x00", "é", "{" * 3000]
    rows = [(i, t, rng.choice(["assistant", "tool", "user", None]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(150) for t in range(3)]
    rows += [(1000, 0, "assistant", '<tool_call>{"id":"\\ud800","name":"search","arguments":{"query":"x"}}</tool_call>'), (1000, 1, "tool", '{"tool_call_id":"a","content":"\\ud800"}'), (1000, 2, "assistant", '<tool_call>{"id":"b","name":"search","arguments":"{\\"query\\":\\"\\\\udfff\\"}"}</tool_call>'), (1000, 3, "assistant", '<tool_call>{"id":"c","name":"search","arguments":{"query":"\\ud83d\\ude00"}}</tool_call>')]
    got = chat.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.turn) for r in got} == {(c, t) for c, t, _, _ in rows}
    own = {(r.turn, r.kind): r for r in got if r.conv_id == 1000}
    assert [own[t, "message"].status for t in range(4)] == ["malformed", "malformed", "malformed", "ok"]
    assert json.loads(own[3, "call"].json)["arguments"] == {"query": "😀"} and len(own) == 5


def test_schemas():
    for schema, good, bad in (
        ({"enum": [1]}, [1], [True, 1.5, "1"]),
        ({"type": "integer"}, [1, 1.0, -3], [1.5, True, "1"]),
        ({"type": ["number", "null"]}, [1.5, 2, None], [True, "x"]),
        ({"const": {"a": [1]}}, [{"a": [1]}], [{"a": [True]}, {"a": [2]}]),
        ({"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string"}}, [["a"], ["a", "b"]], [[], ["a", "b", "c"], [1]]),
        ({"type": "object", "properties": {"a": False}, "additionalProperties": {"type": "string"}}, [{}, {"b": "x"}], [{"a": 1}, {"b": 1}]),
    ):
        chat.obeyed(schema)
        assert all(chat.valid(x, schema) for x in good) and not any(chat.valid(x, schema) for x in bad), schema
    for schema in ({"pattern": "a"}, {"properties": {"a": {"anyOf": []}}}, {"items": {"$ref": "#"}}, {"type": "text"}, 5):
        with pytest.raises(ValueError):
            chat.obeyed(schema)
