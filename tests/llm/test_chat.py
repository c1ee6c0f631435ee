import json
import random

import pytest

from pagemill.llm import chat as C
from tests.conftest import plan_of


def call(i, name="search", arguments=None, after=()):
    return {"id": i, "name": name, "arguments": {"query": "x"} if arguments is None else arguments, "depends_on": list(after)}


def message(*calls):
    return json.dumps({"tool_calls": list(calls), "content": None})


def result(i):
    return json.dumps({"tool_call_id": i, "content": {"b": 1, "a": [2]}})


ROWS = [
    (1, 0, "user", 'say "hé"\n', 1),
    (1, 1, "assistant", message(call("a"), call("b", "nope", {})), 1),
    (1, 2, "tool", result("a"), 1),
    (1, 3, "tool", result("zzz"), 1),
    (2, 0, "tool", result("late"), 1),
    (2, 5, "assistant", message(call("late", arguments='{"query": 3}')), 1),
    (3, 0, "assistant", message(call("second", after=["first"])), 1),
    (3, 4, "assistant", message(call("first", arguments="{")), 1),
    (4, 0, "assistant", message(call("x", after=["y"]), call("y", after=["x"])), 1),
    (5, 0, "assistant", '{"tool_calls": 3}', 1),
    (5, 1, "assistant", "{broken", 1),
    (6, 0, None, None, 1),
    (6, 1, "user", "", 1),
    (6, 1, "user", "", 1),
    (None, None, "tool", result("a"), 1),
]


def test_linking(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, state int")
    got = {}
    for r in C.format_chats(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    one = {k: v[0] for k, v in got.items()}
    states = {k: v["state"] for k, v in one.items()}
    assert states[1, 0] == "text" and states[1, 1] == "unanswered" and states[1, 2] == "linked" and states[1, 3] == "orphan"
    assert one[1, 1]["problems"] == "b:unknown_tool" and one[2, 5]["problems"] == "late:wrong_type"
    assert one[3, 4]["problems"] == "first:invalid_json"
    assert states[2, 0] == states[2, 5] == "linked" and states[4, 0] == "cycle" and states[None, None] == "orphan"
    assert states[5, 0] == states[5, 1] == "text"
    order = lambda r: (r["order_turn"], r["order_level"], r["order_part"])
    assert order(one[2, 5]) < order(one[2, 0]) and order(one[3, 4]) < order(one[3, 0])
    assert one[1, 0]["json"] == '{"content":"say \\"hé\\"\\n","role":"user"}'
    assert one[1, 2]["json"] == '{"content":"{\\"a\\":[2],\\"b\\":1}","name":"search","role":"tool","tool_call_id":"a"}'
    calls = json.loads(one[1, 1]["json"])["tool_calls"]
    assert calls[0] == {"arguments": '{"query":"x"}', "id": "a", "name": "search"}
    assert one[6, 0]["json"] == "{}" and len(got[6, 1]) == 2


def test_schema_check():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "s": {"enum": ["a"]}, "l": {"type": "array", "items": {"type": "string"}}}, "required": ["n"], "additionalProperties": False}
    assert C.check({"n": 1, "s": "a", "l": ["x"]}, schema) == "ok"
    assert C.check({}, schema) == "missing_argument"
    assert C.check({"n": True}, schema) == "wrong_type"
    assert C.check({"n": 1, "s": "b"}, schema) == "not_in_enum"
    assert C.check({"n": 1, "q": 1}, schema) == "unknown_argument"
    assert C.check({"n": 1, "l": [1]}, schema) == "wrong_type"


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_chats(df).count() == 0


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["turn"]): r for r in C.format_chats(df).collect()}


def test_hostile_json(spark):
    half = '{"tool_calls": [{"id": "x\\ud800", "name": "search", "arguments": {"query": "\\udfff"}}], "content": "\\ud83d"}'
    rows = [
        (1, 0, "assistant", half),
        (1, 1, "tool", '{"tool_call_id": "x\\ud800", "content": ["\\udc00", "\\ud83d\\ude00"]}'),
        (2, 0, "assistant", '{"tool_calls": [{"id": "n", "name": "search", "arguments": "{\\"query\\": NaN}"}]}'),
        (2, 1, "assistant", '{"tool_calls": [{"id": "i", "name": "search", "arguments": {"query": 1e999}}]}'),
        (2, 2, "tool", '{"tool_call_id": "n", "content": -Infinity}'),
        (2, 3, "assistant", '{"tool_calls": [' + "[" * 100_000),
        (2, 4, "assistant", '{"tool_calls": [{"id": "d", "name": "search", "arguments": ' + '{"a":' * 900 + "1" + "}" * 900 + "}]}"),
    ]
    got = formatted(spark, rows)
    for r in got.values():
        json.loads(r["json"], parse_constant=lambda name: pytest.fail(name))
    assert got[1, 0]["state"] == got[1, 1]["state"] == "linked"
    inner = json.loads(got[1, 1]["json"])["content"]
    assert inner == '["\\udc00","\U0001f600"]'
    assert got[2, 0]["problems"] == "n:invalid_json" and got[2, 1]["state"] == got[2, 2]["state"] == got[2, 3]["state"] == "text"


def test_first_call_of_an_id_names_the_result(spark):
    rows = [(1, 0, "assistant", message(call("a", "fetch", {"url": "u"}), call("a", "search"))), (1, 1, "tool", result("a"))]
    assert json.loads(formatted(spark, rows)[1, 1]["json"])["name"] == "fetch"


def plain_levels(calls):
    """Longest way down the dependencies of ``{id: (turn, depends)}``; None on or behind a cycle."""
    out = {}

    def visit(i, above):
        if i in above:
            return None
        if i not in out:
            found = [visit(d, above | {i}) for d in calls[i][1] if d in calls]
            if any(f is None for f in found):
                return None
            out[i] = (1 + max((f[0] for f in found), default=-1), max([calls[i][0], *(f[1] for f in found)]))
        return out[i]

    return {i: visit(i, frozenset()) or (-1, t) for i, (t, _) in calls.items()}


@pytest.mark.parametrize("most", [3, 100_000])
def test_random_dependencies_equal_a_plain_version(spark, most):
    draw = random.Random(4)
    rows, want = [], {}
    for conv in range(12):
        calls = {}
        for k in range(draw.randrange(1, 14)):
            calls[f"c{k}"] = (draw.randrange(9), draw.sample([f"c{j}" for j in range(16)], draw.randrange(3)) if conv % 4 else [f"c{j}" for j in range(k)][-2:])
        rows += [(conv, i, t, d) for i, (t, d) in calls.items()]
        want |= {(conv, i): x for i, x in plain_levels(calls).items()}
    df = spark.createDataFrame(rows, "conv_id long, id string, call_turn long, depends_on array<string>")
    assert {(r["conv_id"], r["id"]): (r["level"], r["order_turn"]) for r in C.placed_calls(df, most).collect()} == want


def test_deep_chain(spark):
    rows = [(7, k, "assistant", message(call(f"c{k}", after=[f"c{k + 1}"]))) for k in range(1000)]
    got = formatted(spark, rows)
    assert {r["order_level"] for r in got.values()} == set(range(1000))
    assert got[7, 0]["order_level"] == 999 and got[7, 0]["order_turn"] == 999


def test_plain_messages_meet_no_join(spark):
    """All messages of one conversation without a call: none is shuffled by (conversation, null)."""
    df = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(50)], "conv_id long, turn long, role string, text string")
    plan = plan_of(C.format_chats(df))
    text = [part for part in plan.split("Union")[-1].split("\n") if "= text" in part or "Join" in part]
    assert not any("Join" in line for line in text[-1:])
    assert C.format_chats(df).count() == 50
