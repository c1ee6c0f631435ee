"""Chat formatting with linked tool calls.

An assistant message whose text is a JSON object with ``tool_calls`` makes calls; a message of role ``tool`` whose text is
a JSON object with ``tool_call_id`` is a result. Calls and results are joined by conversation and identifier, calls
that name others in ``depends_on`` come after them, arguments are checked against schemas, and every message becomes one
line of canonical JSON: keys in order, no white space, nulls left out.

Output rows carry keys to order a conversation by instead of its whole text, so a conversation of any length is never
in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import connected_components, saved, slices
from pagemill.operators.joins import lookup_join

TYPES = {
    "string": str,
    "boolean": bool,
    "object": dict,
    "array": list,
    "integer": int,
    "number": (int, float),
    "null": type(None),
}
# Tools of the registered query: name to JSON schema of the arguments.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]},
}
CALL = "struct<id: string, name: string, arguments: string, depends_on: array<string>, state: string>"
PARSED = f"kind string, content string, calls array<{CALL}>, result_of string"


SURROGATE = re.compile("[\ud800-\udfff]")  # half a character, which an escape can name alone
COMPONENT_CALLS = 100_000  # calls that hang together by their dependencies, placed in one task; narrow rows


def canonical(value) -> str:
    """JSON with sorted keys and no white space; half characters stay escapes."""
    plain = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", plain)


def strict(text: str):
    """The value of a JSON text. ``NaN``, infinities and numbers that would become one are no JSON."""

    def finite(number: str) -> float:
        value = float(number)
        if math.isinf(value):
            raise ValueError(number)
        return value

    def refused(name: str):
        raise ValueError(name)

    return json.loads(text, parse_float=finite, parse_constant=refused)


def whole(value) -> str | None:
    """A value as text: strings as they are, half characters replaced, anything else as JSON."""
    return value if value is None else SURROGATE.sub("\ufffd", value) if isinstance(value, str) else canonical(value)


def check(value, schema: Mapping) -> str:
    """``ok`` or what is wrong: ``wrong_type``, ``missing_argument``, ``unknown_argument`` or ``not_in_enum``."""
    kind = schema.get("type")
    if kind in TYPES:
        fits = isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))
        if not fits:
            return "wrong_type"
    if "enum" in schema and value not in schema["enum"]:
        return "not_in_enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(name not in value for name in schema.get("required", ())):
            return "missing_argument"
        if schema.get("additionalProperties") is False and any(name not in known for name in value):
            return "unknown_argument"
        states = [check(value[name], part) for name, part in sorted(known.items()) if name in value]
        return next((s for s in states if s != "ok"), "ok")
    if isinstance(value, list) and "items" in schema:
        return next((s for s in (check(x, schema["items"]) for x in value) if s != "ok"), "ok")
    return "ok"


def _call(call, schemas: Mapping[str, Mapping]) -> dict:
    """One call in plain form; its state says whether the arguments fit the schema of its tool."""
    call = call if isinstance(call, dict) else {}
    function = call.get("function") if isinstance(call.get("function"), dict) else call
    name, arguments = function.get("name"), function.get("arguments", {})
    state = "ok"
    if isinstance(arguments, str):
        try:
            arguments = strict(arguments)
        except (ValueError, RecursionError):
            state = "invalid_json"
    if state == "ok":
        state = check(arguments, schemas[name]) if isinstance(name, str) and name in schemas else "unknown_tool"
    depends = call.get("depends_on")
    return {
        "id": whole(call.get("id")),
        "name": whole(name),
        "arguments": canonical(arguments),
        "depends_on": [whole(d) for d in depends if d is not None] if isinstance(depends, list) else [],
        "state": state,
    }


def parse(role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> dict:
    """Kind of a message (``text``, ``calls`` or ``result``), what it says, its calls, and the call it answers."""
    plain = {"kind": "text", "content": text, "calls": [], "result_of": None}
    if role not in ("assistant", "tool") or not (text or "").lstrip().startswith("{"):
        return plain
    try:
        value = strict(text)
        if role == "assistant" and isinstance(value.get("tool_calls"), list):
            calls = [_call(c, schemas) for c in value["tool_calls"]]
            return {"kind": "calls", "content": whole(value.get("content")), "calls": calls, "result_of": None}
        if role == "tool" and isinstance(value.get("tool_call_id"), str):
            content = value.get("content")
            content = whole(content) if isinstance(content, str) else canonical(content)
            return {"kind": "result", "content": content, "calls": [], "result_of": whole(value["tool_call_id"])}
    except (ValueError, RecursionError):
        pass
    return plain


def parsed_messages(messages: DataFrame, schemas: Mapping[str, Mapping] = SCHEMAS) -> DataFrame:
    """``conv_id, turn, role`` and the parsed text; map-only."""
    schemas = dict(schemas)

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        text = pa.string()
        call = pa.struct(
            [("id", text), ("name", text), ("arguments", text), ("depends_on", pa.list_(text)), ("state", text)]
        )
        for batch in slices(batches):
            found = [
                parse(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            kinds = {"kind": text, "content": text, "calls": pa.list_(call), "result_of": text}
            columns = [pa.array([f[name] for f in found], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns], names=["conv_id", "turn", "role", *kinds]
            )

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text")
    return rows.mapInArrow(read, f"conv_id long, turn long, role string, {PARSED}")


def call_levels(calls: DataFrame) -> DataFrame:
    """Topological levels of ``calls`` (``conv_id, id, depends_on``): ``conv_id, id, level``, -1 on or behind a cycle.

    Level 0 depends on nothing that is there; every round takes the calls whose dependencies have all been placed.
    """
    known = calls.select("conv_id", "id")
    waits = calls.select("conv_id", "id", F.explode(F.array_distinct("depends_on")).alias("before"))
    waits = waits.join(known.withColumnRenamed("id", "before"), ["conv_id", "before"], "left_semi")
    waits = saved(waits)
    placed = saved(known.join(waits, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)))
    newest, level, left = placed, 0, waits
    while not left.isEmpty():
        level += 1
        done = newest.select("conv_id", F.col("id").alias("before"))
        rest = saved(left.join(done, ["conv_id", "before"], "left_anti"))
        ready = left.select("conv_id", "id").distinct().join(rest, ["conv_id", "id"], "left_anti")
        newest = saved(ready.withColumn("level", F.lit(level)))
        if newest.isEmpty():
            cycle = rest.select("conv_id", "id").distinct().withColumn("level", F.lit(-1))
            return placed.unionByName(cycle)
        placed, left = placed.unionByName(newest), rest
    return placed


def _place(table):
    """Arrow function over the calls of one component: levels and raised turns, dependencies first."""
    import pyarrow as pa

    ids, turns = table.column("id").to_pylist(), table.column("call_turn").to_pylist()
    waits = {i: {d for d in depends or []} for i, depends in zip(ids, table.column("depends_on").to_pylist(), strict=True)}
    waits = {i: {d for d in depends if d in waits} for i, depends in waits.items()}
    followers: dict[str, list[str]] = {}
    for i, depends in waits.items():
        for d in depends:
            followers.setdefault(d, []).append(i)
    own = dict(zip(ids, turns, strict=True))
    left = {i: len(depends) for i, depends in waits.items()}
    level, turn = dict.fromkeys(ids, -1), dict(own)
    ready = [i for i, n in left.items() if not n]
    level.update(dict.fromkeys(ready, 0))
    latest = lambda a, b: a if b is None else b if a is None else max(a, b)
    deepest: dict[str, int] = {}
    for i in ready:  # grows while it is walked
        for f in followers.get(i, ()):
            deepest[f] = max(deepest.get(f, 0), level[i] + 1)
            turn[f] = latest(turn[f], turn[i])
            left[f] -= 1
            if not left[f]:
                level[f] = deepest[f]
                ready.append(f)
    number = pa.int64()
    return pa.table(
        {
            "conv_id": table.column("conv_id"),
            "id": table.column("id"),
            "level": pa.array([level[i] for i in ids], pa.int32()),
            "order_turn": pa.array([turn[i] if level[i] >= 0 else own[i] for i in ids], number),
        }
    )


def placed_calls(calls: DataFrame, most: int | None = None) -> DataFrame:
    """Topological levels and turns of ``calls`` (``conv_id, id, call_turn, depends_on``; one row per id): ``conv_id, id,
    level, order_turn``. ``level`` is -1 on or behind a cycle; ``order_turn`` the latest turn among a call and those it
    waits for.

    Calls that hang together are a component, placed in one task of narrow rows however deep they are. Components over
    ``most`` calls (``COMPONENT_CALLS``) are placed by rounds instead, a level at a time over all tasks.
    """
    most = COMPONENT_CALLS if most is None else most
    alone = [F.lit(0).alias("level"), F.col("call_turn").alias("order_turn")]
    waits = calls.select("conv_id", "id", F.explode(F.array_distinct("depends_on")).alias("before"))
    waits = saved(waits.join(calls.select("conv_id", F.col("id").alias("before")), ["conv_id", "before"], "left_semi"))
    if waits.isEmpty():
        return calls.select("conv_id", "id", *alone)
    node = lambda name: F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col(name))
    parts = saved(connected_components(waits.select(node("id").alias("a"), node("before").alias("b"))))
    large = saved(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("root"))
    rows = saved(calls.withColumn("node", node("id")).join(parts, "node", "left").drop("node"))
    free = rows.filter(F.col("root").isNull()).select("conv_id", "id", *alone)
    tied = rows.filter(F.col("root").isNotNull())
    small = tied.join(large, "root", "left_anti").groupBy("root")
    found = free.unionByName(small.applyInArrow(_place, "conv_id long, id string, level int, order_turn long"))
    if large.isEmpty():
        return found
    wide = saved(tied.join(large, "root", "left_semi").drop("root"))
    levels = wide.join(call_levels(wide), ["conv_id", "id"])
    return found.unionByName(_raised(levels).select("conv_id", "id", "level", "order_turn"))


def format_chats(messages: DataFrame, schemas: Mapping[str, Mapping] = SCHEMAS) -> DataFrame:
    """One row per message of ``messages`` (``conv_id, turn, role, text``).

    ``conv_id, turn, role``; ``order_turn, order_level, order_part`` sort a conversation with every result behind its call
    and every call behind those it depends on; ``state`` is ``text``, ``linked``, ``unanswered`` or ``cycle`` for messages
    with calls, ``linked`` or ``orphan`` for results; ``problems`` lists what is wrong with the arguments of its calls;
    ``json`` is the message. An identifier used twice in a conversation means its first call, by turn and place. Nulls in any column stay
    null and are left out of the JSON; a result without conversation is an orphan. Repeated rows stay.
    """
    parsed = saved(parsed_messages(messages, schemas))
    every = parsed.select("conv_id", "turn", F.posexplode("calls").alias("position", "call")).filter(
        F.col("conv_id").isNotNull() & F.col("call.id").isNotNull()
    )
    # the first call of an id: by turn, place in the message, and what it says where messages repeat
    said = F.struct("turn", "position", "call.name", "call.arguments", "call.depends_on")
    first = every.groupBy("conv_id", F.col("call.id").alias("id")).agg(F.min(said).alias("first"))
    calls = saved(
        first.select(
            "conv_id", "id", F.col("first.turn").alias("call_turn"), F.col("first.name").alias("call_name"), "first.depends_on"
        )
    )
    answered = parsed.select("conv_id", F.col("result_of").alias("id")).filter("id IS NOT NULL").distinct()
    known = calls.join(answered.withColumn("answered", F.lit(True)), ["conv_id", "id"], "left")
    # a call never comes before those it waits for: its turn is raised to the latest of theirs
    turns = saved(known.join(placed_calls(calls), ["conv_id", "id"], "left"))
    per_message = turns.groupBy("conv_id", F.col("call_turn").alias("turn")).agg(
        F.max("order_turn").alias("order_turn"),
        F.max("level").alias("level"),
        F.min("level").alias("least"),
        F.count(F.when(F.col("answered").isNull(), 1)).alias("open"),
    )
    results = turns.select(
        "conv_id", F.col("id").alias("result_of"), F.col("order_turn").alias("r_turn"), F.col("level").alias("r_level"), "call_name"
    )
    # only messages with calls meet the calls, only results meet what they answer: plain ones stay where they are
    kind = lambda name: parsed.filter(F.col("kind") == name)
    joined = lookup_join(kind("calls"), per_message, ["conv_id", "turn"])
    joined = joined.unionByName(lookup_join(kind("result"), results, ["conv_id", "result_of"]), allowMissingColumns=True)
    joined = joined.unionByName(kind("text"), allowMissingColumns=True)
    is_calls, is_result = F.col("kind") == "calls", F.col("kind") == "result"
    state = (
        F.when(is_calls & (F.col("least") < 0), "cycle")
        .when(is_calls & F.coalesce(F.col("open") == 0, F.lit(False)), "linked")
        .when(is_calls, "unanswered")
        .when(is_result & F.col("r_turn").isNotNull(), "linked")
        .when(is_result, "orphan")
        .otherwise("text")
    )
    problems = F.array_sort(
        F.transform(
            F.filter("calls", lambda c: c["state"] != "ok"),
            lambda c: F.concat_ws(":", F.coalesce(c["id"], F.lit("")), c["state"]),
        )
    )
    said = F.struct(
        "content",
        F.when(is_result, F.col("call_name")).alias("name"),
        "role",
        F.col("result_of").alias("tool_call_id"),
        F.when(
            is_calls, F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
        ).alias("tool_calls"),
    )
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce(F.when(is_calls, F.col("order_turn")), F.when(is_result, F.col("r_turn")), F.col("turn")).alias("order_turn"),
        F.coalesce(F.when(is_calls, F.col("level")), F.when(is_result, F.col("r_level")), F.lit(0)).cast("int").alias("order_level"),
        F.when(is_result & F.col("r_turn").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("order_part"),
        state.alias("state"),
        F.array_join(problems, ",").alias("problems"),
        F.to_json(said).alias("json"),
    )


def _raised(known: DataFrame) -> DataFrame:
    """``known`` calls with ``order_turn``: their own turn, or the latest turn among those they wait for."""
    turns = known.withColumn("order_turn", F.col("call_turn"))
    waits = saved(known.filter("level > 0").select("conv_id", "id", "level", F.explode("depends_on").alias("before")))
    top = waits.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        before = turns.select("conv_id", F.col("id").alias("before"), F.col("order_turn").alias("_t"))
        latest = waits.filter(F.col("level") == level).join(before, ["conv_id", "before"])
        latest = latest.groupBy("conv_id", "id").agg(F.max("_t").alias("_t"))
        turns = saved(
            turns.join(latest, ["conv_id", "id"], "left")
            .withColumn("order_turn", F.greatest("order_turn", "_t"))
            .drop("_t")
        )
    return turns
