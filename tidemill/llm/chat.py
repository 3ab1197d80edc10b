"""Chat formatting with linked tool calls.

An assistant's text may hold calls as `<tool_call>{"id", "name", "arguments", "depends_on"?}</tool_call>`; a turn of role
tool is a result, `{"tool_call_id", "content"}`. Turns become events: a message (the text without its calls), calls and
results. Calls and results are hash-joined by conversation and identifier, calls are validated against the schemas of
their tools and put in topological order (a call's level is one more than the largest of those it depends on, a result
shares its call's), and every event is serialised as canonical JSON (sorted keys, no spaces, non-ASCII as it is).

Per event: conv_id, turn, seq (within the turn), kind, call_id, level, status, json. Status of calls: ok, unanswered,
duplicate (not the first of its identifier), cyclic, unknown_tool, or invalid; of results: ok, orphan, duplicate; of
messages: ok, or malformed if a call's JSON can't be read or isn't text (half a surrogate pair); it then stays in the message.
A schema with a keyword that isn't obeyed is refused.

Order by turn, then level, then seq for a training text. Nulls: a null text is an empty message; null conv_id, turn and
role stay null; calls and results without conv_id or identifier aren't linked. Repeated rows give as many repeated events,
judged alike; of repeated identifiers the first by turn and seq counts, rows that tie there together. An empty table gives no events. Very long texts are
read whole; columns besides the four play no part, however they are called. What one task gathers of a conversation are the
dependences of its calls, up to ONE_TASK; larger conversations are ordered by rounds over all of them.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, stash

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Tools known when none are given.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


# The keywords of a schema that `valid` obeys, and those that only describe.
_KEYWORDS = set("type enum const properties required additionalProperties items minLength maxLength minimum maximum minItems maxItems title description default examples".split())


def obeyed(schema: object) -> None:
    """A ValueError if a schema holds a keyword or type that `valid` doesn't know, so that none is passed over in silence."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict) or schema.keys() - _KEYWORDS:
        raise ValueError(f"not a schema that is understood: {schema!r}")
    kinds = schema.get("type", [])
    if any(k not in _TYPES for k in ([kinds] if isinstance(kinds, str) else kinds)):
        raise ValueError(f"unknown type: {kinds!r}")
    for part in (*schema.get("properties", {}).values(), *(schema[k] for k in ("items", "additionalProperties") if k in schema)):
        obeyed(part)


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()  # 1.0 is a whole number
    return isinstance(value, _TYPES[kind])


def valid(value: object, schema: dict | bool) -> bool:
    """Whether value meets the schema, by the keywords that `obeyed` lets pass."""
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    # as canonical JSON, in which true isn't 1
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]) or "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(valid(x, schema.get("items", {})) for x in value)
    if isinstance(value, dict):
        known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())):
            return False
        return all(valid(v, known[k]) if k in known else valid(v, extra) if isinstance(extra, dict) else extra for k, v in value.items())
    return True


def _refuse(name: str) -> None:
    raise ValueError(name)  # NaN and infinities aren't JSON


def _load(text: str) -> object:
    value = json.loads(text, parse_constant=_refuse)
    if "\\u" in text:
        canonical(value).encode()  # an escaped half of a surrogate pair is no text: a ValueError
    return value


def events_of(role: str | None, text: str, tools: dict[str, dict]) -> list[tuple[str, str | None, list[str], str, str]]:
    """(kind, call_id, ids it depends on, status so far, canonical JSON) of a turn."""
    calls, status, out = [], "ok", []

    def taken(m: re.Match) -> str:
        nonlocal status
        try:
            call = _load(m[1])
            call_id, name, arguments, needs = call["id"], call["name"], call["arguments"], call.get("depends_on", [])
            if not (isinstance(call_id, str) and isinstance(name, str) and isinstance(needs, list) and all(isinstance(x, str) for x in needs)):
                raise ValueError
            if isinstance(arguments, str):
                arguments = _load(arguments)
            line = canonical({"arguments": arguments, "id": call_id, "name": name, "type": "call"})
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            status = "malformed"
            return m[0]
        calls.append(("call", call_id, needs, "unknown_tool" if name not in tools else "ok" if valid(arguments, tools[name]) else "invalid", line))
        return ""

    if role == "tool":
        try:
            result = _load(text)
            call_id = result["tool_call_id"]
            if not isinstance(call_id, str):
                raise ValueError
            return [("result", call_id, [], "ok", canonical({"content": result.get("content"), "id": call_id, "type": "result"}))]
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            status = "malformed"
    body = _CALL.sub(taken, text) if role == "assistant" else text
    out.append(("message", None, [], status, canonical({"content": body, "role": role, "type": "message"})))
    return out + calls


EVENTS = "conv_id long, turn long, seq int, kind string, call_id string, needs array<string>, status string, json string"


def events(turns: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    tools = TOOLS if tools is None else tools
    for schema in tools.values():
        obeyed(schema)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    names = ["conv_id", "turn", "seq", "kind", "call_id", "needs", "status", "json"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(conv, turn, seq, *e) for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for seq, e in enumerate(events_of(role, text, tools))]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return map_arrow(rows, run, EVENTS)


#: Dependences of a conversation that one task orders; those of larger ones are ordered by rounds over all of them.
ONE_TASK = 100_000


def _ordered(edges: list[dict[str, str]]) -> list[tuple[str, int]]:
    """(call_id, level) of one conversation's calls that wait for others, level by level; calls on a cycle or behind one are missing."""
    waits, behind = Counter(e["call_id"] for e in edges), {}
    for e in edges:
        behind.setdefault(e["need"], []).append(e["call_id"])
    at, level, out = [n for n in behind if n not in waits], 0, []
    while at:
        level, ready = level + 1, []
        for n in at:
            for call in behind.get(n, ()):
                waits[call] -= 1
                if not waits[call]:
                    ready.append(call)
        out += [(call, level) for call in ready]
        at = ready
    return out


def _by_conversation(edges: DataFrame) -> DataFrame:
    """(c, i, level) of conversations with few dependences: each one's are a row, which one task orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(c, i, n) for c, own in zip(*(x.to_pylist() for x in batch.columns), strict=True) for i, n in _ordered(own)]
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32()))], names=["c", "i", "level"])

    one = edges.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "need")).alias("edges"))
    return map_arrow(one, run, "c long, i string, level int", 100)


def _by_rounds(edges: DataFrame, free: DataFrame) -> DataFrame:
    """The same for all calls at once, a round for each level: only what is still waiting and what became free last take part."""
    node, spark = ["conv_id", "call_id"], edges.sparkSession
    done, left, level = [], edges, 0
    newest = stash(free.select(F.col("c").alias("conv_id"), F.col("i").alias("need")))
    while True:
        level += 1
        met = left.join(newest, ["conv_id", "need"], "left_semi").select(*node).distinct()
        still = stash(left.join(newest, ["conv_id", "need"], "left_anti"))
        ready = stash(met.join(still, node, "left_anti"))
        if ready.isEmpty():
            break
        done.append(ready.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.lit(level).alias("level")))
        newest, left = ready.select("conv_id", F.col("call_id").alias("need")), still
        if len(done) > 50:  # a plan of bounded size, however long the chain
            done = [stash(reduce(DataFrame.union, done))]
    return reduce(DataFrame.union, done, spark.createDataFrame([], "c long, i string, level int"))


def _levels(calls: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(c, i, level) of calls that depend on nothing unmet, one row each; those missing lie on a cycle or behind one.

    Dependences on identifiers that the conversation doesn't have are ignored.
    """
    first = calls.where("own").select("conv_id", "call_id", "needs")
    keys = first.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).distinct()
    wants = first.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    wants = stash(wants.join(keys, (F.col("conv_id") == F.col("c")) & (F.col("need") == F.col("i"))).select("conv_id", "call_id", "need"))
    waiting = wants.select(F.col("conv_id").alias("x"), F.col("call_id").alias("y")).distinct()
    free = stash(keys.join(waiting, (F.col("c") == F.col("x")) & (F.col("i") == F.col("y")), "left_anti").withColumn("level", F.lit(0)))
    large = stash(wants.groupBy(F.col("conv_id").alias("l")).count().where(F.col("count") > one_task).select("l"))
    some = _by_conversation(wants.join(large, F.col("conv_id") == F.col("l"), "left_anti"))
    rest = stash(wants.join(large, F.col("conv_id") == F.col("l"), "left_semi"))
    levels = free.union(some)
    return levels if rest.isEmpty() else levels.union(_by_rounds(rest, free.join(large, F.col("c") == F.col("l"), "left_semi")))


def link(turns: DataFrame, tools: dict[str, dict] | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """The events of turns with calls and results linked, ordered by level, and judged."""
    rows = stash(events(turns, tools))
    linked = rows.where("call_id is not null and conv_id is not null")
    # the first of each identifier, by kind: counted before it is joined, so that a hot identifier is one row
    first = linked.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", F.struct("turn", "seq"))).alias("call_at"),
        F.min(F.when(F.col("kind") == "result", F.struct("turn", "seq"))).alias("result_at"),
    )
    first = first.select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "call_at", "result_at").hint("shuffle_hash")
    tied = linked.join(first, (F.col("conv_id") == F.col("fc")) & (F.col("call_id") == F.col("fi")))
    at = F.struct("turn", "seq")
    tied = tied.withColumn("own", F.when(F.col("kind") == "call", at == F.col("call_at")).otherwise(at == F.col("result_at")))
    answered = F.col("result_at").isNotNull() & (F.col("result_at") > F.col("call_at"))
    tied = stash(tied.select(*rows.columns, "own", F.col("call_at").isNotNull().alias("called"), F.coalesce(answered, F.lit(False)).alias("answered")))
    levels = _levels(tied.where("kind = 'call'"), one_task)
    tied = tied.join(levels, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    status = (
        F.when(~F.col("own"), "duplicate")
        .when((F.col("kind") == "result") & ~(F.col("called") & F.col("answered")), "orphan")
        .when((F.col("kind") == "call") & (F.col("status") != "ok"), F.col("status"))
        .when(F.col("level").isNull(), "cyclic")
        .when((F.col("kind") == "call") & ~F.col("answered"), "unanswered")
        .otherwise("ok")
    )
    out = ["conv_id", "turn", "seq", "kind", "call_id", "level", "status", "json"]
    rest = rows.where("call_id is null or conv_id is null").withColumn("level", F.lit(0)).withColumn("status", F.when(F.col("kind") == "message", F.col("status")).when(F.col("kind") == "result", "orphan").otherwise(F.when(F.col("status") != "ok", F.col("status")).otherwise("unanswered")))
    return rest.select(*out).union(tied.withColumn("status", status).select(*out))


def with_tools(turns: DataFrame) -> DataFrame:
    """Turns of plain talk with calls and results put in, by fixed rules over conv_id (c) and turn (t).

    Each assistant's turn asks for a search for its first 40 characters or, where t is a multiple of 3, for a calculation,
    and depends on the call two turns before. The result follows as a turn of its own; turns are counted by halves.
    Where a rule says so there are faults: no result (c + t a multiple of 11), a result that comes again (7) or names another
    call (13), a limit out of bounds (5), a tool nobody knows (17), a call that depends on its own successor (19), a call
    that comes twice (23), and JSON that breaks off (29).
    """
    c, t, n = F.coalesce("conv_id", F.lit(0)).cast("long"), F.coalesce("turn", F.lit(0)).cast("long"), F.col("conv_id") + F.col("turn")
    text, fault = F.coalesce("text", F.lit("")), lambda k: F.coalesce(n % k == 0, F.lit(False))
    name = lambda k: F.concat(F.lit("call-"), (t + k).cast("string"))
    query = F.to_json(F.struct(F.substring(text, 1, 40).alias("query"), F.when(fault(5), 0).otherwise(t % 100 + 1).alias("limit")))
    arguments = F.when(t % 3 == 0, F.to_json(F.struct(F.concat(c.cast("string"), F.lit("+"), t.cast("string")).alias("expression")))).otherwise(query)
    tool = F.when(fault(17), "fly").when(t % 3 == 0, "calculate").otherwise("search")
    needs = F.to_json(F.when(fault(19), F.array(name(2), name(-2))).otherwise(F.array(name(-2))))
    call = F.concat(F.lit('<tool_call>{"id": "'), name(0), F.lit('", "name": "'), tool, F.lit('", "arguments": '), arguments, F.lit(', "depends_on": '), needs, F.when(fault(29), "").otherwise("}"), F.lit("</tool_call>"))
    asks = F.col("role").eqNullSafe("assistant")
    said = F.when(asks, F.concat(text, call, F.when(fault(23), call).otherwise(""))).otherwise(F.col("text"))
    result = F.to_json(F.struct(F.when(fault(13), name(1000)).otherwise(name(0)).alias("tool_call_id"), F.length(text).alias("content")))
    answers = F.when(~asks | fault(11), F.array().cast("array<string>")).when(fault(7), F.array(result, result)).otherwise(F.array(result))
    rows = turns.select("conv_id", (2 * F.col("turn")).alias("turn"), "role", said.alias("said"), answers.alias("answers"))
    results = rows.select("conv_id", "turn", F.posexplode("answers").alias("again", "text")).select("conv_id", (F.col("turn") + 1 + F.col("again")).alias("turn"), F.lit("tool").alias("role"), "text")
    return rows.select("conv_id", "turn", "role", F.col("said").alias("text")).union(results)
