"""Chat formatting: tool calls linked to their results, checked and written as canonical JSON.

A message's text may be JSON: an assistant's ``{"content": ..., "tool_calls": [{"id", "name",
"arguments", "after"}]}`` or a tool's ``{"tool_call_id": ..., "content": ...}``.  Any other text is
plain content.

* Calls and results are joined by (conversation, identifier): a shuffled hash join that AQE may
  split; messages are not gathered by conversation, so one with a third of all turns is no hot task.
* Order is topological: a result stands after its call, a call after those that ``after`` names.
  A message's place is (turn, level, kind, identifier), where a level is the longest chain of
  dependencies: calls without open dependencies are peeled off until none is left; what remains is on
  or behind a cycle.  The dependencies of a conversation are peeled in one task if there are at most
  ``gather`` of them; those of larger conversations are peeled by joins, one level a round.
* Arguments are validated against the schema of the tool that is named (types, required and unknown
  properties, enumerations, nested objects and arrays).
* Every message becomes one line of canonical JSON: sorted keys, no spaces, no escapes but those that
  JSON and UTF-8 need (lone surrogates).

Defined cases: rows with a null conversation link with each other, as one conversation; a dependency on a
call that isn't there is none; null text is null content; null roles are written as null; calls without a result,
results without a call, repeated identifiers, unknown tools and unreadable arguments are kept and
named in ``problems``; identifiers that aren't strings count as their JSON; texts that aren't strict
JSON (``NaN``, infinite or overlong numbers, too deep nesting) are plain content; repeated rows stay; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the tools that are known without a table of schemas.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "lookup": {"type": "object", "properties": {"id": {"type": "integer"}, "fields": {"type": "array", "items": {"type": "string"}}}, "required": ["id"], "additionalProperties": False},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Dependencies of one conversation that are gathered in one task at most.
GATHER = 200_000
_LONE = re.compile("[\ud800-\udfff]")


def written(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 has no bytes for, as JSON's escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return written(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(number: str) -> float:
    if not math.isfinite(x := float(number)):
        raise ValueError(number)
    return x


def read_json(text: str):
    """A JSON value that ``canonical`` can write; ValueError for anything else."""
    try:
        value = json.loads(text, parse_constant=_finite, parse_float=_finite)
        canonical(value)
    except RecursionError as e:
        raise ValueError("too deep") from e
    return value


def _identifier(value) -> str | None:
    return None if value is None else written(value) if isinstance(value, str) else canonical(value)


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema``, as ``path: reason``."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        good = kind is None or isinstance(value, _TYPES[kind])
    if not good:
        return [f"{at}: not {kind}"]
    out = [f"{at}: not one of the values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += validate(x, schema["items"], f"{at}[{i}]")
    return out


def read_message(text: str | None) -> tuple[str | None, list[dict], str | None]:
    """(content, calls, identifier of the call that it answers) of a message's text."""
    if text and text.lstrip()[:1] == "{":
        try:
            value = read_json(text)
        except ValueError:
            value = None
        if isinstance(value, dict) and ("tool_calls" in value or "tool_call_id" in value):
            calls = value.get("tool_calls")
            calls = [c for c in calls if isinstance(c, dict)] if isinstance(calls, list) else []
            content = value.get("content")
            return content if content is None or isinstance(content, str) else canonical(content), calls, _identifier(value.get("tool_call_id"))
    return text, [], None


def _arguments(call: dict, tools: dict) -> tuple[object, list[str]]:
    arguments = call.get("arguments")
    if isinstance(arguments, str):
        try:
            arguments = read_json(arguments)
        except ValueError:
            return arguments, ["arguments: not JSON"]
    name = call.get("name")
    if not isinstance(name, str) or name not in tools:
        return arguments, [f"name: unknown tool {_identifier(name)}"]
    return arguments, [written(x) for x in validate(arguments, tools[name])]


def _events(tools: dict):
    """(conv_id, turn, role, text) to one event for each message and one for each call in it."""

    def run(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                content, calls, answers = read_message(text)
                rows.append((conv, turn, "message", answers, [], {"role": role, "content": content} | ({"tool_call_id": answers} if answers is not None else {}), []))
                for c in calls:
                    arguments, problems = _arguments(c, tools)
                    after = c.get("after")
                    after = [_identifier(x) for x in after if x is not None] if isinstance(after, list) else []
                    ident = _identifier(c.get("id"))
                    rows.append((conv, turn, "call", ident, after, {"id": ident, "name": c.get("name"), "arguments": arguments, "role": role}, problems if ident is not None else [*problems, "id: missing"]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.list_(pa.string())),
                    pa.array([canonical(r[5]) for r in rows], pa.string()),
                    pa.array([r[6] for r in rows], pa.list_(pa.string())),
                ],
                names=["conv_id", "turn", "kind", "ident", "after", "body", "problems"],
            )

    return run


def _places(edges: list[tuple]) -> list[tuple]:
    """Dependencies (ident, before, turns of both) of one conversation to (ident, turn, level, cyclic) of each call in them."""
    place, behind, missing = {}, {}, {}
    for ident, before, turn, before_turn in edges:
        place[ident], place[before] = (turn, 0), (before_turn, 0)
        behind.setdefault(before, []).append(ident)
        missing[ident] = missing.get(ident, 0) + 1
    free = [x for x in place if x not in missing]
    while free:
        x = free.pop()
        for y in behind.get(x, ()):
            place[y] = max(place[y], (place[x][0], place[x][1] + 1))
            missing[y] -= 1
            if not missing[y]:
                free.append(y)
    return [(x, *place[x], missing.get(x, 0) > 0) for x in place]


_PLACES = pa.schema([("conv", pa.string()), ("ident", pa.string()), ("place_turn", pa.int64()), ("place_level", pa.int32()), ("cyclic", pa.bool_())])


def _all_places(batches):
    """``_places`` of conversations whose dependencies follow each other; one of them is held at a time."""

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACES, strict=True)], schema=_PLACES)

    now, edges, rows = None, [], []
    for batch in batches:
        for conv, *edge in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if conv != now:
                rows += [(now, *r) for r in _places(edges)]
                now, edges = conv, []
                if len(rows) > 10_000:
                    yield out(rows)
                    rows = []
            edges.append(edge)
    rows += [(now, *r) for r in _places(edges)]
    if rows:
        yield out(rows)


def _peeled(edges: DataFrame, scratch) -> DataFrame:
    """``_places`` by joins: each round takes the calls whose dependencies all have a place."""
    node = ["conv", "ident"]
    before = F.col("before").alias("ident")
    nodes = edges.select(*node, F.col("call_turn").alias("turn")).unionByName(edges.select("conv", before, F.col("before_turn").alias("turn"))).distinct()
    open_ = scratch.cut(nodes.join(edges.groupBy(*node).agg(F.count("*").alias("missing")), node, "left").select(*node, "turn", F.coalesce("missing", F.lit(0)).alias("missing"), F.struct(F.col("turn").alias("turn"), F.lit(0).alias("level")).alias("place")), "open-0")
    done, k = None, 0
    while True:
        free = scratch.cut(open_.where("missing = 0").select(*node, "place"), f"free-{k}")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        freed = edges.join(free.select("conv", F.col("ident").alias("before"), "place"), ["conv", "before"])
        freed = freed.groupBy(*node).agg(F.count("*").alias("n"), F.max(F.struct(F.col("place.turn").alias("turn"), (F.col("place.level") + 1).alias("level"))).alias("behind"))
        rest = open_.where("missing > 0").join(freed, node, "left")
        k += 1
        open_ = scratch.cut(rest.select(*node, "turn", (F.col("missing") - F.coalesce("n", F.lit(0))).alias("missing"), F.greatest("place", F.coalesce("behind", "place")).alias("place")), f"open-{k}")
    stuck = open_.select(*node, "place", F.lit(True).alias("cyclic"))
    out = stuck if done is None else done.withColumn("cyclic", F.lit(False)).unionByName(stuck)
    return out.select(*node, F.col("place.turn").alias("place_turn"), F.col("place.level").alias("place_level"), "cyclic")


def formatted(messages: DataFrame, tools: dict = TOOLS, gather: int = GATHER) -> DataFrame:
    """(conv_id, turn, order_turn, level, kind, ident, json, problems) of every message and call."""
    from .scratch import Scratch

    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    schema = "conv_id long, turn long, kind string, ident string, after array<string>, body string, problems array<string>"
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")  # a null conversation is one of its own
    events = scratch.cut(rows.mapInArrow(_events(tools), schema).select("*", conv), "events")
    calls = events.where("kind = 'call' AND ident IS NOT NULL").groupBy("conv", "ident").agg(F.min("turn").alias("call_turn"), F.count("*").alias("call_n"))
    results = events.where("kind = 'message' AND ident IS NOT NULL").groupBy("conv", "ident").agg(F.count("*").alias("result_n"))
    linked = scratch.cut(calls.join(results, ["conv", "ident"], "full"), "linked")

    # longest chains of dependencies; the turn that an event has at least comes along
    known = linked.where("call_turn IS NOT NULL").select("conv", "ident", "call_turn")
    edges = events.where("kind = 'call' AND ident IS NOT NULL").select("conv", "ident", F.explode("after").alias("before")).distinct()
    edges = edges.join(known.select("conv", F.col("ident").alias("before"), F.col("call_turn").alias("before_turn")), ["conv", "before"]).join(known, ["conv", "ident"])
    edges = scratch.cut(edges, "edges")
    large = scratch.cut(edges.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > gather).select("conv"), "large")
    if large.isEmpty():
        few, many = edges, None
    else:
        few, many = edges.join(large, "conv", "left_anti"), scratch.cut(edges.join(large, "conv", "left_semi"), "many")
    few = few.select("conv", "ident", "before", "call_turn", "before_turn").repartition("conv").sortWithinPartitions("conv")
    found = few.mapInArrow(_all_places, "conv string, ident string, place_turn long, place_level int, cyclic boolean")
    if many is not None:
        found = found.unionByName(_peeled(many, scratch))
    place = known.join(found, ["conv", "ident"], "left")
    place = place.select("conv", "ident", F.coalesce("place_turn", "call_turn").alias("order_turn"), F.coalesce("place_level", F.lit(0)).alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))

    # events without identifier join nothing, so they don't move at all
    some = events.where("ident IS NOT NULL").join(linked, ["conv", "ident"], "left").join(place, ["conv", "ident"], "left")
    out = some.unionByName(events.where("ident IS NULL"), allowMissingColumns=True)
    call = F.col("kind") == "call"
    notes = F.array_compact(
        F.array(
            F.when(call & F.col("result_n").isNull(), F.lit("call without result")),
            F.when(~call & F.col("ident").isNotNull() & F.col("call_turn").isNull(), F.lit("result without call")),
            F.when(F.col("call_n") > 1, F.lit("repeated call id")),
            F.when(F.col("result_n") > 1, F.lit("repeated result")),
            F.when(F.col("cyclic"), F.lit("cycle")),
        )
    )
    order_turn = F.greatest("turn", F.col("order_turn"))
    level = F.when(call, F.coalesce("level", F.lit(0))).otherwise(F.when(F.col("ident").isNotNull(), F.coalesce("level", F.lit(0)) + 1).otherwise(F.lit(0)))
    return out.select(
        "conv_id", "turn", order_turn.alias("order_turn"), level.alias("level"), "kind", "ident", F.col("body").alias("json"), F.concat("problems", notes).alias("problems")
    )


def drawn(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``messages`` with calls and results, for tables that have none.

    Every assistant's text that isn't JSON becomes the content of a message with one call, and tool messages
    answer it.  A hash of (conversation, turn) decides the tool, and where something is wrong: arguments,
    tool, identifier, a call behind itself, and results that are missing, repeated or strangers.
    """
    h = F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary"))
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("h", h).withColumn("calls", F.coalesce((F.col("role") == "assistant") & ~F.coalesce(F.startswith(F.ltrim("text"), F.lit("{")), F.lit(False)), F.lit(False)))
    own, earlier = F.concat(F.lit("c"), F.col("turn").cast("string")), F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))

    def each(n: int, then, other):
        return F.when(F.col("h") % n == 0, then).otherwise(other)

    kind = F.floor(F.col("h") / 64) % 4
    search = F.to_json(F.struct(own.alias("query"), each(5, F.lit("many"), F.lit(None)).alias("limit")))
    lookup = F.to_json(F.struct(each(6, F.lit(None), F.col("conv_id")).alias("id"), F.array(F.lit("text"), F.col("role")).alias("fields")))
    arguments = F.when(kind == 0, lookup).when(kind == 1, each(7, F.lit("{1 + "), F.to_json(F.struct(own.alias("expression"))))).otherwise(search)
    name = F.when(kind == 0, F.lit("lookup")).when(kind == 1, F.lit("calculate")).otherwise(each(9, F.lit("fetch"), F.lit("search")))
    ident = each(37, F.lit(None), each(31, earlier, own))
    after = F.when(F.col("h") % 29 == 0, F.array(own)).when(F.col("turn") >= 2, F.array(earlier)).otherwise(F.array().cast("array<string>"))
    call = F.struct(ident.alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    asked = F.struct(F.col("role"), F.when(F.col("calls"), F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")))).otherwise(F.col("text")).alias("text"))
    answer = F.struct(F.lit("tool").alias("role"), F.to_json(F.struct(each(17, F.concat(F.lit("x"), own), own).alias("tool_call_id"), F.concat(F.lit("result of "), own).alias("content"))).alias("text"))
    times = F.when(~F.col("calls") | (F.col("h") % 11 == 0), 0).otherwise(each(13, F.lit(2), F.lit(1)))
    out = rows.select("conv_id", "turn", F.explode(F.concat(F.array(asked), F.array_repeat(answer, times))).alias("m"))
    return out.select("conv_id", "turn", "m.role", "m.text")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with the calls and results of ``drawn``: the table itself has none."""
    return formatted(drawn(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
