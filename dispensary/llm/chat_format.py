"""Chat formatting with tool-call linking.

Calls and results are hash-joined by identifier, calls are put into topological order of what they build on (within a
conversation in one task, across conversations by joins), arguments are validated against the tools' schemas, and every message becomes one line of canonical JSON.
The texts of a conversation are never gathered into one task: lines carry the keys that order them.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensary.llm._spark import checkpointed

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Keywords that are checked, and those that say nothing about a value.
_CHECKED = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "anyOf", "oneOf", "allOf", "not"}
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment", "format"}


def whole(text: str | None) -> str | None:
    """Half surrogate pairs, which UTF-8 cannot hold, as the escapes that JSON has for them."""
    return text and re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes that aren't needed."""
    return whole(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def parsed(text: str):
    """The value of a JSON text; ValueError for numbers that JSON can't write (NaN, infinities, or beyond a double)."""

    def number(x: str) -> float:
        if not math.isfinite(out := float(x)):
            raise ValueError(x)
        return out

    return json.loads(text, parse_constant=number, parse_float=number)


def check_schema(schema, at: str = "$") -> None:
    """ValueError for a schema with a keyword or type that `problem` doesn't know, so that none is passed over in silence."""
    if isinstance(schema, bool):
        return
    if unknown := set(schema) - _CHECKED - _NOTES:
        raise ValueError(f"{at}: unknown keywords {sorted(unknown)}")
    kinds = schema.get("type", [])
    if unknown := set([kinds] if isinstance(kinds, str) else kinds) - set(_TYPES):
        raise ValueError(f"{at}: unknown types {sorted(unknown)}")
    re.compile(schema.get("pattern", ""))
    if schema.get("multipleOf", 1) <= 0:
        raise ValueError(f"{at}: multiples of nothing")
    for k, own in schema.get("properties", {}).items():
        check_schema(own, f"{at}.{k}")
    for k in ("items", "additionalProperties", "not"):
        if k in schema:
            check_schema(schema[k], f"{at}/{k}")
    for k in ("anyOf", "oneOf", "allOf"):
        for i, own in enumerate(schema.get(k, [])):
            check_schema(own, f"{at}/{k}/{i}")


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def _same(a, b) -> bool:
    """Equal as JSON values: 1 is 1.0, but not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def problem(value, schema, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: nothing is allowed"
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        return f"{at}: not one of the listed values"
    found = None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found = _number(value, schema, at)
    elif isinstance(value, str):
        found = _string(value, schema, at)
    elif isinstance(value, dict):
        found = _object(value, schema, at)
    elif isinstance(value, list):
        found = _array(value, schema, at)
    return found or _combined(value, schema, at)


def _exact(x) -> Fraction:
    """The number as it is written, so that 0.3 is three times 0.1; a whole number of any length is no float on the way."""
    return Fraction(x) if isinstance(x, int) else Fraction(repr(x))


def _number(value, schema: dict, at: str) -> str | None:
    if value < schema.get("minimum", value):
        return f"{at}: below {schema['minimum']}"
    if value > schema.get("maximum", value):
        return f"{at}: above {schema['maximum']}"
    if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
        return f"{at}: not above {schema['exclusiveMinimum']}"
    if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
        return f"{at}: not below {schema['exclusiveMaximum']}"
    if "multipleOf" in schema and _exact(value) % _exact(schema["multipleOf"]):
        return f"{at}: not a multiple of {schema['multipleOf']}"
    return None


def _string(value: str, schema: dict, at: str) -> str | None:
    if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: length {len(value)}"
    if "pattern" in schema and not re.search(schema["pattern"], value):
        return f"{at}: other than the pattern"
    return None


def _object(value: dict, schema: dict, at: str) -> str | None:
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
        return f"{at}: {len(value)} properties"
    for k in schema.get("required", []):
        if k not in value:
            return f"{at}.{k}: missing"
    known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
    for k in sorted(value):
        if k not in known and rest is False:
            return f"{at}.{k}: unknown"
        if found := problem(value[k], known.get(k, rest), f"{at}.{k}"):
            return found
    return None


def _array(value: list, schema: dict, at: str) -> str | None:
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
        return f"{at}: {len(value)} items"
    if schema.get("uniqueItems") and any(_same(x, y) for i, x in enumerate(value) for y in value[:i]):
        return f"{at}: repeated items"
    for i, x in enumerate(value):
        if found := problem(x, schema.get("items", True), f"{at}[{i}]"):
            return found
    return None


def _combined(value, schema: dict, at: str) -> str | None:
    for own in schema.get("allOf", []):
        if found := problem(value, own, at):
            return found
    fits = lambda k: sum(problem(value, own, at) is None for own in schema[k])
    if "anyOf" in schema and not fits("anyOf") or "oneOf" in schema and fits("oneOf") != 1:
        return f"{at}: fits none of the alternatives, or too many"
    if "not" in schema and problem(value, schema["not"], at) is None:
        return f"{at}: fits what is ruled out"
    return None


#: The level of a call that never settles; below it every real level, and a real level can still be added to it.
_NEVER = 1 << 40


def topological_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, level): 0 for calls that need no other known call, else one more than the highest of those; null for a
    call on a cycle, or one that needs such a call.

    `needs` is (call_id, needed); needs that name no known call are ignored.  An edge says that the level of a call is at
    least `base`, and at least `weight` more than that of the needed one.  Each round settles the calls whose needs are
    settled, and an edge to a call with one open need jumps to that need, so a chain takes about log2(length) rounds;
    calls with several open needs take a round a level.  There is no limit of rounds: a round changes an edge, or is
    the last one.  A weight is the length of a walk, and one as long as there are calls passes a cycle."""
    ids = calls.select("call_id").filter("call_id is not null").distinct()
    edges = needs.select("call_id", "needed").distinct().join(ids, "call_id").join(ids.select(F.col("call_id").alias("needed")), "needed")
    edges = checkpointed(edges.select("call_id", "needed", F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("weight")))
    n_calls = ids.count()
    settled = [ids.join(edges.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))]
    while True:
        cyclic = F.max((F.col("needed") == F.col("call_id")) | (F.col("needed").isNotNull() & (F.col("weight") >= n_calls)))
        nodes = edges.groupBy("call_id").agg(F.count("needed").alias("n_open"), F.max("needed").alias("next"), F.max("base").alias("base"), F.max(F.when(F.col("needed").isNotNull(), F.col("weight"))).alias("step"), cyclic.alias("cyclic"))
        level = F.when(F.coalesce("cyclic", F.lit(False)) | (F.col("base") >= _NEVER), F.lit(_NEVER)).when(F.col("n_open") == 0, F.col("base"))
        nodes = checkpointed(nodes.select(F.col("call_id").alias("node"), level.alias("level"), "n_open", "next", F.col("base").alias("on"), "step"))
        settled.append(nodes.filter("level is not null").select(F.col("node").alias("call_id"), "level"))
        if len(settled) > 16:
            settled = [checkpointed(_union(settled))]
        # open edges; a needed call that is no node needs nothing itself, so its level is 0
        going = edges.join(nodes.filter("level is null").select(F.col("node").alias("call_id")), "call_id", "left_semi")
        # a jump never ends on a settled call, as that one is no node in the next round
        still = nodes.filter("level is null").select(F.col("node").alias("still"))
        met = going.join(nodes.join(still, F.col("next") == F.col("still"), "left"), F.col("needed") == F.col("node"), "left")
        known = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("level"))
        ends = F.col("needed").isNotNull() & known.isNotNull()
        jumps = F.col("needed").isNotNull() & known.isNull() & (F.col("n_open") == 1) & F.col("still").isNotNull()
        met = met.select(
            "call_id",
            F.when(ends, F.lit(None)).when(jumps, F.col("next")).otherwise(F.col("needed")).alias("needed"),
            F.when(ends, F.greatest("base", F.col("weight") + known)).when(jumps, F.greatest("base", F.col("weight") + F.col("on"))).otherwise(F.col("base")).alias("base"),
            F.when(ends, F.lit(0)).when(jumps, F.col("weight") + F.col("step")).otherwise(F.col("weight")).alias("weight"),
            (ends | jumps).alias("moved"),
        )
        edges = checkpointed(met.groupBy("call_id", "needed").agg(F.max("base").alias("base"), F.max("weight").alias("weight"), F.max("moved").alias("moved")))
        if edges.filter("moved").isEmpty():  # what is open now needs open calls only
            break
    return ids.join(_union(settled).filter(F.col("level") < _NEVER), "call_id", "left").select("call_id", F.col("level").cast("int").alias("level"))


#: Edges of a conversation that are resolved in one task; larger ones are joined like those that name calls of others.
EDGES = 100_000


def _levels_of(edges: dict) -> dict:
    """The level of every call that stands in call -> calls that it needs; None on a cycle or after one."""
    waits, after = {}, {}
    for call, needed in edges.items():
        waits[call] = len(needed)
        for n in needed:
            after.setdefault(n, []).append(call)
    level = dict.fromkeys({*edges, *after})
    ready = [n for n in level if n not in waits]
    for n in ready:
        level[n] = 0
    for n in ready:  # grows as it goes
        for call in after.get(n, ()):
            waits[call] -= 1
            if not waits[call]:
                level[call] = 1 + max(level[x] for x in edges[call])
                ready.append(call)
    return level


def conversation_levels(calls: DataFrame, needs: DataFrame, edges_at_once: int = EDGES) -> DataFrame:
    """What topological_levels gives, with most of it done conversation by conversation.

    A conversation whose calls need none of another one's, nor the other way round, and which has `edges_at_once` edges at most, is
    resolved in one task, however deep or wide its calls build on each other; calls of all others are joined in rounds."""
    c = calls.filter("call_id is not null").select("conv_id", "call_id").distinct()
    homes = c.groupBy("call_id").agg(F.min("conv_id").alias("home"), (F.count("*") > 1).alias("several"))
    target = homes.select(F.col("call_id").alias("needed"), F.col("home").alias("needed_home"), F.col("several").alias("needed_several"))
    edges = checkpointed(needs.select("call_id", "needed").distinct().join(homes, "call_id").join(target, "needed"))
    alone = ~F.col("several") & ~F.col("needed_several") & F.coalesce(F.col("home") == F.col("needed_home"), F.lit(False))
    open_ = edges.filter(~alone).select(F.explode(F.array("home", "needed_home")).alias("home"))
    # a call that several conversations name belongs to all of them
    spread = c.join(edges.filter("several").select("call_id").unionByName(edges.filter("needed_several").select(F.col("needed").alias("call_id"))).distinct(), "call_id").select(F.col("conv_id").alias("home"))
    large = edges.groupBy("home").count().filter(F.col("count") > edges_at_once).select("home")
    shared = checkpointed(open_.unionByName(spread).unionByName(large).distinct())
    own = edges.join(shared, "home", "left_anti").filter(alone)

    def resolve(t: pa.Table) -> pa.Table:
        of: dict = {}
        for call, needed in zip(t.column("call_id").to_pylist(), t.column("needed").to_pylist(), strict=True):
            of.setdefault(call, []).append(needed)
        level = _levels_of(of)
        return pa.table({"call_id": pa.array(list(level), pa.string()), "level": pa.array(list(level.values()), pa.int32())})

    here = own.select("home", "call_id", "needed").groupBy("home").applyInArrow(resolve, "call_id string, level int").withColumn("known", F.lit(True))
    rest = edges.join(own.select("call_id", "needed"), ["call_id", "needed"], "left_anti")
    ends = rest.select(F.explode(F.array("call_id", "needed")).alias("call_id")).distinct()
    joined = topological_levels(ends, rest).withColumn("known", F.lit(True)) if not rest.isEmpty() else None
    found = here if joined is None else here.unionByName(joined)
    level = F.when(F.col("known"), F.col("level")).otherwise(F.lit(0))
    return homes.select("call_id").join(found, "call_id", "left").select("call_id", level.cast("int").alias("level"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, kind, call_id, level, status, error, line), one row a message, call and result.

    `messages` is (conv_id, turn, role, text), `calls` (conv_id, turn, call_id, name, arguments, needs: array of call
    ids), `results` (call_id, content).  A conversation's lines are ordered by turn, then kind (message before calls
    before results), then level, then call_id.  A call's status is `ok`, `no_result`, `unknown_tool`,
    `bad_json`, `bad_arguments`, `cycle` or `repeated_id` (the identifier names several calls); the worst comes first
    in the order repeated_id, cycle, unknown_tool, bad_json, bad_arguments, no_result.  `error` says what was wrong.
    A result's status is `ok`, or `orphan` if no call has its identifier; of a repeated call the first conversation
    and turn take it.  Null texts and contents become JSON null; null identifiers link with nothing.  Repeated rows
    of messages and results give a line each, empty tables give none; other columns, whatever their names, are ignored.
    Texts and contents of any length are written whole, and calls with equal keys keep their own lines.  Arguments that
    are not JSON, hold fractions beyond a double or whole numbers of over 4,300 digits, or are nested too deeply are `bad_json` and stay a string; half surrogate pairs
    are written as escapes.  A schema with a keyword that isn't checked is refused at the start (ValueError).
    """
    for own in schemas.values():
        check_schema(own)
    shared = {k: json.dumps(v) for k, v in schemas.items()}  # as long as the tools' schemas
    m = messages.select("conv_id", "turn", "role", "text")
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", "needs")
    r = results.select("call_id", "content")
    known = c.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_calls"), F.min(F.struct("conv_id", "turn")).alias("owner"))
    levels = checkpointed(conversation_levels(c, c.select("call_id", F.explode("needs").alias("needed"))))
    answered = r.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_results"))
    linked = c.join(known.select("call_id", "n_calls"), "call_id", "left").join(levels, "call_id", "left").join(answered, "call_id", "left")
    lines = m.select("conv_id", "turn", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.col("role").alias("head"), F.col("text").alias("body"), F.lit(None).cast("array<string>").alias("needs"), F.lit("ok").alias("status"))
    own = F.when(F.col("n_calls") > 1, "repeated_id").when(F.col("call_id").isNotNull() & F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "no_result").otherwise("ok")
    lines = lines.unionByName(linked.select("conv_id", "turn", F.lit(1).alias("kind"), "call_id", "level", F.col("name").alias("head"), F.col("arguments").alias("body"), "needs", own.alias("status")))
    back = r.join(known, "call_id", "left").join(levels, "call_id", "left")
    lines = lines.unionByName(back.select("owner.conv_id", "owner.turn", F.lit(2).alias("kind"), "call_id", "level", F.lit("tool").alias("head"), F.col("content").alias("body"), F.lit(None).cast("array<string>").alias("needs"), F.when(F.col("n_calls").isNull(), "orphan").otherwise("ok").alias("status")))

    def one(kind, call_id, head, body, needs, status):
        if kind == 0:
            return status, None, canonical({"content": body, "role": head})
        if kind == 2:
            return status, None if status == "ok" else "no call has this identifier", canonical({"content": body, "role": "tool", "tool_call_id": call_id})
        line = lambda arguments: canonical({"role": "assistant", "tool_calls": [{"arguments": arguments, "id": call_id, "name": head, "needs": sorted(x for x in set(needs or []) if x is not None)}]})
        found, error, written = None, None, None
        if head not in known_schemas:
            found, error = "unknown_tool", f"no tool is named {head}"
        else:
            try:
                arguments = parsed(body)
                written = line(arguments)
                if error := problem(arguments, known_schemas[head]):
                    found = "bad_arguments"
            except (TypeError, ValueError, RecursionError, ArithmeticError):
                found, error, written = "bad_json", "arguments are not JSON", None
        if found is None or status in ("repeated_id", "cycle"):
            found, error = status, {"repeated_id": "several calls have this identifier", "cycle": "it needs itself", "no_result": "no result has this identifier"}.get(status, error)
        return found, whole(error), written or line(body)

    known_schemas: dict[str, dict] = {}

    def write(batches):
        known_schemas.update({k: json.loads(v) for k, v in shared.items()})
        for b in batches:
            done = [one(*row) for row in zip(*(b.column(x).to_pylist() for x in ("kind", "call_id", "head", "body", "needs", "status")), strict=True)]
            columns = [b.column(x) for x in ("conv_id", "turn", "kind", "call_id", "level")] + [pa.array([x[i] for x in done], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "kind", "call_id", "level", "status", "error", "line"])

    kinds = dict(lines.dtypes)
    return lines.mapInArrow(write, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, kind int, call_id string, level int, status string, error string, line string")
