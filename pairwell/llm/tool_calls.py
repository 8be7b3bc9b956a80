"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

A message's text is plain, or a JSON object with `tool_calls` (a list of id, name, arguments and,
optionally, depends_on: ids of calls it needs), or one with `tool_call_id` (a result), each with
optional `content`. Anything else is plain text.

Calls and results are reduced to the first of each (conversation, identifier) before they are joined
by equality, so repeated identifiers never multiply. Calls are ordered by levels: a call's level is
one more than the highest of those it depends on. Chains of calls with one dependency each are
shortened by pointer doubling, so a chain of n calls takes log n rounds; then a round resolves the
calls with several dependencies of which all are resolved. What no round resolves is a cycle. Arguments are checked against a subset of JSON
Schema. Messages are written as canonical JSON: sorted keys, no spaces, shortest numbers, NFC-free
text as it is. All is by message; no conversation is gathered in one place.

What can't be read as JSON stays plain text: objects with numbers beyond doubles, or nested deeper
than MOST_DEPTH. Halves of surrogate pairs in them become U+FFFD.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .runtime import drop, save, ship

#: Levels of nesting of a JSON text.
MOST_DEPTH = 200
#: Bytes of messages in Python at a time, about.
SLICE = 4 << 20
_HALF = re.compile("[\ud800-\udfff]")

_CALL = "struct<at:long,id:string,name:string,arguments:string,error:string,depends_on:array<string>>"
# The keywords that violation() checks, and those that only describe.
_KEYWORDS = frozenset("type enum const minimum maximum minLength maxLength minItems maxItems items properties required additionalProperties".split())
_NOTES = frozenset("title description default examples $schema $id $comment deprecated readOnly writeOnly".split())
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """One JSON text for equal values; -0 and whole floats are integers. Raises ValueError for what JSON lacks."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violation(value, schema: dict, at: str = "$") -> str | None:
    """The first violation of schema, or None: type, enum, const, bounds, lengths, items, properties, required."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not any(number and (k == "number" or isinstance(value, int) or value.is_integer()) if k in ("number", "integer") else isinstance(value, _TYPES.get(k, ())) for k in kinds):
            return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]) or "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not an allowed value"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            return f"{at}: out of bounds"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{at}: wrong length"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            return f"{at}: wrong number of items"
        return next(filter(None, (violation(x, schema.get("items", {}), f"{at}[{i}]") for i, x in enumerate(value))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            rest = schema.get("additionalProperties", True)
            if name not in known and rest is False:
                return f"{at}.{name}: unknown"
            own = known.get(name, rest if isinstance(rest, dict) else {})
            if found := violation(value[name], own, f"{at}.{name}"):
                return found
    return None


def known(schema: dict, at: str = "$") -> None:
    """Raises ValueError for a schema that violation() cannot check whole."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema object")
    if unknown := sorted(set(schema) - _KEYWORDS - _NOTES):
        raise ValueError(f"{at}: unknown schema keywords {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if bad := sorted(set(map(str, kinds if isinstance(kinds, list) else [kinds])) - set(_TYPES) - {"number", "integer"}):
        raise ValueError(f"{at}: unknown types {', '.join(bad)}")
    for name, own in schema.get("properties", {}).items():
        known(own, f"{at}.{name}")
    if "items" in schema:
        known(schema["items"], f"{at}[]")
    if not isinstance(schema.get("additionalProperties", True), bool):
        known(schema["additionalProperties"], f"{at}.*")


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("a number beyond doubles")
    return value


#: Strings, also one that never ends, and brackets; nothing is tried twice, so time is linear.
_BRACKETS = re.compile(r'"(?:[^"\\]++|\\.)*+"?|[\[\]{}]', re.S)


def parsed(text: str):
    """The value of a JSON text; raises ValueError for what isn't one (see the module)."""
    depth = most = 0
    for c in _BRACKETS.findall(text):
        depth += (c in "[{") - (c in "]}")
        most = max(most, depth)
    if most > MOST_DEPTH:
        raise ValueError("nested too deep")
    value = json.loads(text, parse_float=_number, parse_constant=_number)

    def whole(x):
        if isinstance(x, str):
            return _HALF.sub("\ufffd", x)
        if isinstance(x, dict):
            return {whole(k): whole(v) for k, v in x.items()}
        return [whole(v) for v in x] if isinstance(x, list) else x

    return whole(value) if "\\u" in text else value


def _object(text: str | None) -> dict:
    """The JSON object that a text is, or an empty one."""
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        found = parsed(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _id(value) -> str | None:
    """An identifier as text: a string itself, anything else as canonical JSON."""
    return value if value is None or isinstance(value, str) else canonical(value)


def read_message(text: str | None, tools: dict[str, dict]) -> tuple[str | None, list[dict], str | None]:
    """Content, calls and the id that the message is a result of."""
    found = _object(text)
    calls, listed = [], found.get("tool_calls")
    if isinstance(listed, list):
        for at, c in enumerate(listed):
            if not isinstance(c, dict):
                continue
            raw, error = c.get("arguments", {}), None
            if isinstance(raw, str):
                try:
                    raw = parsed(raw)
                except ValueError:
                    error = "$: not JSON"
            name = c.get("name") if isinstance(c.get("name"), str) else None
            if error is None:
                error = "unknown tool" if name not in tools else violation(raw, tools[name])
            needs = c.get("depends_on")
            needs = sorted({_id(x) for x in needs if x is not None}) if isinstance(needs, list) else []
            calls.append({"at": at, "id": _id(c.get("id")), "name": name, "arguments": canonical(raw), "error": error, "depends_on": needs})
    result = found.get("tool_call_id") if not calls else None
    if not calls and result is None:
        return text, [], None
    content = found.get("content")
    return (content if content is None or isinstance(content, str) else canonical(content)), calls, _id(result)


def _levels(calls: DataFrame) -> DataFrame:
    """conv, id and level of the first call (conv, id, depends_on) of each identifier; null on and behind cycles; saved."""
    key = ["conv", "id"]
    nodes = calls.select(*key)
    edges = save(calls.select(*key, F.explode("depends_on").alias("dep")).join(nodes.select("conv", F.col("id").alias("dep")), ["conv", "dep"]))
    degrees = edges.groupBy(*key).agg(F.count("*").alias("needs"), F.min("dep").alias("dep"))
    steps = save(degrees.where("needs = 1").select(*key, F.col("dep").alias("to"), F.lit(1).cast("long").alias("far")))
    chained = steps.count()
    for _ in range(chained.bit_length() + 1):  # a longer way leads round a cycle
        next_ = steps.select("conv", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        joined = steps.join(next_, ["conv", "to"], "left")
        moved = save(joined.select(*key, F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("to2").isNotNull().alias("moved")))
        drop(steps)
        steps = moved
        if moved.where("moved").isEmpty():
            break
    # ways that end: where a call has no dependency, or several
    ends = save(steps.join(steps.select("conv", F.col("id").alias("to")), ["conv", "to"], "left_anti").select(*key, "to", "far"))
    several = degrees.where("needs > 1").select(*key, "needs")
    direct = edges.join(several, key).select("conv", F.col("dep").alias("at"), F.col("id").alias("user"), "needs")
    over = ends.select("conv", F.col("id").alias("at"), "to", "far")
    ways = direct.join(over, ["conv", "at"], "left").select("conv", F.col("user").alias("id"), "needs", F.coalesce("to", "at").alias("to"), F.coalesce("far", F.lit(0)).alias("far"))
    ways = save(ways)
    levels = [save(nodes.join(degrees, key, "left_anti").withColumn("level", F.lit(0).cast("long")))]
    while not ways.isEmpty():
        known = levels[-1].select("conv", F.col("id").alias("to"), "level")
        tried = ways.join(known, ["conv", "to"]).groupBy(*key, "needs").agg(F.count("*").alias("found"), F.max(F.col("level") + F.col("far")).alias("below"))
        new = tried.where("found = needs").select(*key, (F.col("below") + 1).alias("level"))
        new = save(new.unionByName(levels[-1]))  # all that is known so far
        left = save(ways.join(new, key, "left_anti"))
        settled = new.count() == levels[-1].count()
        drop(levels.pop(), ways)
        levels.append(new)
        ways = left
        if settled:
            break
    known = levels[0].select("conv", F.col("id").alias("to"), F.col("level").alias("base"))
    chain = ends.join(known, ["conv", "to"]).select(*key, (F.col("base") + F.col("far")).alias("level"))
    found = levels[0].unionByName(chain)
    out = save(nodes.join(found, key, "left").select(*key, "level"))
    drop(edges, steps, ends, ways, levels[0])
    return out


def _pieces(batches):
    """Batches in pieces of about SLICE bytes."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def linked_messages(messages: DataFrame, tools: dict[str, dict], *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, n_calls, n_valid, n_linked, max_level, link and message of every row.

    tools: JSON schema of the arguments by tool name; a keyword that isn't checked raises ValueError.
    Elements of tool_calls that aren't objects are skipped. link says of a result: linked, duplicate (not the
    first of its call), early (before its call) or orphan; null otherwise. n_linked counts the
    message's calls that a later result answers; only the first call of an identifier is answered. A
    call's entry holds its canonical arguments, the turn of its result, its level (null on a cycle)
    and what is wrong with its arguments. Null texts, turns, roles and conversations stay null (null
    conversations are one); rows repeated within a conversation count as repeats of their calls;
    other columns are not read; an empty table gives no rows.
    """
    for name, schema in tools.items():
        known(schema, name)
    spark = messages.sparkSession
    ship(spark)

    def read(batches):
        for batch in wordhash.slices(batches, 4, SLICE):
            content, calls, results = zip(*(read_message(t, tools) for t in batch.column(4).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            kind = pa.list_(pa.struct([("at", pa.int64()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("error", pa.string()), ("depends_on", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(content, pa.string()), pa.array(calls, kind), pa.array(results, pa.string())], names=["row", "conv", "turn", "role", "content", "calls", "result_of"])

    rows = messages.select(F.monotonically_increasing_id().alias("row"), F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = save(rows.mapInArrow(read, f"row long, conv long, turn long, role string, content string, calls array<{_CALL}>, result_of string"))
    conv = F.coalesce("conv", F.lit(-(1 << 63))).alias("conv")
    turn = F.coalesce("turn", F.lit(-(1 << 63)))

    calls = rows.where(F.size("calls") > 0).select("row", conv, turn.alias("turn"), F.explode("calls").alias("c")).select("row", "conv", "turn", "c.*")
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "row", "at", "depends_on")).alias("f"))
    first = save(first.select("conv", "id", "f.turn", "f.row", "f.at", "f.depends_on"))
    results = rows.where("result_of is not null").select("row", conv, turn.alias("turn"), F.col("result_of").alias("id"))
    answers = results.groupBy("conv", "id").agg(F.min(F.struct("turn", "row")).alias("r"))
    pairs = first.join(answers, ["conv", "id"]).select("conv", "id", F.col("turn").alias("call_turn"), F.col("r.turn").alias("result_turn"), F.col("r.row").alias("result_row"))
    pairs = save(pairs.withColumn("link", F.when(F.col("result_turn") > F.col("call_turn"), "linked").otherwise("early")))

    state = _levels(first).join(first.drop("depends_on", "turn"), ["conv", "id"]).join(pairs.where("link = 'linked'").select("conv", "id", "result_turn"), ["conv", "id"], "left")
    per_message = state.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "level", "result_turn"))).alias("state"), F.count("result_turn").alias("n_linked"), F.max("level").alias("max_level"))
    of_results = results.join(pairs.select("conv", "id", "result_row", "link"), ["conv", "id"], "left").select("row", F.when(F.col("link").isNull(), "orphan").when(F.col("row") == F.col("result_row"), F.col("link")).otherwise("duplicate").alias("link"))
    whole = rows.join(per_message, "row", "left").join(of_results, "row", "left")

    def write(batches):
        for batch in _pieces(batches):
            texts, valid = [], []
            for m in batch.to_pylist():
                out = {"role": m["role"], "content": m["content"]}
                if m["calls"]:
                    state = {s["at"]: s for s in m["state"] or ()}
                    out["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"]), "level": state.get(c["at"], {}).get("level"), "result_turn": state.get(c["at"], {}).get("result_turn")} | ({"error": c["error"]} if c["error"] else {}) for c in m["calls"]]
                if m["result_of"] is not None:
                    out |= {"tool_call_id": m["result_of"], "link": m["link"]}
                texts.append(canonical(out))
                valid.append(sum(c["error"] is None for c in m["calls"] or ()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("conv", "turn", "role")), pa.array([len(c or ()) for c in batch.column("calls").to_pylist()], pa.int64()), pa.array(valid, pa.int64()), *(batch.column(k) for k in ("n_linked", "max_level", "link")), pa.array(texts, pa.string())], names=["conv_id", "turn", "role", "n_calls", "n_valid", "n_linked", "max_level", "link", "message"])

    whole = whole.withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
    return whole.mapInArrow(write, "conv_id long, turn long, role string, n_calls long, n_valid long, n_linked long, max_level long, link string, message string")
