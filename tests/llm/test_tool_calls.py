"""op1 against brute force on made conversations."""

import json
import random

import duckdb
import pytest

from pairwell.llm import queries, tool_calls

TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number", "minimum": 0}}, "required": ["a"], "additionalProperties": False}, "say": {"type": "object", "properties": {"t": {"type": "string", "maxLength": 3}, "l": {"type": "array", "items": {"enum": ["x", 1]}, "maxItems": 2}}}}


def brute(rows):
    parsed = [tool_calls.read_message(r[3], TOOLS) for r in rows]
    low = -(1 << 63)
    key = lambda r: low if r is None else r
    first, answer = {}, {}
    for k, (r, (_, calls, result)) in enumerate(zip(rows, parsed, strict=True)):
        for c in calls:
            if c["id"] is not None:
                first.setdefault((key(r[0]), c["id"]), []).append((key(r[1]), k, c["at"], c["depends_on"]))
        if result is not None:
            answer.setdefault((key(r[0]), result), []).append((key(r[1]), k))
    first, answer = {a: min(b) for a, b in first.items()}, {a: min(b) for a, b in answer.items()}
    level, now = {}, True
    while now:
        now = [x for x, f in first.items() if x not in level and all((x[0], d) not in first or (x[0], d) in level for d in f[3])]
        level |= {x: 1 + max([-1, *(level[x[0], d] for d in first[x][3] if (x[0], d) in level)]) for x in now}
    out = []
    for k, (r, (content, calls, result)) in enumerate(zip(rows, parsed, strict=True)):
        m, linked, levels = {"role": r[2], "content": content}, 0, []
        for c in calls:
            x = (key(r[0]), c["id"])
            mine = first.get(x, (0, -1, 0))[1:3] == (k, c["at"])
            turn = answer[x][0] if mine and x in answer and answer[x][0] > first[x][0] else None
            linked += turn is not None
            levels += [level[x]] if mine and x in level else []
            m.setdefault("tool_calls", []).append({"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"]), "level": level.get(x) if mine else None, "result_turn": turn} | ({"error": c["error"]} if c["error"] else {}))
        link = None
        if result is not None:
            x = (key(r[0]), result)
            link = "orphan" if x not in first else "duplicate" if answer[x][1] != k else "linked" if answer[x][0] > first[x][0] else "early"
            m |= {"tool_call_id": result, "link": link}
        out.append((r[0], r[1], r[2], len(calls), sum(c["error"] is None for c in calls), linked, max(levels, default=None), link, tool_calls.canonical(m)))
    return sorted(out, key=str)


def made():
    rng = random.Random(6)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.randrange(1, 14)):
            ids = [f"c{rng.randrange(6)}" for _ in range(rng.randrange(1, 4))]
            call = lambda i: {"id": i, "name": rng.choice(["add", "say", "nope"]), "arguments": rng.choice([{"a": 1}, {"a": 1.0, "b": -1}, {"b": 2}, '{"a": 2}', "{", {"t": "long text"}, {"l": ["x", 1]}, {"l": [2]}, {"z": {"y": [1, 2.50]}}]), **({"depends_on": rng.sample(["c0", "c1", "c2", "c3", "gone"], 2)} if rng.random() < 0.5 else {})}
            text = rng.choice(["plain", None, "", "{bad", '{"other": 1}', json.dumps({"tool_calls": list(map(call, ids)), "content": "é"}), json.dumps({"tool_calls": list(map(call, ids))}), json.dumps({"tool_call_id": ids[0], "content": {"b": 1, "a": 2}}), '{"tool_calls": "x"}'])
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", "tool", None]), text))
    return rows


def test_brute_force(spark):
    rows = made()
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, link string, row int").coalesce(1)
    assert sorted(map(tuple, tool_calls.linked_messages(data, TOOLS).collect()), key=str) == brute(rows)
    assert tool_calls.linked_messages(data.limit(0), TOOLS).count() == 0


def test_cycles_and_levels(spark):
    call = lambda i, *d: {"id": i, "name": "add", "arguments": {"a": 1}, "depends_on": list(d)}
    text = json.dumps({"tool_calls": [call("a", "b"), call("b", "c"), call("c"), call("x", "y"), call("y", "x"), call("z", "x"), call("s", "s")]})
    data = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    (row,) = tool_calls.linked_messages(data, TOOLS).collect()
    assert [c["level"] for c in json.loads(row.message)["tool_calls"]] == [2, 1, 0, None, None, None, None]


@pytest.mark.parametrize("value,text", [({"b": 1.0, "a": [-0.0, 1e16, 0.1]}, '{"a":[0,1e+16,0.1],"b":1}'), ("é \n", '"é \\n"'), (True, "true")])
def test_canonical(value, text):
    assert tool_calls.canonical(value) == text and tool_calls.canonical(json.loads(text)) == text


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op1_tool_calls(spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cursor = con.execute(queries.ORACLE["op1_tool_calls"])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(rows[0].__fields__)
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == sorted(map(tuple, cursor.fetchall()), key=str)
    assert sum(r.n_calls for r in rows) > 400 and sum(r.n_linked for r in rows) > 100 and max(r.max_level or 0 for r in rows) > 3


def test_what_used_to_crash(spark):
    call = lambda arguments: '{"tool_calls":[{"id":"a","name":"add","arguments":' + arguments + "}]}"
    deep = lambda n: "[" * n + "]" * n
    texts = [
        call('{"a":' + "9" * 400 + "}"), call('{"a":' + "9" * 5000 + "}"), call('{"a":' + deep(5000) + "}"), call('{"a":' + deep(50) + "}"), call('"' + deep(5000) + '"'), call('{"a":1e999}'), call('{"a":NaN}'),
        '{"tool_call_id":"a","content":[1e999]}', '{"tool_call_id":"a","content":"x\\ud800y"}', '{"tool_call_id":{"b":1},"content":"\\ud83d\\ude00"}', '{"tool_calls":[{"id":{"b":1},"name":"add","arguments":{"a":1}}]}', call('{"a":1,"\\udfff":2}'), '{"a":' * 100_000,
    ]
    data = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows = sorted(tool_calls.linked_messages(data, TOOLS).collect())
    assert [r.n_calls for r in rows] == [1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 1, 0]
    assert [r.n_valid for r in rows] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0]
    said = [json.loads(r.message) for r in rows]
    assert said[0]["tool_calls"][0]["arguments"]["a"] == int("9" * 400) and said[4]["tool_calls"][0]["error"] == "$: not JSON"
    assert all(said[i] == {"content": texts[i], "role": "assistant"} for i in (1, 2, 5, 6, 7, 12))
    assert said[8]["content"] == "x\ufffdy" and said[9]["content"] == "\U0001f600" and said[9]["tool_call_id"] == said[10]["tool_calls"][0]["id"] == '{"b":1}'


def test_long_chains_take_few_rounds(spark, monkeypatch):
    call = lambda i, *d: {"id": str(i), "name": "add", "arguments": {"a": 1}, "depends_on": list(map(str, d))}
    calls = [call(0)] + [call(i, i - 1) for i in range(1, 120)] + [call("m", 119, 50), call("n", "m"), call("o", "n", "m")] + [call("x", "z"), call("y", "x"), call("z", "y"), call("w", "x", 3), call("v", "z")]
    saves, plain = [], tool_calls.save
    monkeypatch.setattr(tool_calls, "save", lambda df: saves.append(1) or plain(df))
    data = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id long, turn long, role string, text string")
    (row,) = tool_calls.linked_messages(data, TOOLS).collect()
    assert [c["level"] for c in json.loads(row.message)["tool_calls"]] == [*range(120), 120, 121, 122, None, None, None, None, None]
    assert len(saves) < 30


@pytest.mark.parametrize("schema", [{"pattern": "x"}, {"properties": {"a": {"anyOf": []}}}, {"items": {"$ref": "#"}}, {"additionalProperties": {"multipleOf": 2}}, {"type": "int"}])
def test_unknown_schemas_are_errors(spark, schema):
    data = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError, match="unknown"):
        tool_calls.linked_messages(data, {"t": schema})


def test_a_bad_element_leaves_the_other_calls(spark):
    calls = [None, {"id": "a", "name": "add", "arguments": {"a": 1}}, "x", {"id": "b", "name": "add", "arguments": {"a": 2}}]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls})), (1, 1, "tool", '{"tool_call_id": "b", "content": "2"}')]
    call, result = sorted(tool_calls.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect())
    assert (call.n_calls, call.n_valid, call.n_linked, result.link) == (2, 2, 1, "linked")


def test_long_unclosed_strings_take_linear_time():
    import time

    began = time.time()
    for text in ('{"' + '\\"' * 500_000, '{"' + "a" * 1_000_000, '["' + "\\\\" * 500_000 + '", ', '"' * 1_000_001):
        with pytest.raises(ValueError):
            tool_calls.parsed(text)
    assert time.time() - began < 5
    assert tool_calls.parsed('{"a[{": "]}\\"[", "b": [1]}') == {"a[{": ']}"[', "b": [1]}
    with pytest.raises(ValueError, match="deep"):
        tool_calls.parsed("[" * 300 + "]" * 300)
