import json
import random

from loomset.llm import tool_calls as tc

TOOLS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("find", "q", "string", True), ("find", "tags", "array", False)]


def message(spark, rows):
    return spark.createDataFrame([(c, t, r, x if x is None or isinstance(x, str) else json.dumps(x), "extra") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, level string")


def run(spark, rows):
    calls, results = tc.parsed(message(spark, rows))
    return {(r.conv_id, r.call_id): r for r in tc.linked(calls, results, tc.schemas(spark, TOOLS)).collect()}


def call(i, name, arguments, deps=None):
    return {"id": i, "name": name, "arguments": arguments, "depends_on": deps}


def test_links_levels_and_validation(spark):
    got = run(spark, [
        (1, 0, "user", "please add"),
        (1, 1, "assistant", {"tool_calls": [call("x", "add", {"b": 2.5, "a": 1}), call("y", "find", {"q": 3, "z": 1}, ["x"]), call("w", "find", {"tags": ["t"]}, ["y", "x", "gone"])]}),
        (1, 2, "tool", {"tool_call_id": "x", "content": "3.5"}),
        (1, 3, "tool", {"tool_call_id": "x", "content": "again"}),
        (1, 4, "tool", {"tool_call_id": "stray", "content": "?"}),
        (2, 0, "assistant", {"tool_calls": [call("x", "nope", {"k": {"b": 1, "a": [1, 2]}}), call("p", "find", {"q": "é\n"}, ["q"]), call("q", "find", {"q": "1"}, ["p"]), call("r", "find", {"q": "1"}, ["q"]), call("s", "find", {"q": "1"}, ["s"])]}),
        (None, 0, "assistant", {"tool_calls": [call("x", "add", {"a": 1, "b": 1})]}),
        (None, 1, "tool", {"tool_call_id": "x", "content": "2"}),
        (3, 0, "assistant", {"tool_calls": [call("d", "add", {"a": 1, "b": 1}), call("d", "add", {"a": 2, "b": 1}), call(None, "add", None)]}),
        (3, 1, "assistant", None), (3, 2, "tool", ""), (3, 3, None, "{"), (3, 4, "assistant", "not json"),
    ])
    x, y, w = (got[1, k] for k in "xyw")
    assert (x.status, x.level, x.result_turn, x.errors) == ("linked", 0, 2, ["repeated result"])
    assert (y.status, y.level, y.errors) == ("no result", 1, ["not string: q", "unknown z"])
    assert (w.level, w.errors) == (2, ["missing q", "unknown dependency"])
    assert got[1, "stray"].status == "no call" and got[1, "stray"].level is None
    assert x.json == '{"arguments":{"a":1,"b":2.5},"content":"3.5","errors":["repeated result"],"id":"x","level":0,"name":"add","status":"linked"}'
    assert got[2, "x"].errors == ["unknown tool"] and '"arguments":{"k":{"a":[1,2],"b":1}}' in got[2, "x"].json
    assert [got[2, k].status for k in "pqrs"] == ["cycle"] * 4
    assert got[None, "x"].status == "linked" and got[None, "x"].errors == []
    assert "repeated id" in got[3, "d"].errors and got[3, "turn/0/2"].errors == ["arguments aren't an object"]
    assert len(got) == 12


def test_long_chain(spark):
    got = run(spark, [(1, 0, "assistant", {"tool_calls": [call(f"c{k}", "add", {"a": k, "b": 0}, [f"c{k - 1}"] if k else []) for k in range(6)]})])
    assert [got[1, f"c{k}"].level for k in range(6)] == list(range(6))


def test_plain_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'q "1"\n'), (1, 2, "assistant", "a"), (1, 3, "user", None), (2, 0, "assistant", "first"), (2, 1, "user", ""), (None, 0, None, "x"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    got = {(r.conv_id, r.call_id): r for r in tc.linked(*tc.turns(message(spark, rows)), tc.turn_schemas(spark)).collect()}
    assert [(got[1, f"1:{k}"].level, got[1, f"1:{k}"].status) for k in (0, 1, 3)] == [(0, "no result"), (1, "linked"), (2, "no result")]
    assert json.loads(got[1, "1:1"].json) == {"arguments": {"text": 'q "1"\n'}, "content": "a", "errors": [], "id": "1:1", "level": 1, "name": "user", "status": "linked"}
    assert got[2, "2:null"].status == "no call" and got[5, "5:0"].errors == ["repeated id"] and got[None, "null:0"].errors == ["unknown tool"]


def test_empty_table(spark):
    empty = message(spark, [])
    assert tc.linked(*tc.turns(empty), tc.turn_schemas(spark)).count() == 0
    assert tc.linked(*tc.parsed(empty), tc.schemas(spark, TOOLS)).count() == 0


def brute_levels(deps):
    """Level of each call of a graph, None for those on a cycle or behind one."""
    level = {}
    while True:
        new = {c: 1 + max((level[d] for d in ds), default=-1) for c, ds in deps.items() if c not in level and all(d in level for d in ds)}
        if not new:
            return {c: level.get(c) for c in deps}
        level |= new


def test_levels_of_random_graphs(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(12):
        n = rng.randint(1, 30)
        back = rng.random() < 0.6  # now and then a dependency on a later call, which makes cycles
        deps = {f"k{i}": sorted({f"k{rng.randrange(n if back and rng.random() < 0.4 else max(i, 1))}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}) if i else [] for i in range(n)}
        rows += [(conv if conv else None, c, d) for c, d in deps.items()]
        want |= {(conv if conv else None, c): x for c, x in brute_levels(deps).items()}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in tc.levels(calls).collect()} == want
    assert None in want.values() and max(x for x in want.values() if x is not None) > 5
