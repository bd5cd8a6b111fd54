import json

import pytest
from heddle.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMA = "name string, parameter string, type string, required boolean"
TOOLS = [("f", "a", "integer", True), ("f", "b", "number", False), ("f", "c", "array", False), ("f", "d", "object", False), ("f", "e", "boolean", False), ("f", "s", "string", False)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "arguments,errors",
    [
        ('{"a": 1}', []),
        ('{"a": 1, "b": 2, "c": [1, "x"], "d": {"z": 1}, "e": true, "s": "t"}', []),
        ('{"b": 1.5}', ["missing a"]),
        ('{"a": "1", "s": 2, "q": 0}', ["unknown parameter q", "wrong type of a", "wrong type of s"]),
        ('{"a": null}', ["wrong type of a"]),
        ("[1]", ["arguments are not an object"]),
        ("{broken", ["arguments are not an object"]),
        (None, ["arguments are not an object"]),
    ],
)
def test_arguments_against_schemas(spark, arguments, errors):
    calls = frame(spark, [(1, "x", 1, "f", arguments, None), (1, "y", 2, "g", "{}", None)], CALLS)
    got = {r.call_id: r.errors for r in chat.validated(calls, frame(spark, TOOLS, SCHEMA)).collect()}
    assert got == {"x": errors, "y": ["unknown tool"]}


def test_links_orphans_and_repeats(spark):
    calls = frame(spark, [(1, "x", 1, "f", "{}", None), (1, "x", 3, "f", "{}", None), (1, None, 4, "f", "{}", None), (2, "x", 1, "f", "{}", None), (None, "n", 1, "f", "{}", None)], CALLS)
    results = frame(spark, [(1, "x", 5, "late"), (1, "x", 2, "soon"), (1, None, 2, "?"), (3, "x", 2, "lost")], RESULTS)
    got = sorted(((r.conv_id, r.call_id, r.turn, r.result, r.repeated) for r in chat.linked(calls, results).collect()), key=str)
    assert got == sorted([(1, "x", 1, "soon", False), (1, "x", 3, "soon", True), (1, None, 4, None, False), (2, "x", 1, None, False), (None, "n", 1, None, False)], key=str)
    assert sorted(r.content for r in chat.orphans(calls, results).collect()) == ["?", "lost"]


def test_layers_follow_dependencies(spark):
    rows = [(1, f"c{i}", i, "f", "{}", [f"c{i - 1}", "gone", None]) for i in range(5)]  # turns are an order
    rows += [(2, f"c{i}", i, "f", "{}", [f"c{i + 1}"] if i < 4 else None) for i in range(5)]  # backwards
    rows += [(3, "a", 0, "f", "{}", ["b"]), (3, "b", 1, "f", "{}", ["a"]), (3, "c", 2, "f", "{}", ["b"]), (3, "d", 3, "f", "{}", [])]  # a cycle
    calls = frame(spark, rows, CALLS).withColumn("repeated", chat.F.lit(False))
    got = {(r.conv_id, r.call_id): r.layer for r in chat.layered(calls).collect()}
    assert got == {(1, f"c{i}"): 0 for i in range(5)} | {(2, f"c{i}"): 4 - i for i in range(5)} | {(3, "a"): -1, (3, "b"): -1, (3, "c"): -1, (3, "d"): 0}


def test_layers_of_long_chains_and_meshes(spark):
    """A reversed chain of 600 (one round for each call would be 600 jobs), and random dependencies against
    plain recursion."""
    import random

    draw = random.Random(3)
    rows = [(1, f"c{i}", i, "f", "{}", [f"c{i + 1}"]) for i in range(600)] + [(1, "c600", 600, "f", "{}", None)]
    place = list(range(40))
    draw.shuffle(place)
    deps = {i: draw.sample(range(i), min(i, draw.choice([0, 1, 1, 2, 3]))) for i in range(40)}
    rows += [(2, f"d{i}", place[i], "f", "{}", [f"d{j}" for j in deps[i]]) for i in range(40)]
    depth = {}
    for i in range(40):
        depth[i] = 1 + max((depth[j] for j in deps[i]), default=-1)
    calls = frame(spark, rows, CALLS).withColumn("repeated", chat.F.lit(False))
    got = {(r.conv_id, r.call_id): r.layer for r in chat.layered(calls).collect()}
    assert got == {(1, f"c{i}"): 600 - i for i in range(601)} | {(2, f"d{i}"): depth[i] for i in range(40)}


def test_canonical_json_of_odd_values(spark):
    texts = {'{"b": 1, "a": "\\ud800x"}': '{"a":"\\ud800x","b":1}', '{"a": "\\ud83d\\ude00"}': '{"a":"😀"}', "[NaN]": '"[NaN]"', "-Infinity": '"-Infinity"', "[" * 200_000: '"' + "[" * 200_000 + '"', "[" * 3 + "]" * 3: "[[[]]]", "1e999": "1e999", "": '""', '{"a":1,"a":2}': '{"a":2}'}
    df = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", chat.canonical(chat.F.col("t")).alias("j")).collect()}
    assert got == dict(enumerate(texts.values())) | {99: None}


def test_null_identifiers_and_repeated_rows(spark):
    calls = frame(spark, [(1, None, i % 3, "f", "{}", None) for i in range(60)] + [(1, "x", 1, "f", "{}", None)] * 40, CALLS)
    got = chat.linked(calls, frame(spark, [], RESULTS)).collect()
    assert len(got) == 100 and sum(r.repeated for r in got) == 39


def test_whole_table_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = chat.op10_chat(spark, sf).collect()
    turns = {(r["conv_id"], r["turn"]) for r in rows if r["role"] == "user"}
    want, after = [], {}
    for c, t in turns:
        place = t // 2 % 4
        after[c, t] = [(c, t + 2 * k) for k in ([1], [], [-1, -2], [-1])[place] if (c, t + 2 * k) in turns]
    tangled = {c for (c, t), deps in after.items() for _, d in deps if d >= t}

    def layer(key):
        return 1 + max(map(layer, after[key])) if key[0] in tangled and after.get(key) else 0

    assert {layer(k) for k in turns} == {0, 1, 2, 3}
    for r in rows:
        c, t, text = r["conv_id"], r["turn"], r["text"]
        if r["role"] == "user":
            n = len(text or "")
            args = {"limit": str(n) if n % 11 == 0 else n, "query": text}
            call = {"arguments": args, "id": f"call-{c}-{t}", "name": ["search", "summarise", "translate"][n % 3]}
            want.append((c, layer((c, t)), t, "1 call", "wrong type of limit" if n % 11 == 0 else "", {"role": "assistant", "tool_calls": [call]}))
        elif r["role"] == "assistant":
            want.append((c, layer((c, t - 1)) if (c, t - 1) in turns else 0, t, "2 result", "" if (c, t - 1) in turns else "no call", {"content": text, "role": "tool", "tool_call_id": f"call-{c}-{t - 1}"}))
        else:
            want.append((c, 0, t, "0 message", "", {"content": text, "role": r["role"]}))
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert sorted((r.conv_id, r.layer, r.turn, r.kind, r.errors, r.json) for r in got) == sorted((*w[:5], dump(w[5])) for w in want)


def test_nulls_long_texts_and_empty_tables(spark):
    conv = frame(spark, [(1, 0, "user", None, "x"), (1, 1, "assistant", None, "x"), (None, 0, None, None, None), (2, 0, "user", 'quote " \\ \n tab\t end\u0001', "x"), (2, 0, "user", "again", "x"), (3, 0, "system", "y" * 300_000, "x")], "conv_id long, turn long, role string, text string, name string")
    rows = chat.formatted(*chat.derived(conv)).collect()
    assert len(rows) == 6
    for r in rows:
        json.loads(r.json)
    assert chat.formatted(*chat.derived(conv.filter("false"))).count() == 0


def test_numbers_of_any_size_stay_numbers(spark):
    long = "9" * 5000
    cases = {'{"b":1e400,"a":-1E999}': '{"a":-1E999,"b":1e400}', f"[{long}, -{long}, 1]": f"[{long},-{long},1]", "1.50": "1.5", "[1E2, 1e-400]": "[100.0,0.0]", '{"a":NaN}': '"{\\"a\\":NaN}"', '{"z":[{"y":1,"x":[]}],"z":{}}': '{"z":{}}', "-0": "0", '"\\ud800"': '"\\ud800"'}
    got = {r.x: r.y for r in spark.createDataFrame([(c,) for c in cases], "x string").select("x", chat.canonical(chat.F.col("x")).alias("y")).collect()}
    assert got == cases
