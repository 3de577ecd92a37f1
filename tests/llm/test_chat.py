import json
import random

from wayloom.llm import chat as op

CALLS = "conv_id long, turn long, position int, call_id string, tool string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"


def linked(spark, calls, results):
    schemas = op.default_schemas(spark)
    rows = op.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    return {(r["conv_id"], r["call_id"]): r for r in rows if r["kind"] == "call"}


def test_links_order_and_errors(spark):
    calls = [
        (1, 0, 0, "a", "search", '{"query":"x", "limit": 3}', []),
        (1, 0, 1, "b", "search", '{"limit":"many","query":"y"}', ["a"]),
        (1, 0, 2, "c", "search", '{"other":1}', ["b", "a"]),
        (1, 0, 3, "d", "search", '{"query":"q"}', ["e"]),
        (1, 0, 4, "e", "search", '{"query":"q"}', ["d"]),
        (1, 2, 0, "f", "nothing", "[1]", ["a", "zz"]),
        (1, 4, 0, "g", "search", '{"query":"q"}', ["f"]),
        (1, 4, 0, "g", "search", '{"query":"z"}', ["f"]),
        (2, 0, 0, "a", "search", None, []),
        (2, 0, 0, None, "search", None, []),
        (2, 1, 0, "b", "search", '{"query":"q"}', ["h"]),
        (2, 3, 0, "h", "search", '{"query":"q"}', []),
    ]
    results = [(1, 1, "a", "first"), (1, 2, "a", "second"), (1, 1, "c", None), (2, 5, "q", "stray"), (None, 1, "a", "x")]
    got = linked(spark, calls, results)
    assert len(got) == 11
    assert [got[1, k]["level"] for k in "abc"] == [0, 1, 2]
    assert got[1, "a"]["linked"] and got[1, "a"]["n_results"] == 2 and got[1, "a"]["valid"]
    assert got[1, "b"]["errors"] == "type limit"
    assert got[1, "c"]["errors"] == "missing query;unknown other" and got[1, "c"]["linked"]
    assert got[1, "d"]["errors"] == "cycle" == got[1, "e"]["errors"]
    assert got[1, "f"]["errors"] == "not an object;unknown reference;unknown tool"
    assert got[1, "g"]["valid"] and not got[1, "g"]["linked"]
    assert got[2, "a"]["errors"] == "missing query"
    assert got[2, "b"]["errors"] == "later reference"
    assert got[2, None]["errors"] == "missing query;no id" and not got[2, None]["linked"]
    record = json.loads(got[1, "a"]["json"])
    assert record["arguments"] == '{"limit":3,"query":"x"}' and record["result"] == "first"
    assert got[1, "a"]["json"] == json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_conversations_with_and_without_json(spark):
    message = '{"tool_calls":[{"id":"k","name":"search","arguments":"{\\"query\\":\\"x\\"}"}]}'
    rows = [
        (1, 0, "user", "hello there"), (1, 1, "assistant", message), (1, 2, "tool", '{"tool_call_id":"k","content":"found"}'), (1, 3, "assistant", "done"),
        (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, "user", "again {"), (None, None, None, None), (3, 0, "user", "{not json"),
    ]
    calls, results = op.messages_to_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["call_id"]): r for r in op.link_tool_calls(calls, results, op.default_schemas(spark)).collect() if r["kind"] == "call"}
    assert set(got) == {(1, "turn-0"), (1, "k"), (2, "turn-0"), (2, "turn-2"), (3, "turn-0")}
    assert got[1, "k"]["linked"] and not got[1, "turn-0"]["linked"] and got[2, "turn-0"]["linked"]
    assert all(r["valid"] for r in got.values())


def test_whole_table_matches_brute_force(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.collect()
    at = {(r["conv_id"], r["turn"]): r for r in rows}
    calls, results = op.messages_to_calls(turns)
    every = op.link_tool_calls(calls, results, op.default_schemas(spark)).collect()
    got = [r for r in every if r["kind"] == "call"]
    assert len(got) == sum(r["role"] == "user" for r in rows)
    lone = {(r["conv_id"], r["turn"]) for r in rows if r["role"] == "assistant" and getattr(at.get((r["conv_id"], r["turn"] - 1)), "role", None) != "user"}
    assert {(r["conv_id"], r["turn"]) for r in every if r["kind"] == "result"} == lone
    for r in got:
        reply = at.get((r["conv_id"], r["turn"] + 1))
        assert r["linked"] == (reply is not None and reply["role"] == "assistant") and r["valid"]
        record = json.loads(r["json"])
        assert json.loads(record["arguments"])["prompt"] == at[r["conv_id"], r["turn"]]["text"]
        assert record.get("result") == (reply["text"] if r["linked"] else None)


def brute(calls, results):
    """(conv, id, turn, position, occurrence, linked content, results) of calls, and orphans, by plain loops."""
    calls = sorted({(c[0], c[3], c[1], c[2], c[4], c[5], tuple(c[6])) for c in calls if None not in (c[0], c[3])}, key=lambda c: c[:4])
    out, owned, orphans = [], {c: [] for c in calls}, []
    for conv, turn, key, content in set(results):
        before = [c for c in calls if c[:2] == (conv, key) and c[2] <= turn]
        if before:
            owned[max(before, key=lambda c: c[2:4])].append((turn, content))
        else:
            orphans.append((conv, key, turn))
    seen = {}
    for c in calls:
        seen[c[:2]] = seen.get(c[:2], 0) + 1
        out.append((*c[:4], seen[c[:2]], min(owned[c])[1] if owned[c] else None, len(owned[c])))
    return sorted(map(str, out)), sorted(map(str, orphans))


def test_repeated_ids_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "SLAB", 4)
    rng = random.Random(6)
    calls, results = [], []
    for conv in range(12):
        for turn in range(30):
            for position in range(rng.randrange(3)):
                calls.append((conv, turn, position, f"call_{rng.randrange(3)}", "search", '{"query":"q"}', []))
            for _ in range(rng.randrange(3)):
                results.append((conv, turn, f"call_{rng.randrange(4)}", f"r{rng.randrange(99)}"))
    calls += calls[:20]  # repeated rows count once
    schemas = op.default_schemas(spark)
    rows = op.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results + results[:9], RESULTS), schemas).collect()
    got = sorted(
        str((r["conv_id"], r["call_id"], r["turn"], r["position"], r["occurrence"], json.loads(r["json"]).get("result"), r["n_results"])) for r in rows if r["kind"] == "call"
    )
    orphans = sorted(str((r["conv_id"], r["call_id"], r["turn"])) for r in rows if r["kind"] == "result")
    assert (got, orphans) == brute(calls, results)
    assert all(r["errors"] == "result without call" and not r["linked"] for r in rows if r["kind"] == "result")


def test_reused_id_early_result_and_null_ids(spark):
    calls = [(1, 2, 0, "a", "search", '{"query":"x"}', []), (1, 6, 0, "a", "search", '{"query":"y"}', ["a"]), (None, 1, 0, "b", "search", '{"query":"z"}', ["c"])]
    results = [(1, 1, "a", "early"), (1, 3, "a", "one"), (1, 7, "a", "two"), (None, 2, "b", "x"), (2, 5, None, "y")]
    rows = op.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), op.default_schemas(spark)).collect()
    got = {(r["kind"], r["conv_id"], r["call_id"], r["turn"]): (r["linked"], json.loads(r["json"]).get("result"), r["errors"]) for r in rows}
    assert got == {
        ("call", 1, "a", 2): (True, "one", ""), ("call", 1, "a", 6): (True, "two", ""), ("result", 1, "a", 1): (False, "early", "result without call"),
        ("call", None, "b", 1): (False, None, "no id;unknown reference"),
        ("result", None, "b", 2): (False, "x", "no id;result without call"), ("result", 2, None, 5): (False, "y", "no id;result without call"),
    }


def test_long_arguments(spark):
    text = "w" * 3_000_000
    got = linked(spark, [(1, 0, 0, "a", "search", json.dumps({"query": text}), [])], [(1, 1, "a", text)])
    assert got[1, "a"]["valid"] and json.loads(got[1, "a"]["json"])["result"] == text


def test_empty(spark):
    assert linked(spark, [], []) == {}
