"""Chat formatting against graphs and JSON in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logweir.llm import chat_view, queries
from logweir.llm.chat_format import canonical, format_chat, place_nodes, validate_arguments

SF_DIR = "/root/testdata/sf0.001"
MESSAGES = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, needs array<string>, status string"


@pytest.mark.parametrize("seed", range(5))
def test_places_are_topological(spark, seed):
    rng = random.Random(seed)
    n = 40
    nodes = [(1, f"n{k}", k) for k in range(n)]
    order = rng.sample(range(n), n)
    # Needs go down a random order, so there is no cycle; many are against the turns.
    needs = [(1, f"n{order[b]}", f"n{order[a]}") for a in range(n) for b in range(a + 1, n) if rng.random() < 0.05] + [(1, "n0", "absent")]
    found = place_nodes(spark.createDataFrame(nodes, "conv_id long, node_id string, turn long"), spark.createDataFrame(needs, "conv_id long, node_id string, needed_id string"))
    place = {row.node_id: (row.at, row.depth) for row in found.collect()}
    assert all(place[needed] < place[node] for _, node, needed in needs if needed in place)
    assert all(place[f"n{k}"][0] >= k for k in range(n)) and not found.where("cyclic").count()


def test_nodes_in_order_keep_their_turn(spark):
    nodes = spark.createDataFrame([(1, f"n{k}", k) for k in range(50)], "conv_id long, node_id string, turn long")
    needs = spark.createDataFrame([(1, f"n{k}", f"n{k - 1}") for k in range(1, 50)], "conv_id long, node_id string, needed_id string")
    assert {(row.node_id, row.at, row.depth) for row in place_nodes(nodes, needs).collect()} == {(f"n{k}", k, 0) for k in range(50)}


def test_cycles(spark):
    nodes = spark.createDataFrame([(c, i, t) for c in (1, 2) for i, t in (("a", 0), ("b", 1), ("c", 2), ("d", 3))], "conv_id long, node_id string, turn long")
    needs = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "c"), (2, "a", "d")], "conv_id long, node_id string, needed_id string")
    found = {(row.conv_id, row.node_id): (row.at, row.depth, row.cyclic) for row in place_nodes(nodes, needs).collect()}
    assert [found[1, i] for i in "abcd"] == [(0, 0, True), (1, 0, True), (2, 0, True), (3, 0, False)]
    assert found[2, "a"] == (3, 1, False)


def test_arguments(spark):
    cases = [
        ('{"query":"x","limit":3}', "search", []), ('{"limit":3.5,"query":1}', "search", ["type limit", "type query"]),
        ('{"query":"x","limit":3,"more":[1]}', "search", ["unknown more"]), ('{"query":null}', "search", ["missing limit", "type query"]),
        ("[1]", "search", ["no object"]), ("not json", "search", ["no object"]), (None, "search", ["no object"]), ("{}", "nothing", ["unknown tool"]),
        ('{"key":"k","depth":2}', "lookup", []), ('{"key":"k","depth":2.5}', "lookup", []), ('{"key":"k","depth":{"a":1}}', "lookup", ["type depth"]),
    ]
    calls = spark.createDataFrame([(1, f"c{k}", tool, text) for k, (text, tool, _) in enumerate(cases)], "conv_id long, call_id string, tool string, arguments string")
    found = {row.call_id: row.errors for row in validate_arguments(calls, chat_view.parameters(spark)).collect()}
    assert found == {f"c{k}": errors for k, (_, _, errors) in enumerate(cases) if errors}


def test_messages(spark):
    rows = [
        (1, 0, "user", "q", "a", "search", '{"limit": 1.0e0,"query":"\\u00e9", "limit":2}', ["b"], "x"), (1, 1, "tool", "r", "a", None, None, None, "x"),
        (1, 2, "user", None, "b", "count", "{}", None, "x"), (1, 3, "tool", "?", "z", None, None, None, "x"), (1, 4, "system", 'say "hi"\n', None, None, None, None, "x"),
        (None, 0, "user", "q", "a", "search", "{}", None, "x"), (2, 0, None, None, None, None, None, None, "x"), (2, 0, None, None, None, None, None, None, "x"),
        (3, 0, "user", "q", None, "search", "{}", None, "x"), (4, None, "tool", "r", "a", None, None, None, "x"),
    ]
    messages = spark.createDataFrame(rows, MESSAGES)
    found = format_chat(messages, chat_view.parameters(spark)).collect()
    assert len(found) == len(rows) and format_chat(messages.limit(0), chat_view.parameters(spark)).count() == 0
    by = {(row.conv_id, row.turn): row for row in found}
    assert json.loads(by[1, 0].message)["call"] == {"arguments": {"limit": 2, "query": "é"}, "id": "a", "name": "search", "valid": True}
    assert by[1, 4].message == '{"content":"say \\"hi\\"\\n","role":"system"}'
    assert by[1, 1].message == '{"content":"r","role":"tool","tool_call_id":"a"}'
    assert by[2, 0].message == '{"content":null,"role":null}'
    assert [by[1, k].status for k in range(5)] == ["answered", "result", "unanswered", "orphan", "plain"] and by[None, 0].status == "unanswered"
    assert [(by[1, k].order_turn, by[1, k].order_depth) for k in range(5)] == [(2, 1), (2, 2), (2, 0), (3, 0), (4, 0)]
    assert by[1, 2].errors == "missing text; missing unit" and by[1, 1].errors is None and by[1, 0].errors == ""


def test_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    found = {(row.conv_id, row.turn): row for row in queries.op9_chat_format(spark, SF_DIR).collect()}
    assert len(found) == len(rows)
    role = {(row.conv_id, row.turn): row.role for row in rows}
    for row in rows:
        c, t = row.conv_id, row.turn
        got = found[c, t]
        if row.role == "user":
            status = "answered" if role.get((c, t + 1)) == "assistant" else "unanswered"
        else:
            status = "plain" if row.role == "system" else "result" if role.get((c, t - 1)) == "user" else "orphan"
        assert got.status == status
        read = json.loads(got.message)
        assert read["content"] == row.text and json.dumps(read, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == got.message
        if row.role == "user":
            assert row.text in read["call"]["arguments"].values() or got.errors == "type key"


def test_no_python_in_the_plan(spark):
    plan = queries.op9_chat_format(spark, SF_DIR)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and "Pandas" not in plan and "BatchEvalPython" not in plan


NUMBERS = {
    "0": "0", "-0.0": "0", "1.0": "1", "1e2": "100", "100": "100", "1.50": "1.5", "0.1": "0.1", "1e-1": "0.1", "-25e-1": "-2.5", "1e20": "100000000000000000000",
    "1e21": "1e+21", "100000000000000000000000000000000000000000": "1e+41", "123456.7e-9": "0.0001234567", "1e-6": "0.000001", "1.5e-7": "1.5e-7",
    "12345678901234567890": "12345678901234567000", "9007199254740993": "9007199254740992", "1.7976931348623157e308": "1.7976931348623157e+308",
}


def test_equal_numbers_have_one_text(spark):
    texts = [f'{{"b": [{number}, "1.0 e"], "a": {{"x": {number}}}}}' for number in NUMBERS]
    rows = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "k int, t string")
    found = [row[0] for row in rows.orderBy("k").select(canonical(F.col("t"))).collect()]
    assert found == [f'{{"a":{{"x":{number}}},"b":[{number},"1.0 e"]}}' for number in NUMBERS.values()]


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_what_has_no_canonical_text(spark, allowed):
    """Whatever the session said before, repeated keys count once."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
    parameters = spark.createDataFrame([("t", "n", "number", True)], "tool string, parameter string, kind string, required boolean")
    texts = {"inf": '{"n":1e400}', "minus": '{"n":-1e999}', "text": '{"n":"1e400"}', "twice": '{"n":"x","n":1.0}', "none": "{"}
    calls = spark.createDataFrame([("c", name, "t", text) for name, text in texts.items()], "conv_id string, call_id string, tool string, arguments string")
    errors = {row.call_id: row.errors for row in validate_arguments(calls, parameters).collect()}
    assert errors == {"inf": ["no object"], "minus": ["no object"], "none": ["no object"], "text": ["type n"]}
    shown = {row.call_id: row.text for row in calls.select("call_id", canonical(F.col("arguments")).alias("text")).collect()}
    assert shown == {"inf": None, "minus": None, "none": None, "text": '{"n":"1e400"}', "twice": '{"n":1}'}
