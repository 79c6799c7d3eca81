"""Records in any number of wrappers, nested to any depth, with every field kept."""

import json
import random

from tessella.operators.nested import _read_deep, flatten_records, linked_nodes, path_summary, path_table, record_nodes


def named(payload):
    return sorted(r[:3] for r in linked_nodes(payload) if r[0] and r[2])


def test_wrappers_have_no_limit():
    text = '{"tools": ["a"]}'
    for i in range(60):
        text = json.dumps({"body": text}) if i < 8 else '{"w": [%s]}' % text
    assert named(text) == [("tool", "", "a")]


def test_payloads_deeper_than_the_parser():
    assert named("[" * 60_000 + '{"tools": ["a"]}' + "]" * 60_000) == [("tool", "", "a")]
    deep = '{"agents": [{"name": "x", "agents": [' * 1500 + '{"name": "y", "tools": "t"}' + "]}]}" * 1500
    assert ("tool", "/".join(["x"] * 1500 + ["y"]), "t") in named(deep)
    assert named("[" * 60_000 + '{"tools": ["a"]}') == []


def test_reader_equals_the_library():
    rnd = random.Random(3)

    def value(n):
        k = rnd.random()
        if n and k < 0.4:
            return {f"k{i}\n": value(n - 1) for i in range(rnd.randint(0, 3))}
        if n and k < 0.7:
            return [value(n - 1) for _ in range(rnd.randint(0, 3))]
        return rnd.choice([1, -2.5e3, None, True, False, "a\"é ", "", 10**30])

    for _ in range(300):
        text = json.dumps(value(4), indent=rnd.choice([None, 1]))
        assert _read_deep(text) == json.loads(text)
        cut = text[: rnd.randint(0, len(text))] + rnd.choice(["", "]", ",", '"', "x"])
        try:
            want = json.loads(cut)
        except ValueError:
            want = ValueError
        try:
            got = _read_deep(cut)
        except ValueError:
            got = ValueError
        assert got == want, cut


def test_tables_by_schema_path_keep_links_and_data(spark):
    payload = {"config": {"limits": [{"cpu": 2}, {"cpu": 3, "tags": ["a", "b"]}]}, "plugins": [{"name": "p", "options": {"deep": {"on": True}, "mcpServers": [{"name": "s"}]}}]}
    rows = spark.createDataFrame([(1, json.dumps(payload), "x"), (1, json.dumps(payload), "x"), (2, None, "x"), (3, "{", "x")], "record_id long, payload string, child string")
    nodes = record_nodes(rows)
    limits = {r.node: r for r in path_table(nodes, "/config/limits").collect()}
    assert sorted(json.loads(r.attributes)["cpu"] for r in limits.values()) == [2, 3] and json.loads(limits["0.0.0.1"].attributes)["tags"] == ["a", "b"]
    assert {r.holder for r in limits.values()} == {"0.0"}
    deep = path_table(nodes, "/plugin/options/deep").first()
    assert json.loads(deep.attributes) == {"on": True} and deep.holder == "0.1.0.1"
    paths = {r.schema_path: (r.n_nodes, r.n_records) for r in path_summary(nodes).collect()}
    assert paths["/config/limits"] == (2, 1) and paths["/plugin/options/mcp_server"] == (1, 1)
    assert [(r.child, r.parent, r.name, r.parent_child) for r in flatten_records(rows).filter("child = 'mcp_server'").distinct().collect()] == [("mcp_server", "p", "s", "plugin")]
    assert path_summary(record_nodes(rows.limit(0))).count() == 0
