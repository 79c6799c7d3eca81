import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import bootstrap, budget, claims, graph, leaks, mining, mixed, nested, retrieval, stats


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


RECORD = {
    "type": "system",
    "mcpServers": {"db": {"status": "up", "tools": {"loaded": ["db__a"], "deferred": [{"name": "db__b"}, {"name": None}]}}, "bare": None},
    "plugins": ["plain", {"name": "pack", "plugins": [{"name": "sub", "tools": ["sub:t"]}], "mcp_servers": [{"status": "x", "tools": ["lost"]}, {"name": "in", "tools": [{"name": "t"}]}]}],
    "agents": [{"name": "ag", "agents": [{"name": "deep", "tools": "one", "mcp_servers": ["s"]}]}],
    "tools": [{"name": "T", "input_schema": {"properties": {"tools": {"type": "array"}}}}, "T", " "],
}


def test_nested_records(spark):
    whole = json.dumps(RECORD)
    wrapped = json.dumps({"payload": whole, "encoding": "json"})
    event = json.dumps({"event": RECORD, "seq": 1})
    rows = df(spark, "record_id long, payload string, child string, name string", *((i, p, "clash", "clash") for i, p in enumerate([whole, wrapped, event, whole[:-3], None, "", "[]", "null", "3", '{"tools": {}}', '{"plugins": null, "mcp_servers": []}', "[" * 100000])), (0, whole, "clash", "clash"))
    got = {}
    for r in nested.flatten_records(rows).select("record_id", "child", "parent", "name").distinct().collect():
        got.setdefault(r.record_id, set()).add((r.child, r.parent, r.name))
    want = {
        ("mcp_server", "", "db"), ("mcp_server", "", "bare"), ("tool", "db", "db__a"), ("tool", "db", "db__b"), ("plugin", "", "plain"), ("plugin", "", "pack"), ("plugin", "pack", "sub"), ("tool", "pack/sub", "sub:t"),
        ("tool", "pack", "lost"), ("mcp_server", "pack", "in"), ("tool", "pack/in", "t"), ("tool", "ag/deep", "one"), ("mcp_server", "ag/deep", "s"), ("tool", "", "T"),
    }
    assert got == {0: want, 1: want, 2: want}
    tables = nested.record_tables(rows.filter("record_id = 0"))
    servers = {r.label: r for r in tables["mcp_server"].collect()}
    plugins = {r.label: r.name for r in tables["plugin"].collect()}
    inner = next(r for r in servers.values() if r.name == "in")
    assert plugins[inner.parent_label] == "pack" and inner.parent_child == "plugin" and inner.label.startswith(inner.parent_label + ".")
    assert nested.flatten_records(rows.limit(0)).count() == 0


def test_phrases_and_repeated_terms(spark):
    docs = df(spark, "doc_id long, text string", (1, "db init db"), (2, "init the db"), (3, "other words here"), (4, None), (5, ""))
    q = df(spark, "query_id long, query string", (1, "db.init"), (2, "init init"), (3, "init"), (4, '"()"'), (5, "absent"))
    got = {}
    for r in retrieval.bm25(docs, q).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert set(got[1]) == {1} and set(got[3]) == {1, 2} and 4 not in got and 5 not in got
    assert got[2][2] == pytest.approx(2 * got[3][2], abs=1e-5)


def test_knn_equals_brute_force(spark):
    import random

    rnd = random.Random(1)
    vs = []
    for i in range(60):
        v = [rnd.gauss(0, 1) for _ in range(5)]
        n = math.sqrt(sum(x * x for x in v))
        vs.append((i, [x / n for x in v]))
    t = df(spark, "id long, v array<double>", *vs, (99, None))
    got = {}
    for r in retrieval.exact_knn(t, t.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), k=4, block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q, ranked in got.items():
        want = sorted((-round(sum(a * b for a, b in zip(vs[q][1], v)), 6), i) for i, v in vs)[:4]
        assert [i for _, i in sorted(ranked)] == [i for _, i in want]
    assert len(got) == 3


def test_reserved_tests_displace_the_last(spark):
    votes = df(spark, "query_id long, modality string, rank int, id long", *((1, "lexical", i, i) for i in range(1, 9)))
    tests = df(spark, "id long", (7,), (8,))
    got = [r.id for r in retrieval.fuse(votes, k=4, tests=tests).orderBy("rank").collect()]
    assert got == [1, 2, 7, 8]
    assert [r.id for r in retrieval.fuse(votes, k=1, tests=tests).collect()] == [1]


def test_spreading_activation_by_hand(spark):
    edges = df(spark, "src long, dst long, confidence double, edge_id long", (1, 2, 1.0, 1), (2, 3, 1.0, 2), (4, 1, 1.0, 3), (1, 2, 1.0, 4))
    seeds = df(spark, "query_id long, id long, place int", (9, 1, 1))
    got = {r.id: r.score for r in retrieval.expand(edges, seeds).collect()}
    assert got[4] == pytest.approx(0.35 * 0.45, abs=1e-6) and got[3] == pytest.approx(0.45**3, abs=1e-6) and got[2] == pytest.approx(0.9, abs=1e-6) and 1 not in got


def test_graph_by_hand(spark):
    edges = df(spark, "src string, dst string", ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("x", "x"), ("f", "a"))
    comp = graph.strong_components(edges)
    assert {r.id: r.component for r in comp.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "x": "x", "f": "f"}
    assert {r.component: r.depth for r in graph.depths(edges, comp).collect()} == {"a": 2, "c": 1, "e": 0, "x": 0, "f": 3}
    ranks = {r.id: r.rank for r in graph.pagerank(edges, iterations=60).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] > ranks["f"]
    none = edges.limit(0)
    assert graph.pagerank(none).count() == 0 and graph.strong_components(none).count() == 0


def test_mixed_fusion_filters_before_the_cut(spark):
    votes = df(spark, "query_id long, list string, rank int, candidate_type string, id long, tier int", (1, "assertion_lexical", 1, "assertion", 5, 2), (1, "source_lexical", 1, "source", 5, 0), (1, "source_lexical", 2, "source", 6, 0), (1, "source_lexical", 3, "source", 6, 0))
    f = lambda **k: [(r.candidate_type, r.id) for r in mixed.mixed_fusion(votes, **k).orderBy("rank").collect()]
    assert f(k=2) == [("source", 5), ("assertion", 5)] and f(k=2, max_tier=1) == [("source", 5), ("source", 6)]


def test_policy_needs_sound_verdicts(spark):
    a = df(spark, "assertion_id long, status string", (1, "active"), (2, "active"), (3, "stale"), (4, "active"), (5, None))
    v = df(spark, "verdict_id long, assertion_id long, judge string, verdict string, created_at timestamp", (1, 1, "j", "Supported ", None), (2, 2, "j", "REFUTED", None), (3, 2, "k", "supported", None), (4, 4, "j", "n/a", None))
    assert {r.assertion_id: r.reason for r in claims.serving(a, v).collect()} == {1: "eligible", 2: "vetoed", 3: "status", 4: "verdict_required", 5: "status"}
    with pytest.raises(ValueError):
        claims.serving(a, v, accepted=("refuted",))


def test_budget_passes_over_what_does_not_fit(spark):
    items = df(spark, "group long, rank int, id long, size long", (1, 1, 1, 60), (1, 2, 2, 50), (1, 3, 3, 40), (2, 1, 4, 200))
    assert {r.id: r.taken for r in budget.take_within(items, 100).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_leaks_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    texts = [word(80) for _ in range(25)]
    secrets = [word(40) for _ in range(8)] + [t[i : i + 34] for i, t in enumerate(texts[:9])] + [None, "short", "a" * 31]
    squeeze = lambda s: " ".join(s.split())
    texts.append(texts[3])
    want = set()
    first = lambda x, of: next(k for k, y in enumerate(of) if y is not None and squeeze(y) == x)
    for i, s in enumerate(secrets):
        if s is None:
            continue
        s = squeeze(s)
        i = first(s, secrets)
        for t in texts:
            t = squeeze(t)
            j = first(t, texts)
            if any(s[k : k + 32] in t for k in range(len(s) - 31)):
                want.add((i, j))
    got = leaks.shared_windows(df(spark, "secret_id long, text string", *enumerate(secrets)), df(spark, "text_id long, text string", *enumerate(texts), (99, None)))
    assert {tuple(r) for r in got.collect()} == want and want
    classes = {r.text_id: r.rep for r in leaks.text_classes(df(spark, "text_id long, text string", *enumerate(texts)), "text_id").collect()}
    assert classes[25] == 3 and classes[4] == 4


def test_statistics(spark):
    w = df(spark, "s int, n int", (0, 0), (5, 10), (10, 10)).select(*(c.alias(x) for c, x in zip(stats.wilson(F.col("s"), F.col("n")), "lh"))).collect()
    assert w[0].l is None or w[0].l == 0.0
    assert w[1].l == pytest.approx(0.2366, abs=1e-3) and w[2].h == pytest.approx(1.0)
    q = {r.p: r.value for r in stats.nearest_rank(df(spark, "value double", *((float(x),) for x in [5, 1, 3, 3, None] if x is not None), (None,)), [0.0, 0.5, 1.0]).collect()}
    assert q == {0.0: 1.0, 0.5: 3.0, 1.0: 5.0}
    k = stats.cohen_kappa(df(spark, "a string, b string", ("x", "x"), ("x", "y"), ("y", "y"), ("y", "y"))).first()
    assert k.agreement == 0.75 and k.kappa == 0.5
    ci = {r.p: r.value for r in bootstrap.interval(df(spark, "cluster long, value double", *((i, float(i % 2)) for i in range(40))), resamples=100).collect()}
    assert ci[0.025] < 0.5 < ci[0.975]
    assert mining.classified(df(spark, "id long, query string, names string", (1, "one two", "x"), (2, "a b c d e f", "x"), (3, "A  b c d e f", "x"), (4, "a b c d e f", "a.b.c.d"))).count() == 4


def test_bm25_of_equal_texts_and_queries(rows):
    """Copies have their text's score and follow by id; each of equal queries has the whole list."""
    texts = ["gate lease", "gate", "lease lease tour", "tour"] + ["other words"] * 9
    docs = [(10 * c + i, t) for c in range(4) for i, t in enumerate(texts[:4])] + [(100 + i, t) for i, t in enumerate(texts[4:])]
    q = rows("query_id long, query string", (1, "gate"), (2, "gate"), (3, "lease tour"), (4, None))
    got = {}
    for r in retrieval.bm25(rows("doc_id long, text string", *docs, (999, None)), q, 6).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, r.score)
    ids = {k: [v[i][0] for i in sorted(v)] for k, v in got.items()}
    assert ids[1] == ids[2] == [1, 11, 21, 31, 0, 10] and ids[3] == [2, 12, 22, 32, 3, 13] and 4 not in ids
    assert all(a[1] >= b[1] for v in got.values() for a, b in zip([v[i] for i in sorted(v)], [v[i] for i in sorted(v)][1:]))
    every = retrieval.bm25(rows("doc_id long, text string", *docs), q, None).filter("query_id = 1")
    assert every.count() == 8
