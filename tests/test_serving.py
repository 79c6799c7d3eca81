"""Serving, evidence, mixed search and tours on small fixtures, with nulls, ties, repeated rows and empty tables."""

import hashlib

import pytest

from tessella.operators import drafts as D, evidence as E, mixed, retrieval, serving as S, tours as T

SNAP = "repo_id string, path string, state string, bytes binary, mtime_ns long, size_bytes long"
SPAN = "assertion_id long, repo_id string, span_id long, path string, byte_start int, byte_end int, content_hash string, line_start int, line_end int"
CLAIM = "assertion_id long, status string"


def h(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def world(rows):
    snaps = rows(
        SNAP, ("r", "same", "present", b"hello", 1, 5), ("r", "moved", "present", b"hello", 1, 5), ("r", "moved", "present", b"hello!", 2, 6), ("r", "short", "present", b"hello", 1, 5), ("r", "short", "present", b"he", 2, 2),
        ("r", "edit", "present", b"hello", 1, 5), ("r", "edit", "present", b"hullo", 2, 5), ("r", "gone", "present", b"hello", 1, 5), ("r", "gone", "absent", None, 2, None), ("r", "dark", "unreadable", None, 2, None),
    )
    span = lambda a, i, path, z=5: (a, "r", i, path, 0, z, h(b"hello"), 1, 2)
    spans = rows(SPAN, span(1, 1, "same"), span(2, 2, "moved"), span(3, 3, "short"), span(4, 4, "edit"), span(5, 5, "gone"), span(6, 6, "dark"), span(6, 7, "gone"), span(7, 8, "gone"), span(7, 9, "dark"), span(8, 10, "same", 0), span(9, 11, None), (9, "r", 12, "same", None, 5, None, None, None))
    claims = rows(CLAIM, *((i, "active") for i in range(1, 10)), (10, "active"), (1, "active"), (11, "stale"), (12, None))
    return snaps, spans, claims, S.two_stage(spans, S.baselines(spans, snaps), snaps)


def test_ladder_of_checks(world):
    got = {(r.assertion_id, r.span_id): (r.reason, r.method) for r in world[3].collect()}
    assert got == {
        (1, 1): ("ok", "stat"), (2, 2): ("ok", "hash"), (3, 3): ("span_truncated", "hash"), (4, 4): ("hash_mismatch", "hash"), (5, 5): ("file_missing", "hash"), (6, 6): ("unreadable", "hash"),
        (6, 7): ("file_missing", "hash"), (7, 8): ("file_missing", "hash"), (7, 9): ("unreadable", "hash"), (8, 10): ("invalid_span", "hash"), (9, 11): ("file_missing", "hash"), (9, 12): ("invalid_span", "hash"),
    }
    assert [r.span_id for r in S.rebaselined(world[3]).collect()] == [2]


def test_first_failure_decides_and_unreadable_never_expires(world, rows):
    snaps, spans, claims, checks = world
    out = {r.assertion_id: r.outcome for r in S.outcomes(claims, checks).collect()}
    assert out == {1: "served", 2: "served", 3: "expired", 4: "expired", 5: "expired", 6: "unverifiable", 7: "expired", 8: "expired", 9: "expired", 10: "no_evidence", 11: "no_evidence", 12: "no_evidence"}
    served, expiries = S.servable(claims, checks)
    assert {r.assertion_id for r in served.collect()} == {1, 2} and {r.assertion_id for r in expiries.collect()} == {3, 4, 5, 7, 8, 9}
    status, log = S.mark_stale(claims, expiries, rows("assertion_id long", (3,)))
    assert {r.assertion_id for r in status.filter("status = 'stale'").collect()} == {3, 4, 5, 7, 8, 9, 11} and {r.assertion_id for r in log.collect()} == {4, 5, 7, 8, 9}
    again, log2 = S.mark_stale(status, expiries, log.select("assertion_id").union(rows("assertion_id long", (3,))))
    assert log2.count() == 0 and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, status.collect()), key=repr)
    r = S.refresh_report(claims, checks).first()
    assert r.checked == r.fresh + r.expired + r.unverifiable == 10 and "file_missing=3" in r.by_reason


def test_only_stale_claims_whose_spans_all_match_come_back(world, rows):
    checks = world[3]
    claims = rows(CLAIM, (1, "stale"), (2, "rejected"), (4, "stale"), (6, "stale"), (10, "stale"))
    assert {r.assertion_id: r.reinstated for r in S.reinstated(claims, checks).collect()} == {1: True, 4: False, 6: False, 10: False}
    fresh = S.served_assertions(world[2], checks, False, False).collect()
    assert {(r.assertion_id, r.method, r.verified_ns) for r in fresh} == {(1, "stat", 1), (2, "hash", 2)}
    assert {r.state for r in S.served_assertions(world[2], checks).collect()} == {"fresh", "stale", "unverifiable"}


def test_empty_tables(world, rows):
    snaps, spans, claims, checks = world
    none = S.two_stage(spans.limit(0), S.baselines(spans.limit(0), snaps), snaps)
    assert S.outcomes(claims.limit(0), none).count() == 0 and S.refresh_report(claims.limit(0), none).first().checked == 0
    assert S.two_stage(spans, S.baselines(spans, snaps.limit(0)), snaps.limit(0)).filter("reason = 'file_missing'").count() == 12
    assert E.rendered_citations(none).count() == 0


def test_submission_limits(rows):
    c = rows("assertion_id long, claim string, confidence double", (1, "x", None), (2, "x" * 4097, 0.5), (3, "x", float("nan")), (4, "x", 1.5), (5, None, 0.0), (6, "x", 0.1))
    spans = rows(SPAN, *((6, "r", i, "p", 0, 1, "h", 1, 1) for i in range(33)))
    assert {r.assertion_id: r.fault for r in S.submission_limits(c, spans).collect()} == {1: None, 2: "claim_too_long", 3: "bad_confidence", 4: "bad_confidence", 5: None, 6: "too_many_spans"}


def test_budgets(rows):
    items = rows("`group` long, id long, rank int, text string", (1, 1, 1, "a" * 60), (1, 2, 2, "b" * 50), (1, 3, 3, "c" * 40), (1, 4, 4, None), (1, 1, 9, "a" * 60))
    got = {r.id: (r.taken, r.reason) for r in E.sections(items, 100).collect()}
    assert got == {1: (True, None), 2: (False, "budget"), 3: (True, None), 4: (False, "missing")}
    assert {r.taken for r in E.sections(items, 0).collect()} == {False}
    with pytest.raises(ValueError):
        E.sections(items, -1)
    assert E.clamped(10**9) == E.MAX_BUDGET
    assert rows("t string", ("a\nb\n",)).select(E.numbered("t", 9).alias("t")).first().t == "9 | a\n10 | b\n11 | "


def test_a_query_without_claims_keeps_its_sources(rows):
    pool = rows("query_id long, id long, score double, modality string, rank int", (1, 10, 0.5, "lexical", 1), (1, 11, 0.4, "graph", 2), (2, 10, 0.5, "dense+graph", 1))
    claims = rows("assertion_id long, subject string", (7, "b"), (8, None))
    symbols = rows("id long, qualname string", (10, "a"), (11, "b"))
    hits = rows("query_id long, assertion_id long, rank int", (3, 99, 1))
    got = sorted((r.query_id, r.candidate_type, r.id, r.rank) for r in mixed.mixed_search(pool, hits, claims, symbols).collect())
    # query 2 has no claims; query 1 has one on a pooled subject; query 3's claim is not active
    assert [g for g in got if g[0] == 2] == [(2, "source", 10, 1)]
    assert {g[1:3] for g in got if g[0] == 1} == {("source", 10), ("source", 11), ("assertion", 7)}
    facts = mixed.mixed_search(pool, hits, claims, symbols, 10, 0).collect()
    assert {(r.query_id, r.id) for r in facts if r.candidate_type == "source"} == {(1, 10), (2, 10)} and not [r for r in facts if r.candidate_type == "assertion"]
    assert mixed.mixed_search(pool.limit(0), hits.limit(0), claims, symbols).count() == 0


def test_conflicts_fold_case_and_width(rows):
    votes = rows("query_id long, list string, rank int, candidate_type string, id long, tier int", *((1, "assertion_lexical", i, "assertion", i, 2) for i in range(1, 7)))
    claims = rows("assertion_id long, subject string, kind string, claim string", (1, "s", "k", "It  Ｗaits"), (2, "s", "k", "it waits"), (3, "t", "k", "one"), (4, "t", "k", "two"), (5, "t", "other", "three"), (6, "u", "k", None))
    assert {r.id for r in mixed.conflicting(votes, claims).collect()} == {3, 4}
    assert mixed.conflicting(votes, claims, 1).count() == 0


def test_rerank_and_embedding_batches(rows):
    hits = rows("query_id long, id long, rank int", *((1, i, i) for i in range(1, 106)))
    docs = rows("id long, text string", *((i, "x" * (i % 7)) for i in range(1, 104)))
    from pyspark.sql import functions as F

    got = [r.id for r in retrieval.rerank(hits, rows("query_id long, query string", (1, "q")), docs, lambda q, t: F.length(t).cast("double"), 200).orderBy("rank").collect()]
    assert got[-5:] == [101, 102, 103, 104, 105] and got[:3] == [6, 13, 20]
    asked = []

    def embed(texts):
        assert len(texts) <= 32 and (len(texts) == 1 or sum(map(len, texts)) <= 16_000)
        return [[float(len(t))] for t in texts]

    texts = rows("id long, text string", *((i, "y" * (i * 40)) for i in range(500)), (900, None), (901, "y" * 40))
    out = retrieval.embed_missing(texts, rows("text_hash string, model string", (h(b""), "m"), (h(b"y" * 40), "other")), embed, "m").collect()
    assert len(out) == 499 and not asked


def test_tours_put_callees_first_and_cycles_together(rows):
    nodes = rows("id long, qualname string, module string, centrality double", (1, "top", "m", 0.1), (2, "mid", "m", 0.2), (3, "leaf", "m", 0.4), (4, "ring_a", "n", 0.3), (5, "ring_b", "n", 0.3), (6, "alone", "z", 0.0))
    edges = rows("src long, dst long, confidence double, edge_id long", (1, 2, None, 1), (2, 3, None, 2), (4, 5, None, 3), (5, 4, None, 4), (4, 3, None, 5), (1, 4, None, 6))
    queries = rows("query_id long", (1,), (2,))
    hits = rows("query_id long, id long, rank int", (1, 1, 1), (1, 77, 2))
    path = {r.query_id: [] for r in queries.collect()}
    for r in T.reading_paths(queries, hits, edges, nodes).orderBy("query_id", "stop").collect():
        path[r.query_id].append(r)
    ids = [r.id for r in path[1]]
    assert ids[0] == 3 and ids[-1] == 1 and set(ids) == {1, 2, 3, 4, 5}
    assert abs(ids.index(4) - ids.index(5)) == 1 and "cycle of 2" in path[1][ids.index(4)].reason
    assert len(path[2]) >= 4 and path[2][0].tier == 0
    assert T.reading_paths(queries.limit(0), hits.limit(0), edges, nodes).count() == 0


def test_menus_share_places_between_callees_and_callers(rows):
    sources = rows("id long, qualname string, size int", (0, "subject", 10), *((i, f"c{i:02}", 10) for i in range(1, 30)), (90, "big", 5000))
    edges = rows("src long, dst long", *((0, i) for i in range(1, 15)), *((i, 0) for i in range(14, 20)), (0, 90), (0, 0))
    menu = {r.ref: (r.id, r.part) for r in D.menus(rows("subject long", (0,), (55,)), edges, sources).collect()}
    assert menu[1] == (0, "subject") and [menu[i] for i in range(2, 8)] == [(i, "callee") for i in range(1, 7)] and [menu[i][0] for i in range(8, 13)] == [15, 16, 17, 18, 19] and len(menu) == 12
    lone = {r.ref: r.id for r in D.menus(rows("subject long", (0,)), edges.filter("src = 0"), sources).collect()}
    assert [lone[i] for i in range(2, 13)] == list(range(1, 12))


@pytest.mark.parametrize("answer, verdict, cause", [
    ('{"label": "Supported", "reasoning": "x"}', "supported", "judged"), ('<think>{"label": "supported"}</think>```json\n{"label": "not supported"}\n```', "refuted", "judged"), ('So: {"label": "uncertain", } end', "unsupported", "judged"),
    ('label is "label": "NOT-SUPPORTED", trailing', "refuted", "judged"), ('{"label": "maybe"}', None, "format_failure"), ("no idea", None, "parse_failure"), ("", None, "parse_failure"), (None, None, "parse_failure"), ('<think>{"label": "supported"}', None, "parse_failure"),
])
def test_judges_fail_closed(rows, answer, verdict, cause):
    r = rows("a string", (answer,)).select(D.parsed_verdict("a").alias("v")).first().v
    assert (r.verdict, r.cause) == (verdict, cause)


@pytest.mark.parametrize("answer, claim, refs", [
    ('{"claim": "c", "refs": [1, "2", true, 3.5, "x", 4]}', "c", [1, 2, 4]), ('{"claim": "c", "refs": 3}', "c", [3]), ('{"claim": " ", "refs": [1]}', None, []), ('{"refs": [1]}', None, []), ('x {"claim": "c"} y', "c", []), (None, None, []),
])
def test_drafts(rows, answer, claim, refs):
    r = rows("a string", (answer,)).select(D.parsed_draft("a").alias("d")).first().d
    assert (r.claim, r.refs) == (claim, refs)


def test_a_generator_round(rows):
    menu = rows("subject long, ref int, id long, part string", (1, 1, 1, "subject"), (1, 2, 5, "callee"), (2, 1, 2, "subject"), (3, 1, 3, "subject"))
    texts = rows("id long, text string", (1, "one"), (2, "two"), (3, "three"), (5, "five"))
    say = {"one": '{"claim": "c", "refs": [2, 2]}', "two": '{"claim": "c", "refs": [9]}', "three": '{"claim": ""}'}
    out = D.learned(rows("subject long", (1,), (2,), (3,), (4,)), menu, texts, lambda ps: [next(v for k, v in say.items() if k in p) for p in ps])
    assert {r.subject: (r.outcome, r.ids) for r in out.collect()} == {1: ("drafted", [5]), 2: ("off_menu", []), 3: ("no_claim", []), 4: ("no_offers", None)}
