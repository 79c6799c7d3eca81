"""Components and depths against brute force, and the rounds they take."""

import random

import pytest

from tessella.operators import graph
from tessella.plans.scratch import Scratch


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {}
    for n in nodes:
        seen, work = set(), [n]
        while work:
            for a, b in edges:
                if a == work[0] and b not in seen:
                    seen.add(b)
                    work.append(b)
            work.pop(0)
        out[n] = seen
    return out


def brute(edges):
    r = reach(edges)
    comp = {n: min([n, *(m for m in r[n] if n in r[m])]) for n in r}
    links = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    depth = {c: 0 for c in comp.values()}
    for _ in depth:
        for a, b in links:
            depth[a] = max(depth[a], depth[b] + 1)
    return comp, depth


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(rows, seed):
    rnd = random.Random(seed)
    n = 26
    edges = {(rnd.randint(0, n), rnd.randint(0, n)) for _ in range((20, 30, 45)[seed])}
    edges |= {(100 + i, 100 + (i + 1) % 5) for i in range(5)} | {(102, 3), (4, 110), (110, 111), (111, 112), (112, 110), (112, 120), (120, 121)}
    df = rows("src long, dst long", *edges, *list(edges)[:3])
    comp = graph.strong_components(df)
    want, deep = brute(sorted(edges))
    assert {r.id: r.component for r in comp.collect()} == want
    assert {r.component: r.depth for r in graph.depths(df, comp).collect()} == deep


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(1000)], [(i, (i + 1) % 1000) for i in range(1000)], [(i, (i + 1) % 500) for i in range(500)] + [(1000 + i, 1000 + (i + 1) % 500) for i in range(500)]])
def test_long_chains_and_cycles_take_few_rounds(rows, monkeypatch, edges):
    written = []
    cut = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: (written.append(1), cut(self, df))[1])
    df = rows("src long, dst long", *edges)
    comp = graph.strong_components(df)
    got = {r.id: r.component for r in comp.collect()}
    if edges[-1][1] == 1000 and len(edges) == 1000 and edges[0] == (0, 1) and (999, 1000) in edges:
        assert all(a == b for a, b in got.items()) and len(got) == 1001
        depth = {r.component: r.depth for r in graph.depths(df, comp).collect()}
        assert depth == {i: 1000 - i for i in range(1001)}
    else:
        assert set(got.values()) == {min(x for x in e) for e in edges if min(e) in (0, 1000)} and len(got) == 1000
    assert len(written) <= 60


def test_empty(rows):
    df = rows("src long, dst long")
    assert graph.strong_components(df).count() == 0 and graph.depths(df, graph.strong_components(df)).count() == 0
