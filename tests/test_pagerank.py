import pytest

import __spark_entry__ as entry
from tessella.workloads.retrieval import call_edges


def converged(pairs, limit=100, tolerance=1e-10, d=0.85):
    ids = sorted({x for p in pairs for x in p})
    out = {i: [] for i in ids}
    for a, b in pairs:
        out[a].append(b)
    rank, n = dict.fromkeys(ids, 1 / len(ids)), len(ids)
    for step in range(1, limit + 1):
        lost = sum(rank[i] for i in ids if not out[i])
        new = dict.fromkeys(ids, (1 - d) / n + d * lost / n)
        for i in ids:
            for j in out[i]:
                new[j] += d * rank[i] / len(out[i])
        moved = sum(abs(new[i] - rank[i]) for i in ids)
        rank = new
        if moved < tolerance:
            break
    return rank, step


def test_registered_pagerank_converges(spark, tmp_path):
    """A chain into a cycle with a way out: eight steps are far from the end."""
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("n30", "n20"), ("n25", "leaf"), ("n05", "n20")]
    stops = [("r", a, [b]) for a, b in chain]
    spark.createDataFrame(stops, "repo_id string, qualname string, calls_here array<string>").write.parquet(str(tmp_path / "stops.parquet"))
    pairs = {(r.src, r.dst) for r in call_edges(spark, str(tmp_path)).collect()}
    want, steps = converged(pairs)
    early, _ = converged(pairs, limit=8)
    assert steps > 8 and max(abs(early[i] - want[i]) for i in want) > 1e-3
    got = {r.id: r.rank for r in entry.queries()["t2_pagerank_converged"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and got == pytest.approx(want, abs=1.1e-9)
