import hashlib

import pytest

from tessella.operators import bootstrap


def brute(clusters, resamples=2000, seed=20):
    """The interval's bounds for lists of values, one list per cluster in order."""
    n, means = len(clusters), []
    for b in range(resamples):
        picks = [clusters[int(hashlib.md5(f"{seed}-{b}-{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)]
        means.append(sum(map(sum, picks)) / sum(map(len, picks)))
    means.sort()
    return {p: means[min(resamples - 1, int(p * resamples))] for p in (0.025, 0.975)}


def interval(spark, *data):
    return {r.p: r.value for r in bootstrap.interval(spark.createDataFrame(list(data), "cluster string, value double")).collect()}


def test_two_thousand_resamples(spark):
    values = {f"c{i:02}": [((i * 37 + j * 11) % 19) / 19 for j in range(1 + i % 3)] for i in range(12)}
    got = interval(spark, *((c, v) for c, vs in values.items() for v in vs))
    want = brute(list(values.values()))
    assert got == pytest.approx(want, abs=1e-8) and want != pytest.approx(brute(list(values.values()), 200), abs=1e-8)


def test_single_cluster_is_drawn_value_by_value(spark):
    values = [((i * 7) % 20) / 20 for i in range(20)]
    got = interval(spark, *(("one", v) for v in values), ("one", None))
    assert got == pytest.approx(brute([[v] for v in sorted(values)]), abs=1e-8) and got[0.025] < got[0.975]


def test_large_draws_are_not_taken_for_small(spark):
    """A million draws whose size the planner takes for that of 1,000 resamples would be broadcast through the driver."""
    few = {(r.b, r.i): r.pick for r in bootstrap.draws(spark, 3, 7, 20).collect()}
    assert few == {(b, i): int(hashlib.md5(f"20-{b}-{i}".encode()).hexdigest()[:8], 16) % 7 for b in range(3) for i in range(7)}
    size = bootstrap.draws(spark, 1000, 1000, 20)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) > 8_000_000
