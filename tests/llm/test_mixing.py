import os

import pytest

from tessella.llm.bpe import DEFAULT_VOCABULARY
from tessella.llm.mixing import fair_mix, mix_shares, source_tokens, target_totals

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")
D = "doc_id long, source string, text string, weight double"
T = "source string, weight double, max_repeats int"


def test_shares_caps_and_short_sources(rows):
    docs = rows(D, *((i, "big", "word " * 20, 1.0) for i in range(400)), *((1000 + i, "small", "word " * 20, 1.0) for i in range(10)), (5000, "other", "x", 0.0), (5001, None, "x", 0.0), (5002, "big", None, 0.0), (5003, "big", "", 0.0))
    targets = rows(T, ("big", 0.6, 2), ("small", 0.3, 3), ("none", 0.1, 5), ("none", 0.1, 5))
    mix, totals = fair_mix(docs, targets)
    short = {r.source: r.short for r in totals.collect()}
    assert short == {"big": False, "small": True, "none": True}
    rows_ = mix.collect()
    assert [r.finish for r in rows_] == sorted(r.finish for r in rows_)
    copies = {}
    for r in rows_:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies[i] for i in copies if i >= 1000) <= 3 and max(copies[i] for i in copies if i < 1000) <= 2
    all_tokens = totals.first()["all_tokens"]
    assert all_tokens - 40 <= sum(r.n_tokens for r in rows_) <= all_tokens
    shares = {r.source: r.share for r in mix_shares(mix, totals).collect()}
    assert shares["none"] == 0 and abs(sum(shares.values()) - 1) < 1e-5


def test_weights_are_met_where_sources_suffice(rows):
    docs = rows(D, *((i, "a" if i % 2 else "b", "tok " * (1 + i % 7), 1.0) for i in range(2000)))
    mix, totals = fair_mix(docs, rows(T, ("a", 0.25, 1), ("b", 0.75, 3)), budget=4000)
    shares = {r.source: r.share for r in mix_shares(mix, totals).collect()}
    assert abs(shares["a"] - 0.25) < 0.01 and abs(shares["b"] - 0.75) < 0.01


def test_empty(rows):
    t = rows(T, ("a", 1.0, 1))
    assert source_tokens(rows(D), t).count() == 0
    assert [r.short for r in target_totals(source_tokens(rows(D), t), t).collect()] == [False]
    assert fair_mix(rows(D), t)[0].count() == 0


def brute(counted, targets, budget, seed_order):
    """The mix by sorting every copy on one list."""
    copies = []
    for source, (w, most) in targets.items():
        docs = [d for d in seed_order if d[1] == source]
        total, upto = sum(d[2] for d in docs), 0
        for c in range(most):
            for d, _, n in docs:
                upto += n
                copies.append((upto / w, source, d, c, n))
    out, left = [], budget
    for f, s, d, c, n in sorted(copies):
        if n > left:
            break
        left -= n
        out.append((d, s, c))
    return out


@pytest.mark.parametrize("weights, budget, rows_per_bucket", [((0.5, 0.5 - 1e-5, 1e-5), None, 20_000), ((0.2, 0.3, 0.5), 500, 8), ((0.6, 0.2, 0.2), 10_000_000, 8), ((0.1, 0.1, 0.8), 900, 4)])
def test_mix_equals_one_sorted_list(rows, monkeypatch, weights, budget, rows_per_bucket):
    from pyspark.sql import functions as F

    from tessella.llm import mixing

    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", rows_per_bucket)
    docs = rows(D, *((i, "abc"[i % 7 % 3], "tok " * (1 + i * i % 23), 1.0) for i in range(300)))
    t = dict(zip("abc", zip(weights, (2, 3, 2))))
    targets = rows(T, *((s, w, n) for s, (w, n) in t.items()))
    q = mixing.FairQueue(docs, targets, budget)
    ordered = [tuple(r) for r in q.counted.select("doc_id", "source", "n_tokens", F.expr("xxhash64(20, doc_id)").alias("k")).orderBy(F.lpad(F.hex("k"), 16, "0"), "doc_id").select("doc_id", "source", "n_tokens").collect()]
    want = brute(None, t, q.budget, ordered)
    assert [(r.doc_id, r.source, r.copy) for r in q.mix().collect()] == want


def test_short_sources_come_from_the_queue(rows, monkeypatch):
    from tessella.llm import mixing

    docs = rows(D, *((i, "big" if i else "small", "word " * 20, 1.0) for i in range(60)))
    targets = rows(T, ("big", 0.6, 2), ("small", 0.4, 3), ("none", 0.1, 2), ("off", 0.0, 2))
    q = mixing.FairQueue(docs, targets)
    assert {r.source for r in q.short_sources().collect()} == {"small", "none"}
    monkeypatch.setattr(mixing.FairQueue, "copies", lambda self, upto: self.scratch.spark.createDataFrame([("big", 0.0)] * 1000, "source string, finish double"))
    assert {r.source for r in q.short_sources().collect()} == {"none"}
