import datetime as dt
import random

from tessella.llm.consensus import VERDICTS, Consensus, answers

V = "verdict_id long, assertion_id long, judge string, verdict string, created_at timestamp, label string"
A = "assertion_id long, judge string, label string, cause string, verdict string"
S = "assertion_id long, kind string, generator string, status string, claim string, created_at timestamp"
T = dt.datetime(2028, 1, 1)


def test_one_answer_per_judge(rows):
    v = rows(V, (1, 1, "Ochre-Judge", "Supported ", T, "x"), (2, 1, "ochre judge", "refuted", T + dt.timedelta(1), "x"), (3, 1, "ochre_judge", "n/a", T + dt.timedelta(2), "x"), (4, 1, None, "refuted", T, "x"), (5, None, "j", "refuted", T, "x"), (6, 2, "j", None, None, "x"))
    a = rows(A, (1, "ochre-judge", "supported", "judged", "y"), (2, "k", "Not supported", "judged", "y"), (2, "k", "not_supported", "judged", "y"), (3, "k", "uncertain", "parse_failure", "y"), (4, "k", "refuted", "judged", "y"))
    assert sorted(tuple(r) for r in answers(v, a).collect()) == [(1, "ochrejudge", 1), (2, "k", 1)]


def test_reliable_judges_outweigh_many_poor_ones(rows):
    rnd = random.Random(5)
    data, truth, n = [], {}, 0
    for item in range(300):
        truth[item] = t = rnd.choice(VERDICTS)
        for judge, right in (("good1", 0.95), ("good2", 0.93), ("coin1", 0.34), ("coin2", 0.34), ("coin3", 0.34), ("contrary", 0.05)):
            n += 1
            said = t if rnd.random() < right else rnd.choice([x for x in VERDICTS if x != t])
            data.append((n, item, judge, said, T, None))
    fitted = Consensus(rows(V, *data), rows(A), rows(S, *((i, "k", None, "active", f"claim {i}", T) for i in range(0, 300, 2))))
    got = {r.assertion_id: r.verdict for r in fitted.verdicts().collect()}
    assert sum(got[i] == t for i, t in truth.items()) > 285
    r = {x.judge: x for x in fitted.reliability().collect()}
    assert r["good1"].accuracy > 0.85 > 0.5 > r["coin1"].accuracy and r["contrary"].information > r["coin1"].information
    assert -1 <= fitted.alpha().first()["alpha"] <= 1


def test_empty_tables(rows):
    c = Consensus(rows(V), rows(A), rows(S))
    assert c.verdicts().count() == 0 and c.reliability().count() == 0


def planted(seed, n):
    """Items whose claim words tell the verdict in four of five cases, each with three fair judges."""
    rnd = random.Random(seed)
    sign = dict(zip(VERDICTS, ("holds", "breaks", "unclear")))
    data, claims, truth = [], [], {}
    for item in range(n):
        truth[item] = t = rnd.choice(VERDICTS)
        word = sign[t] if rnd.random() < 0.8 else rnd.choice(list(sign.values()))
        claims.append((item, "k", "g", "active", f"the {rnd.choice(('cache', 'queue', 'shard'))} {word} number {rnd.randint(0, 50)}", T))
        for judge, right in (("a", 0.6), ("b", 0.6), ("c", 0.6), ("held out", 0.95)):
            data.append((len(data), item, judge, t if rnd.random() < right else rnd.choice(VERDICTS), T, None))
    return data, claims, truth


def test_features_decide_where_judges_cannot(rows):
    """Without the held-out judge, its answers are met more often with features than without."""
    data, claims, truth = planted(6, 900)
    seen, held = [r for r in data if r[2] != "held out"], {r[1]: r[3] for r in data if r[2] == "held out"}
    met = {}
    for features in (True, False):
        fit = Consensus(rows(V, *seen), rows(A), rows(S, *claims), features=features)
        got = {r.assertion_id: r.verdict for r in fit.verdicts().collect()}
        met[features] = sum(got[i] == v for i, v in held.items()), got
    assert met[True][0] > met[False][0] + 30
    assert sum(met[True][1][i] != met[False][1][i] for i in truth) > 50


def test_a_fit_that_is_cut_short_says_so(rows):
    import pytest

    data, claims, _ = planted(6, 60)
    with pytest.warns(UserWarning, match="not converged"):
        fit = Consensus(rows(V, *data), rows(A), rows(S, *claims), max_iter=2)
    assert not any(r.converged for r in fit.reliability().collect())
