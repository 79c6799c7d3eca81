"""Text functions of mining against plain Python, evaluation against brute force, and hot passages."""

import math
import random
import re

import pytest

from tessella.functions import text as X
from tessella.operators import bootstrap, evaluation as V, leaks, mining, stats
from tessella.plans.order import numbered

PROSE = [
    "Fix the reaper\n\nIt calls `tail(x)` now. Then it waits! \"Quoted\" start.\n\n- first bullet of db.py. And more\n- second\n  goes on\n\n1. one\n2) two",
    "", "   ", "no end", "a.b c? D e.g. this", "x\n \t\ny", "• dot\n* star", "Ends with dots... And then",
]


def units(prose):
    out = []
    for block in re.split(r"\n[ \t]*\n", prose):
        for piece in re.split(r"(?m)^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+", block.strip(" \t\r\n")):
            flat = re.sub(r"[ \t\n\r\f\v]+", " ", piece).strip()
            out += [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z`\"'(—-])", flat) if s.strip()]
    return out


def test_units(rows):
    got = rows("i int, t string", *enumerate(PROSE)).select("i", X.text_units("t").alias("u")).collect()
    assert {r.i: r.u for r in got} == {i: units(t) for i, t in enumerate(PROSE)}


@pytest.mark.parametrize("unit, name, hit", [
    ("money shots verified", "money", False), ("calls money(x)", "money", True), ("see `a money b`", "money", True), ("fmt.money is", "money", True), ("set money = 3", "money", True), ("if money == 3", "money", False),
    ("uses bind_root here", "bind_root", True), ("uses xbind_root", "bind_root", False), ("a BlackBoard", "BlackBoard", True), ("events.tail", "tail", True), ("x+y", "x+y", False), (None, "a", None), ("", "a", False),
])
def test_mentions(rows, unit, name, hit):
    assert rows("u string, n string", (unit, name)).select(X.mentions(X.F.col("u"), X.F.col("n")).alias("m")).first().m is hit


def test_words_and_answers(rows):
    one = lambda c, *v: rows("a string, b string", (*v, *(None,) * (2 - len(v)))).select(c).first()[0]
    a = X.F.col("a")
    assert one(X.identifier_words(a), "HTTPServer_v2Xy") == ["http", "server", "v", "2", "xy"]
    assert one(X.content_tokens(a), "The bind_managed_root binds A cache; it's x9") == ["bind", "managed", "root", "binds", "cache"]
    assert one(X.one_purpose(a), "<think>hm</think>```\nHere is the purpose: - Keeps rows. And more.\n```") == "Keeps rows."
    assert one(X.one_purpose(a), "Purpose: " + "w " * 60).split() == ["w"] * 40 and one(X.one_purpose(a), "```") == "```"
    src = '@d\ndef f(a,\n      b=1):  # c\n    """Doc."""\n    x = """kept"""\n'
    assert one(X.without_docstring(a), src) == '@d\ndef f(a,\n      b=1):  # c\n    \n    x = """kept"""\n' and one(X.without_docstring(a), "def g(): pass") == "def g(): pass"
    assert one(X.model_lineage(a), "hf.co/user/Opus-4:latest") == "claude" and one(X.model_family(a), "openbmb/minicpm-o4.5:latest") == "minicpm"


def test_labels_of_commits(rows):
    commits = rows("commit_id long, text string, prose string", (1, "a.py b.py", "Touch it. `load` is faster now. Load it. And load() again"), (2, "c.py", "load() here"), (3, "", None))
    symbols = rows("symbol_id long, path string, name string", (1, "a.py", "load"), (2, "b.py", "save"), (3, "z.py", "load"))
    got = [tuple(r) for r in mining.mined_labels(commits, mining.commit_files(commits), symbols).collect()]
    assert got == [(1, 1, "`load` is faster now. And load() again", 2)]


def test_ranks_medians_and_numbers_in_parts(rows, spark):
    rnd = random.Random(1)
    vals = [rnd.choice([rnd.randint(0, 9), rnd.random()]) for _ in range(5000)]
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(vals)] + [(7, None)], "`group` int, value double")
    s = sorted(map(float, vals))
    got = {r.p: r.value for r in stats.nearest_rank(df, [0.0, 0.3, 0.5, 0.999, 1.0]).collect()}
    assert got == {p: s[min(len(s) - 1, int(p * len(s)))] for p in got} and len(got) == 5
    import statistics

    med = {r.group: r.median for r in stats.medians(df).collect()}
    assert med == {g: statistics.median([float(v) for i, v in enumerate(vals) if i % 3 == g]) for g in range(3)}
    n = numbered(spark.range(1000, 0, -1).selectExpr("id * 7 % 1001 AS k"), ["k"], "n").collect()
    assert [r.n for r in sorted(n, key=lambda r: r.k)] == list(range(1000))
    from tessella.plans.order import running

    data = [(i % 2, i * 37 % 500, i % 5) for i in range(500)]
    got = {(r.g, r.k): r.s for r in running(spark.createDataFrame(data, "g int, k int, v int"), ["g"], ["k"], {"s": "v"}).collect()}
    assert got == {(g, k): sum(v for a, b, v in data if a == g and b <= k) for g, k, _ in data}
    assert stats.nearest_rank(df.limit(0), [0.5]).count() == 0 and stats.medians(df.limit(0)).count() == 0


def test_exact_bounds():
    assert abs(V._upper(0, 10, 0.05) - (1 - 0.05**0.1)) < 1e-12 and V._upper(5, 5, 0.05) == 1.0
    p = V._upper(3, 20, 0.05)
    assert abs(sum(math.comb(20, i) * p**i * (1 - p) ** (20 - i) for i in range(4)) - 0.05) < 1e-9
    with pytest.raises(ValueError):
        V._upper(0, 0, 0.05)


def test_nulls_samples_and_orders(rows):
    items = rows("id long, cluster string, a string, b string", *((i, f"c{i % 4}", f"word{i} same", f"word{i} other") for i in range(40)))
    r = V.derangement_null(items, mining.token_f1, draws=50).first()
    assert r.observed == 0.5 and r.null_mean == 0.0 and abs(r.p - 1 / 51) < 1e-6
    s = V.stratified_sample(rows("id long, stratum string", *((i, "rare" if i < 3 else "common") for i in range(100))), 8).collect()
    assert len(s) == 8 and sum(x.stratum == "rare" for x in s) == 3
    orders = V.arm_orders(rows("block long", (1,), (2,), (1,)), ["a", "b", "c"]).collect()
    assert {b: sorted(o.arm for o in orders if o.block == b) for b in (1, 2)} == {1: ["a", "b", "c"], 2: ["a", "b", "c"]}
    one = V.lift_interval(rows("cluster string, value double", ("x", 1.0), ("x", 2.0)), 50).first()
    assert one.mean == one.low == one.high == 1.5


def test_ablation_counts_queries_without_hits(rows):
    res = rows("config string, query_id long, id long, rank int", ("a", 1, 5, 1), ("a", 1, 6, 2), ("b", 2, 9, 3))
    gold = rows("query_id long, id long", (1, 6), (2, 9), (2, 9))
    cards = {(r.config, r.query_id): r for r in V.scorecards(res, gold).collect()}
    assert len(cards) == 4 and cards["a", 1].rr == 0.5 and cards["a", 2].recall == 0 and abs(cards["b", 2].ndcg - 0.5) < 1e-6
    d = V.delta_report(V.scorecards(res, gold), "a", "recall", 100).collect()
    assert [x.config for x in d] == ["b"] and d[0].n == 2 and d[0].few and d[0].delta == 0.0


def test_draws_are_what_the_definition_says(spark):
    import hashlib

    got = {(r.b, r.i): r.pick for r in bootstrap.draws(spark, 3, 7, 20).collect()}
    assert got == {(b, i): int(hashlib.md5(f"20-{b}-{i}".encode()).hexdigest()[:8], 16) % 7 for b in range(3) for i in range(7)}


def test_a_passage_in_very_many_texts(rows):
    """Pairs equal brute force where one passage stands in most texts, at different places and in different company."""
    rnd = random.Random(5)
    hot = "this very passage stands in nearly every text"
    word = lambda n: "".join(rnd.choice("abcdef ") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 40)) + (hot if i % 5 else hot[: rnd.randint(20, 45)]) + word(rnd.randint(0, 30))) for i in range(60)] + [(99, None)]
    secrets = [(i, word(rnd.randint(0, 20)) + hot[rnd.randint(0, 12) :] + word(9)) for i in range(6)] + [(50, "short"), (51, None)]
    got = {tuple(r) for r in leaks.shared_windows(rows("secret_id long, text string", *secrets), rows("text_id long, text string", *texts)).collect()}
    sq = lambda s: re.sub(r"[ \t\n\r\f\v]+", " ", s).strip(" ")
    want = {(a, b) for a, s in secrets if s for b, t in texts if t and any(sq(s)[p : p + 32] in sq(t) for p in range(len(sq(s)) - 31))}
    assert got == want and len(want) > 100
