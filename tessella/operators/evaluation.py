"""Evaluation of configurations, judges and gates: ablations, deltas, nulls, orders and samples.

Draws are hashes of seed, draw and item, so any engine repeats them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.operators import bootstrap
from tessella.operators.stats import Z95, ranking_metrics
from tessella.plans.order import running
from tessella.plans.ship import ship

METRICS = ("recall", "hit", "ndcg", "ap", "rr")


def scorecards(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(config, query_id, recall, hit, ndcg, ap, rr) of ranked results (config, query_id, id, rank); relevant: query_id, id.

    A query that a configuration finds nothing for scores 0; queries without relevant items do not count.
    """
    gold = relevant.distinct()
    n = gold.groupBy("query_id").agg(F.count("*").alias("relevant"))
    every = results.select("config").distinct().crossJoin(n)  # configurations are a handful
    key = F.concat_ws("/", "config", "query_id")
    marked = results.filter(F.col("rank") <= k).join(gold.withColumn("good", F.lit(1)), ["query_id", "id"], "left")
    hits = marked.select(key.alias("query_id"), key.alias("label"), "rank", F.coalesce("good", F.lit(0)).alias("hit"))
    scores = ranking_metrics(hits, every.select(key.alias("label"), "relevant"), k).drop("query_id")
    rows = every.withColumn("label", key).join(scores, "label", "left")
    return rows.select("config", "query_id", *(F.coalesce(m, F.lit(0.0)).cast("double").alias(m) for m in METRICS))


def ablation(cards: DataFrame) -> DataFrame:
    """(config, n, mean of each metric), rounded to four places."""
    return cards.groupBy("config").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in METRICS))


def delta_report(cards: DataFrame, base: str, metric: str = "ndcg", resamples: int = bootstrap.RESAMPLES) -> DataFrame:
    """(config, n, delta, low, high, differs, few): each configuration against ``base``, paired by query.

    ``differs`` says that the 95 % interval leaves out 0, ``few`` that fewer than 128 queries speak.
    """
    old = cards.filter(F.col("config") == base).select("query_id", F.col(metric).alias("was"))
    d = cards.filter(F.col("config") != base).join(old, "query_id").select("config", F.col("query_id").alias("cluster"), (F.col(metric) - F.col("was")).alias("value"))
    out = None
    for row in d.select("config").distinct().orderBy("config").collect():  # configurations are a handful
        one = d.filter(F.col("config") == row[0]).select("cluster", "value")
        ci = bootstrap.interval(one, resamples).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        part = one.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("delta")).crossJoin(ci).select(F.lit(row[0]).alias("config"), "n", "delta", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = cards.sparkSession.createDataFrame([], "config string, n long, delta double, low double, high double")
    return out.withColumn("differs", (F.col("low") > 0) | (F.col("high") < 0)).withColumn("few", F.col("n") < 128)


def lift_interval(values: DataFrame, resamples: int = bootstrap.RESAMPLES) -> DataFrame:
    """(mean, low, high) of (cluster, value); with fewer than two clusters both bounds are the mean."""
    mean = values.agg(F.avg("value").alias("mean"), F.count_distinct("cluster").alias("k"))
    ci = bootstrap.interval(values, resamples).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    pick = lambda c: F.round(F.when(F.col("k") < 2, F.col("mean")).otherwise(F.col(c)), 6)
    return mean.crossJoin(ci).select(F.round("mean", 6).alias("mean"), pick("a").alias("low"), pick("b").alias("high"))


def log_ratio(runs: DataFrame, base: str, resamples: int = bootstrap.RESAMPLES) -> DataFrame:
    """(arm, tasks, ratio, low, high): geometric mean over tasks of an arm's mean over the base arm's, of (task, arm, value > 0)."""
    m = runs.filter("value > 0").groupBy("task", "arm").agg(F.avg("value").alias("m"))
    b = m.filter(F.col("arm") == base).select("task", F.col("m").alias("b"))
    r = m.filter(F.col("arm") != base).join(b, "task").select("arm", F.col("task").alias("cluster"), F.log(F.col("m") / F.col("b")).alias("value"))
    out = None
    for row in r.select("arm").distinct().orderBy("arm").collect():  # arms are a handful
        one = r.filter(F.col("arm") == row[0]).select("cluster", "value")
        ci = bootstrap.interval(one, resamples).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        part = one.agg(F.count("*").alias("tasks"), F.avg("value").alias("v")).crossJoin(ci)
        part = part.select(F.lit(row[0]).alias("arm"), "tasks", *(F.round(F.exp(c), 4).alias(n) for c, n in (("v", "ratio"), ("low", "low"), ("high", "high"))))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else runs.sparkSession.createDataFrame([], "arm string, tasks long, ratio double, low double, high double")


def derangement_null(items: DataFrame, score, draws: int = 500, seed: int = 20) -> DataFrame:
    """(observed, null_mean, null_sd, p) of (id, cluster, a, b): how often pairs dealt at random score as high as the real ones.

    A draw puts the items in an order by hash and hands each item the next one's ``b``, so no item keeps
    its own; pairs within a cluster are left out.  p = (1 + draws at least as high) / (1 + draws).
    ``score`` makes a number of the columns a and b.
    """
    observed = items.agg(F.round(F.avg(score(F.col("a"), F.col("b"))), 9).alias("observed"))
    each = items.select("id", "cluster", "a", "b").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    each = each.withColumn("h", F.md5(F.concat_ws("-", F.lit(seed), "d", "id").cast("binary")))
    order = W.partitionBy("d").orderBy("h", "id")
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    dealt = each.withColumn("b2", nxt("b")).withColumn("cluster2", nxt("cluster")).filter("cluster <> cluster2")
    per = dealt.groupBy("d").agg(F.round(F.avg(score(F.col("a"), F.col("b2"))), 9).alias("m"))
    both = per.crossJoin(observed).groupBy("observed").agg(F.round(F.avg("m"), 6).alias("null_mean"), F.round(F.stddev_samp("m"), 6).alias("null_sd"), F.round((1 + F.count(F.when(F.col("m") >= F.col("observed"), 1))) / (1 + F.count("*")), 6).alias("p"))
    return both.withColumn("observed", F.round("observed", 6))


def arm_orders(blocks: DataFrame, arms: list[str], seed: int = 20) -> DataFrame:
    """(block, arm, position): each block's own order of the arms."""
    rows = blocks.select("block").distinct().withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    order = W.partitionBy("block").orderBy(F.md5(F.concat_ws("-", F.lit(seed), "block", "arm").cast("binary")), "arm")
    return rows.withColumn("position", F.row_number().over(order))


def stratified_sample(items: DataFrame, n: int, seed: int = 20) -> DataFrame:
    """(id, stratum) of ``n`` items taken in turn from the strata, each in an order by hash."""
    within = W.partitionBy("stratum").orderBy(F.md5(F.concat_ws("-", F.lit(seed), "id").cast("binary")), "id")
    return items.select("id", "stratum").distinct().withColumn("turn", F.row_number().over(within)).filter(F.col("turn") <= n).orderBy("turn", "stratum").limit(n).select("id", "stratum")


def instrument_abort(answers: DataFrame, least: int = 10, share: float = 0.2) -> DataFrame:
    """(judge, n, failures) where a judge is first stopped: after ``least`` answers, more than ``share`` of them failures.

    answers: judge, place (a total order per judge), failed (boolean).
    """
    some = answers.select("judge", "place", F.lit(1).alias("one"), F.col("failed").cast("int").alias("bad")).filter(F.col("judge").isNotNull())
    rows = running(some, ["judge"], ["place"], {"n": "one", "failures": "bad"})
    stop = rows.filter((F.col("n") >= least) & (F.col("failures") > share * F.col("n")))
    return stop.groupBy("judge").agg(F.min(F.struct("n", "failures")).alias("s")).select("judge", "s.n", "s.failures")


def perturbed(text, citations, bodies) -> dict[str, Column]:
    """The evidence text under each perturbation; citations and bodies are its spans' arrays, in order."""
    n = F.size(citations)
    block = lambda i, k: F.concat(F.lit("--- span "), i.cast("string"), F.lit(" of "), n.cast("string"), F.lit(": "), F.get(citations, k), F.lit(" ---\n"), F.get(bodies, k))
    turned = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: block(i, n - i)), "\n")
    return {
        "identity": text,
        "span_order": F.when(n < 2, text).otherwise(turned),
        "trailing_whitespace": F.concat(F.replace(text, F.lit("\n"), F.lit("  \n")), F.lit("  ")),
        "separator_style": F.regexp_replace(text, r"(?m)^--- (span [^\n]*?) ---$", "=== $1 ==="),
        "blank_lines": F.regexp_replace(text, r"\n(--- span )", "\n\n$1"),
    }


def evidence_text(citations, bodies) -> Column:
    n = F.size(citations)
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("--- span "), i.cast("string"), F.lit(" of "), n.cast("string"), F.lit(": "), F.get(citations, i - 1), F.lit(" ---\n"), F.get(bodies, i - 1))), "\n")


def flip_rates(answers: DataFrame) -> DataFrame:
    """(perturbation, n, flips, rate) of (id, perturbation, verdict) against the verdict on the unchanged text."""
    plain = answers.filter("perturbation = 'identity'").select("id", F.col("verdict").alias("plain"))
    g = answers.join(plain, "id").groupBy("perturbation").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") != F.col("plain"), 1)).alias("flips"))
    return g.withColumn("rate", F.round(F.col("flips") / F.col("n"), 6))


def judge_pairs(answers: DataFrame) -> DataFrame:
    """(judge_a, judge_b, a, b, n): how often two judges gave which labels to the same item; answers: item, judge, label.

    Pairs are made within an item, whose answers are as many as judges, and counted before anything is shuffled on.
    """
    a = answers.select("item", F.col("judge").alias("judge_a"), F.col("label").alias("a"))
    b = answers.select("item", F.col("judge").alias("judge_b"), F.col("label").alias("b"))
    return a.join(b, "item").filter("judge_a < judge_b").groupBy("judge_a", "judge_b", "a", "b").agg(F.count("*").alias("n"))


def calibration(confusion: DataFrame, positive: str = "supported") -> DataFrame:
    """(judge_a, judge_b, n, agreement, precision, recall, kappa) of judge_pairs, judge_a taken as the truth."""
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    pa, pb = F.col("a") == positive, F.col("b") == positive
    keys = ["judge_a", "judge_b"]
    base = confusion.groupBy(*keys).agg(F.sum("n").alias("total"), hit(F.col("a") == F.col("b")).alias("same"), hit(pa & pb).alias("tp"), hit(pb).alias("said"), hit(pa).alias("true"))
    x = confusion.groupBy(*keys, F.col("a").alias("l")).agg(F.sum("n").alias("x"))
    y = confusion.groupBy(*keys, F.col("b").alias("l")).agg(F.sum("n").alias("y"))
    chance = x.join(y, [*keys, "l"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("total"), F.coalesce("xy", F.lit(0)) / (F.col("total") * F.col("total"))
    r = lambda c: F.round(c, 6)
    return base.join(chance, keys, "left").select(*keys, F.col("total").alias("n"), r(po).alias("agreement"), r(F.try_divide("tp", "said")).alias("precision"), r(F.try_divide("tp", "true")).alias("recall"), r(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def _upper(failures: int, n: int, alpha: float) -> float:
    """The rate at which no more than ``failures`` of ``n`` would still be seen with chance alpha, by bisection."""
    if n <= 0:
        raise ValueError("no trials")
    if failures >= n:
        return 1.0
    if failures == 0:
        return 1 - alpha ** (1 / n)
    lo, hi = failures / n, 1.0
    for _ in range(100):
        p = (lo + hi) / 2
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(failures + 1))
        lo, hi = (p, hi) if tail > alpha else (lo, p)
    return (lo + hi) / 2


def clopper_pearson(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ``upper`` to (key, failures, n): the exact one-sided bound; rows without trials raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["upper"] = [round(_upper(int(f), int(n), alpha), 9) for f, n in zip(b["failures"], b["n"])]
            yield b

    ship(counts.sparkSession)
    return counts.select("key", "failures", "n").mapInPandas(run, counts.select("key", "failures", "n").schema.add("upper", "double"))


def sd_interval(sd, n) -> tuple[Column, Column]:
    """Bounds of a standard deviation at 95 %, by the cube-root approximation of chi-square quantiles."""
    k = n - 1
    quantile = lambda z: k * F.pow(1 - 2 / (9 * k) + z * F.sqrt(2 / (9 * k)), 3)
    return F.when(k > 0, sd * F.sqrt(k / quantile(Z95))), F.when(k > 0, sd * F.sqrt(k / quantile(-Z95)))


#: Families of gate submissions and the code that must refuse them; null for those that must pass.
FAMILIES = {
    "zero_evidence": "evidence_required", "empty_claim": "empty_claim", "unverifiable_span": "evidence_unverifiable", "absent_file": "evidence_stale", "escaping_path": "span_escapes_repo",
    "past_eof": "evidence_stale", "blank_range": "invalid_span", "zero_length_span": "invalid_span", "decoy_content_hash": "evidence_stale", "foreign_symbol_hash": "evidence_stale", "unknown_subject": "unknown_subject",
    "published_hash": None, "multi_span": None,
}


def gate_corpus(good: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, spans, expected) of submissions made from good spans, one of each family per span.

    good: repo_id, span_id, path, subject, line_start, line_end, byte_start, byte_end, content_hash, all of
    which pass the gate.  An assertion_id names family and span.
    """
    rows = good.withColumn("family", F.explode(F.array(*map(F.lit, FAMILIES))))
    fam = F.col("family")
    rows = rows.withColumn("assertion_id", F.xxhash64("family", "repo_id", "span_id"))
    to = lambda family, column, value: F.when(fam == family, value).otherwise(F.col(column)).alias(column)
    claims = rows.select("assertion_id", to("unknown_subject", "subject", F.lit("no.such.name")), F.when(fam == "empty_claim", F.lit("  ")).otherwise(F.lit("It holds.")).alias("claim"))
    path = F.when(fam == "absent_file", F.concat("path", F.lit(".gone"))).when(fam == "escaping_path", F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path")
    begin = F.when(fam == "blank_range", F.lit(None)).otherwise(F.col("byte_start")).cast("int").alias("byte_start")
    end = F.when(fam == "past_eof", F.lit(2_000_000_000)).when(fam == "zero_length_span", F.col("byte_start")).otherwise(F.col("byte_end")).cast("int").alias("byte_end")
    digest = (
        F.when(fam == "unverifiable_span", F.lit(" ")).when(fam == "decoy_content_hash", F.sha2(F.col("content_hash"), 256)).when(fam == "foreign_symbol_hash", F.sha2(F.concat("content_hash", F.lit("x")), 256))
        .otherwise(F.col("content_hash")).alias("content_hash")
    )
    spans = rows.filter("family <> 'zero_evidence'").select("assertion_id", "repo_id", "span_id", path, begin, end, digest, "line_start", "line_end")
    twice = rows.filter("family = 'multi_span'").select("assertion_id", "repo_id", (-F.col("span_id")).alias("span_id"), "path", "byte_start", "byte_end", "content_hash", "line_start", "line_end")
    code = F.lit(None).cast("string")
    for name, expect in FAMILIES.items():
        if expect:
            code = F.when(fam == name, expect).otherwise(code)
    return claims, spans.unionByName(twice), rows.select("assertion_id", "family", code.alias("expect"))


def gate_report(expected: DataFrame, refusals: DataFrame) -> DataFrame:
    """(family, n, held): submissions per family, and those that met exactly the expected code."""
    return expected.join(refusals, "assertion_id", "left").groupBy("family").agg(F.count("*").alias("n"), F.count(F.when(F.col("refusal").eqNullSafe(F.col("expect")), 1)).alias("held"))
