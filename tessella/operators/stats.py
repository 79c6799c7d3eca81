"""Evaluation statistics as aggregations and column arithmetic.

Over empty input, rates and intervals are null, design effects are 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.plans.order import at_ranks

# Normal quantiles of a 95 % interval and of 80 % power.
Z95, Z_POWER = 1.959964, 0.841621


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """recall, hit, nDCG, average precision and reciprocal rank per query at ``k``.

    hits: query_id, label, rank, hit (0 or 1); relevant: label, relevant.
    """
    order = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    run = hits.filter(F.col("rank") <= k).withColumn("hits", F.sum("hit").over(order))
    per = run.groupBy("query_id", "label").agg(
        F.sum("hit").alias("found"),
        F.max("hit").alias("hit"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("ap"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.join(relevant, "label").filter("relevant > 0").select(
        "query_id",
        "label",
        F.round(F.col("found") / F.col("relevant"), 6).alias("recall"),
        "hit",
        F.round(F.col("dcg") / best, 6).alias("ndcg"),
        F.round(F.col("ap") / F.least(F.col("relevant"), F.lit(k)), 6).alias("ap"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"),
    )


def wilson(successes, total) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null where there are no trials."""
    p, z2 = F.try_divide(successes, total), Z95 * Z95
    mid = (p + F.try_divide(F.lit(z2), 2 * total)) / (1 + F.try_divide(F.lit(z2), total))
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p), total) + F.try_divide(F.lit(z2), 4 * total * total)) / (1 + F.try_divide(F.lit(z2), total))
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def design_effect(values: DataFrame) -> DataFrame:
    """One row ``deff`` of (cluster, value): 1 + (mean size - 1) * ICC by analysis of variance, at least 1.

    Clusters of one are left out of the variances, but not of the grand mean.
    """
    groups = values.groupBy("cluster").agg(F.count("*").alias("m"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"))
    grand = values.agg(F.avg("value").alias("grand"), F.count_distinct("cluster").alias("clusters"))
    sized = groups.filter("m > 1").crossJoin(grand)  # one row
    s = sized.agg(
        F.count("*").alias("g"), F.sum("m").alias("n"), F.avg("m").alias("size"), F.max("clusters").alias("clusters"),
        F.sum(F.col("m") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"), F.sum(F.col("m") * F.col("v")).alias("within"),
    )
    msb, msw = F.try_divide("between", F.col("g") - 1), F.try_divide("within", F.col("n") - F.col("g"))
    denom = msb + (F.col("size") - 1) * msw
    icc = F.when((F.col("clusters") > 1) & (denom > 0), (msb - msw) / denom)
    return s.select(F.round(F.greatest(F.lit(1.0), F.coalesce(1 + (F.col("size") - 1) * icc, F.lit(1.0))), 6).alias("deff"))


def kish_correction(outcomes: DataFrame) -> DataFrame:
    """One row (n, clusters, icc, deff) of (cluster, outcome 0 or 1) with Kish's mean cluster size."""
    per = outcomes.groupBy("cluster").agg(F.count("*").alias("m"), F.avg("outcome").alias("r"))
    total = outcomes.agg(F.count("*").alias("n"), F.avg("outcome").alias("p"))
    s = per.crossJoin(total).groupBy("n").agg(  # total is one row
        F.count("*").alias("k"), F.sum(F.col("m") * F.col("r") * (1 - F.col("r"))).alias("w"), F.sum(F.col("m") * F.pow(F.col("r") - F.col("p"), 2)).alias("b"), F.sum(F.col("m") * F.col("m")).alias("mm")
    )
    mw, mb = F.col("w") / (F.col("n") - F.col("k")), F.col("b") / (F.col("k") - 1)
    m0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("k") - 1)
    denom = mb + (m0 - 1) * mw
    icc = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(denom > 0, (mb - mw) / denom).otherwise(0.0)))
    return s.filter("k >= 2 AND k < n").select("n", F.col("k").alias("clusters"), F.round(icc, 6).alias("icc"), F.round(1 + (m0 - 1) * icc, 6).alias("deff"))


def required_n(sd, delta: float, deff=None, power: float = 0.8) -> Column:
    """Queries needed to see a difference ``delta`` at a paired standard deviation ``sd``."""
    z = Z95 + (Z_POWER if power >= 0.8 else 0.0)
    d = F.greatest(F.lit(1.0), deff) if deff is not None else F.lit(1.0)
    return F.when((sd > 0) & F.lit(delta > 0), F.ceil(d * F.pow(z * sd / delta, 2))).otherwise(0)


def nearest_rank(values: DataFrame, ps: list[float]) -> DataFrame:
    """(p, value): the sorted values' element at min(n - 1, int(p * n)); nulls do not count."""
    some = values.select(F.lit(0).alias("group"), "value").filter(F.col("value").isNotNull())
    n = some.agg(F.count("*").alias("n")).filter("n > 0")
    wanted = values.sparkSession.createDataFrame([(float(p),) for p in ps], "p double").crossJoin(n)  # one row
    at = F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n")))
    return at_ranks(some, wanted.select(F.lit(0).alias("group"), F.col("p").alias("tag"), at.alias("at"))).select(F.col("tag").alias("p"), "value")


def medians(values: DataFrame) -> DataFrame:
    """(group, median) of (group, value): the middle value, or the mean of the two in the middle; nulls do not count."""
    n = values.filter(F.col("value").isNotNull()).groupBy("group").agg(F.count("*").alias("n"))
    tags = F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.floor((F.col("n") - 1) / 2).alias("at")), F.struct(F.lit(1).alias("tag"), F.floor(F.col("n") / 2).alias("at"))))
    return at_ranks(values.select("group", "value"), n.select("group", tags.alias("w")).select("group", "w.tag", "w.at")).groupBy("group").agg(F.avg("value").alias("median"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """One row (n, agreement, kappa) of (a, b) label pairs."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("l")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(F.col("b").alias("l")).agg(F.sum("c").alias("y"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return n.crossJoin(chance).filter("n > 0").select("n", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))
