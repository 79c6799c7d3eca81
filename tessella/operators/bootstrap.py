"""Bootstrap intervals with draws that any engine can repeat.

The draw of resample b at position i is the first 32 bits of md5('seed-b-i') modulo n, so results
do not depend on a generator's state and resamples are made where the data is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators.stats import nearest_rank
from tessella.plans.order import numbered

RESAMPLES = 2000


def draws(spark, resamples: int, n: int, seed: int) -> DataFrame:
    """(b, i, pick) for every resample and position."""
    n = max(1, n)
    # one range, of whose size the planner knows; exploded sequences pass for small and are broadcast through the driver
    each = spark.range(resamples * n).select(F.expr(f"id div {n}").alias("b"), F.expr(f"id % {n}").alias("i"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "b", "i").cast("binary")), 1, 8), 16, 10).cast("long")
    return each.select("b", "i", (bits % n).alias("pick"))


def cluster_means(values: DataFrame, resamples: int, seed: int = 20) -> DataFrame:
    """(b, value): the mean over each resample of clusters of (cluster, value).

    Clusters are drawn whole; with one cluster per row this is the plain bootstrap.  Only sums and
    counts per cluster take part, numbered in order of their name.  A single cluster would be the
    same in every resample, so its values are drawn one by one, numbered in order of their size.
    """
    c = values.groupBy("cluster").agg(F.sum("value").alias("s"), F.count("value").alias("m"))
    n = c.count()
    key = "cluster"
    if n == 1:
        c, key = values.filter("value IS NOT NULL").select(F.col("value").alias("s"), F.lit(1).alias("m")), "s"
        n = c.count()
    picked = draws(values.sparkSession, resamples, n, seed).join(numbered(c, [key], "pick"), "pick")
    return picked.groupBy("b").agg((F.sum("s") / F.sum("m")).alias("value"))


def interval(values: DataFrame, resamples: int = RESAMPLES, alpha: float = 0.05, seed: int = 20) -> DataFrame:
    """(p, value): the percentile interval's bounds at alpha/2 and 1 - alpha/2."""
    return nearest_rank(cluster_means(values, resamples, seed).select(F.round("value", 9).alias("value")), [alpha / 2, 1 - alpha / 2])
