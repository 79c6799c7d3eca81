"""Passages that two texts share, without a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import squeezed
from tessella.plans.scratch import Scratch
from tessella.plans.spread import spread

WINDOW = 32
#: Tasks over which the texts with one probe are spread.
SALTS = 8


def text_classes(texts: DataFrame, key: str) -> DataFrame:
    """(key, rep): texts that are equal after squeezing, with the least key of their class."""
    t = texts.filter(F.col("text").isNotNull()).select(key, F.xxhash64(squeezed(F.col("text"))).alias("h"), F.md5(squeezed(F.col("text"))).alias("m"))
    reps = t.groupBy("h", "m").agg(F.min(key).alias("rep"))
    return t.join(reps, ["h", "m"]).select(key, "rep").distinct()


def _shared(secrets: DataFrame, texts: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(same, asked, held): surroundings that share a window, and the probes of secrets and texts with theirs."""
    step = window // 4
    size = window - step + 1
    side = step - 1

    def probes(df: DataFrame, key: str, every: int) -> DataFrame:
        t = spread(df.select(F.col(key), "text")).select(F.col(key), squeezed(F.col("text")).alias("t")).filter(F.length("t") >= window).groupBy("t").agg(F.min(key).alias(key))
        at = t.select(key, "t", F.explode(F.sequence(F.lit(1), F.length("t") - size + 1, F.lit(every))).alias("p"))
        left = F.substr("t", F.greatest(F.lit(1), F.col("p") - side), F.least(F.lit(side), F.col("p") - 1))
        return at.select(key, F.substr("t", F.col("p"), F.lit(size)).alias("gram"), left.alias("left"), F.substr("t", F.col("p") + size, F.lit(side)).alias("right"))

    salt = F.pmod(F.xxhash64("l2", "r2"), F.lit(SALTS)).alias("salt")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    asked = scratch.cut(probes(secrets, "secret_id", 1).select("secret_id", "gram", F.col("left").alias("l1"), F.col("right").alias("r1")).distinct())
    held = probes(texts, "text_id", step).join(asked.select("gram").distinct(), "gram", "left_semi").select("text_id", "gram", F.col("left").alias("l2"), F.col("right").alias("r2")).distinct()
    held = scratch.cut(held)
    s = asked.select("gram", "l1", "r1").distinct().select("*", every)
    x = held.select("gram", "l2", "r2").distinct().select("*", salt)

    def grows(i: Column) -> Column:
        j = F.lit(side) - i
        same_left = (F.length("l1") >= i) & (F.length("l2") >= i) & (F.right("l1", i) == F.right("l2", i))
        return same_left & (F.length("r1") >= j) & (F.length("r2") >= j) & (F.left("r1", j) == F.left("r2", j))

    same = scratch.cut(s.join(x, ["gram", "salt"]).filter(F.exists(F.sequence(F.lit(0), F.lit(side)), grows)).select("gram", "l1", "r1", "l2", "r2"))
    return same, asked, held


def shared_windows(secrets: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(secret_id, text_id): pairs whose blank-squeezed texts share ``window`` characters in a row.

    Copies count once: the pairs are of the least id of each class of equal texts on either side, and
    ``text_classes`` tells the members.  Of the texts only every ``window/4``-th position is a probe,
    three quarters of a window long: any shared window holds a whole probe.  Secrets give probes at
    every position.  The characters around a match decide whether it grows to a window.  Null and
    shorter texts match nothing.

    A passage that stands in very many texts is one hot probe.  What stands around it is grouped first,
    on both sides: one row for all texts with the same surroundings, so the comparison is made once per
    pair of surroundings and not of texts; and the texts' side is salted, so that one probe's rows are
    many tasks'.
    """
    scratch = Scratch(texts.sparkSession)
    same, asked, held = _shared(secrets, texts, window, scratch)
    return same.join(asked, ["gram", "l1", "r1"]).select("secret_id", "gram", "l2", "r2").distinct().join(held, ["gram", "l2", "r2"]).select("secret_id", "text_id").distinct()


def leaking(secrets: DataFrame, texts: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts, secrets) that share a window with any of the other side: (text_id, n_passages) and (secret_id, n_passages).

    Linear in both tables, as no pairs of them are made; passages are distinct probes that match.  Copies
    are told by their least id, as in ``shared_windows``.
    """
    same, asked, held = _shared(secrets, texts, window, Scratch(texts.sparkSession))
    of_texts = held.join(same.select("gram", "l2", "r2").distinct(), ["gram", "l2", "r2"], "left_semi")
    of_secrets = asked.join(same.select("gram", "l1", "r1").distinct(), ["gram", "l1", "r1"], "left_semi")
    n = F.count_distinct("gram").alias("n_passages")
    return of_texts.groupBy("text_id").agg(n), of_secrets.groupBy("secret_id").agg(n)
