"""Mixing sources to target weights by weighted fair queueing.

Every source hands out its documents in shuffled order, as often as it may repeat them.  A copy's
*virtual finish time* is the source's tokens up to and with it, divided by the source's weight, so
at any virtual time every source that still has documents has given tokens in proportion to its
weight.  The copies of all sources are range-sorted by finish time, and the mix ends where the
total budget is used up.

The virtual time v* at which the budget is used up follows from the totals alone: it solves
sum over sources of min(cap, weight x v) = budget, cap being max_repeats x tokens.  A source lags its
due tokens by less than one document, so every copy that finishes by v* is in the mix, and none is
that finishes after v_hi, where the due tokens less one longest document per source make up the
budget.  Copies beyond v_hi are never made.  Only those in between are put in order to find the cut;
how many they are depends on the number of sources and the longest document, not on the corpus.

No source is ever ordered in one task.  The running sums are two-level: the shuffle key's leading
part cuts a source into buckets, sums per bucket are turned into offsets (a small table), and rows
are ordered within their bucket only.  The stretch from v* to v_hi is halved into slots again and
again until the slot that holds the cut has at most ``ROWS_PER_BUCKET`` rows.

Defined results: documents without text or source, or of sources without target, take no part.
Targets are read once per source; a missing or non-positive weight counts as 0 and its source gives
nothing; a missing max_repeats counts as 1.  A listed source without documents has 0 tokens.
Documents repeated under one doc_id are repeated documents.  Ties in the shuffle key are ordered by
doc_id.  An empty corpus gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from tessella.plans.scratch import Scratch

#: Rows that a bucket holds on average; bounds the rows ordered in one task.
ROWS_PER_BUCKET = 20_000
#: Slots into which the stretch that holds the cut is divided in each round.
SLOTS = 1024
#: Targets are a configuration and not data; more raise an error before anything is queued.
MAX_TARGETS = 100_000


def clean_targets(targets: DataFrame) -> DataFrame:
    one = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t"))
    return one.select(
        "source",
        F.when(F.col("t.weight") > 0, F.col("t.weight")).otherwise(0.0).cast("double").alias("weight"),
        F.greatest(F.lit(0), F.coalesce("t.max_repeats", F.lit(1))).cast("int").alias("max_repeats"),
    )


def source_tokens(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that take part."""
    part = docs.filter(F.length("text") > 0).join(clean_targets(targets).select("source"), "source", "left_semi")
    return count_tokens(part.select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary)


def target_totals(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with its tokens, its documents, T (``all_tokens``), and whether it falls short."""
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"), F.max("n_tokens").alias("longest"))
    every = clean_targets(targets).join(sums, "source", "left").select(
        "source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest")
    )
    with_all = every.crossJoin(every.agg(F.sum("tokens").alias("all_tokens")))  # one row
    return with_all.withColumn("short", F.col("weight") * F.col("all_tokens") > F.col("max_repeats") * F.col("tokens"))


def _buckets(n: int) -> int:
    return max(16, 1 << math.ceil(math.log2(max(1, n / ROWS_PER_BUCKET))))


def due_time(sources: list[tuple[float, float]], budget: float) -> float:
    """The least v with sum(min(cap, weight * v)) >= budget over (weight, cap); inf if there is none."""
    ends = sorted((cap / w, w, cap) for w, cap in sources if w > 0 and cap > 0)
    rate, spent = sum(w for _, w, _ in ends), 0.0  # spent: the caps of the sources that ran out
    for end, w, cap in ends:
        if spent + rate * end >= budget:
            return max(0.0, (budget - spent) / rate)
        rate, spent = rate - w, spent + cap
    return math.inf if budget > 0 else 0.0


class FairQueue:
    """The queue of all sources' copies up to a virtual time, and what is read off it."""

    def __init__(self, docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 20, vocabulary: str = DEFAULT_VOCABULARY):
        self.scratch = scratch = Scratch(docs.sparkSession)
        self.counted = scratch.cut(source_tokens(docs, targets, vocabulary))
        self.totals = scratch.cut(target_totals(self.counted, targets))
        per = self.totals.limit(MAX_TARGETS + 1).collect()
        if len(per) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.all_tokens = max((r["all_tokens"] for r in per), default=0)
        self.n_docs = sum(r["n_docs"] for r in per)
        self.budget = self.all_tokens if budget is None else budget
        shares = [(r["weight"], r["max_repeats"] * r["tokens"]) for r in per]
        lag = sum(r["longest"] for r in per if r["weight"] > 0)
        self.v_star = due_time(shares, self.budget)
        self.v_hi = due_time(shares, self.budget + lag)
        self.seed = seed

    def copies(self, upto: float) -> DataFrame:
        """doc_id, source, copy (from 0), n_tokens, finish of the copies that finish by virtual time ``upto``."""
        n = _buckets(self.n_docs)
        key = F.xxhash64(F.lit(self.seed), "doc_id")
        keyed = self.counted.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 64 - int(math.log2(n))))
        sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
        before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        offsets = sums.select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
        within = W.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
        ranked = keyed.join(offsets, ["source", "bucket"]).withColumn("upto", F.col("offset") + F.sum("n_tokens").over(within))
        per_source = self.totals.filter("weight > 0 AND max_repeats > 0").select("source", "weight", "max_repeats", "tokens")
        finish = (F.col("copy") * F.col("tokens") + F.col("upto")) / F.col("weight")
        joined = ranked.join(per_source, "source")
        if math.isfinite(upto):  # one more than fit, against rounding; the filter below is exact
            fit = F.floor((F.lit(upto) * F.col("weight") - F.col("upto")) / F.col("tokens")) + 1
            joined = joined.withColumn("made", F.least(F.col("max_repeats") - 1, fit.cast("long"))).filter("made >= 0")
        else:
            joined = joined.withColumn("made", F.col("max_repeats") - 1)
        every = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("made").cast("int"))))
        out = every.select("doc_id", "source", "copy", "n_tokens", finish.alias("finish"))
        return out.filter(F.col("finish") <= upto) if math.isfinite(upto) else out

    def short_sources(self) -> DataFrame:
        """(source): those whose queue runs out before its share of T is due.

        At virtual time T a source that still has copies has given weight x T tokens.  A source is
        short if all its copies finish before that; the inequality on the totals is checked after.
        """
        due = float(self.all_tokens)
        early = self.copies(due).filter(F.col("finish") < due).groupBy("source").agg(F.count("*").alias("n"))
        out = self.totals.join(early, "source", "left").filter(F.coalesce("n", F.lit(0)) == F.col("max_repeats") * F.col("n_docs"))
        return out.filter("short").select("source")

    def mix(self) -> DataFrame:
        """The copies of the mix, in order of finish."""
        columns = ["doc_id", "source", "copy", "n_tokens", "finish"]
        copies = self.scratch.cut(self.copies(self.v_hi))
        lo, hi, left = self.v_star, self.v_hi, self.budget
        order = ("finish", "source", "doc_id", "copy")
        if not math.isfinite(lo):
            return copies.orderBy(*order)
        hi = hi if math.isfinite(hi) else (copies.agg(F.max("finish")).first()[0] or 0.0)
        # (lo, hi] is the stretch in which the cut lies; all up to lo is taken
        left -= copies.filter(F.col("finish") <= lo).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        while True:
            stretch = copies.filter((F.col("finish") > lo) & (F.col("finish") <= hi))
            rows = stretch.count()
            if rows <= ROWS_PER_BUCKET or not lo < lo + (hi - lo) / SLOTS < hi:
                break
            slot = F.least(F.lit(SLOTS - 1), F.floor((F.col("finish") - lo) / ((hi - lo) / SLOTS))).cast("int")
            sums = stretch.groupBy(slot.alias("slot")).agg(F.sum("n_tokens").alias("t"), F.min("finish").alias("a"), F.max("finish").alias("b")).orderBy("slot").collect()  # at most SLOTS rows
            for _, t, a, b in sums:
                if t > left:
                    lo, hi = math.nextafter(a, -math.inf), b
                    break
                left -= t
            else:
                lo = hi
                break
        edge = W.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        last = copies.filter((F.col("finish") > lo) & (F.col("finish") <= hi)).withColumn("sum", F.sum("n_tokens").over(edge)).filter(F.col("sum") <= left)
        return copies.filter(F.col("finish") <= lo).select(columns).unionByName(last.select(columns)).orderBy(*order)


def fair_mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 20, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mix, totals).  mix: doc_id, source, copy (from 0), n_tokens, finish; in order of finish.

    ``budget`` is in tokens and is T, the tokens of all documents that take part, unless given.
    """
    queue = FairQueue(docs, targets, budget, seed, vocabulary)
    return queue.mix(), queue.totals


def mix_shares(mix: DataFrame, totals: DataFrame) -> DataFrame:
    """Per target: its weight, the tokens and documents taken, the share reached, and repeats used."""
    taken = mix.groupBy("source").agg(F.sum("n_tokens").alias("taken"), F.count("*").alias("n_taken"), F.max("copy").alias("c"))
    every = totals.join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    total = every.agg(F.sum("taken").alias("mix_tokens"))
    return every.crossJoin(total).select(
        "source",
        "weight",
        "tokens",
        "taken",
        F.coalesce("n_taken", F.lit(0)).alias("n_taken"),
        (F.coalesce("c", F.lit(-1)) + 1).alias("repeats"),
        F.round(F.coalesce(F.try_divide("taken", "mix_tokens"), F.lit(0.0)), 6).alias("share"),
        "short",
    )
