"""One verdict per item from several judges who disagree: feature-assisted consensus by EM.

Model: an item's true verdict t has the prior softmax(W x + b) of a regularised classifier over the
item's features x; judge j answers l with probability C_j[t, l].  Expectation gives every item a
posterior over t; maximisation re-estimates the confusion matrices from posterior counts (with a
Dirichlet prior) and takes one step of the classifier towards the posteriors, by a fixed diagonal bound
on its curvature (half of X'X's row sums), with momentum.

Features are what is known of an item before any judge has seen it: kind, generator, confidence in
tenths and the words of the claim, hashed into disjoint ranges.  The status is none, as verdicts make it.

An iteration is one narrow pass over the written item table: a task sums its items' statistics and
returns one row per (judge, answer) and feature it met, which Spark adds up.  Only the model lives
on the driver: nine numbers per judge and three per feature.  Judges are annotators and not data;
their number is checked against ``MAX_JUDGES`` before the first iteration.

Answers: spellings that differ by case, blanks or joining signs are one word or judge.  A judge has
one answer per item: of valid answers, the latest verdict (by created_at, then verdict_id), or else
the adjudication (of several, the alphabetically first label).  Answers that are null or another
word, adjudications with a cause other than 'judged', and rows without judge or item are no answers.
Items without a row in the claims table have the mean prior.  The fit ends when no
confusion rate moves by the tolerance and no weight by twice that; if it has not by max_iter, it warns, and
``reliability`` says so.  Ties go to supported, then refuted, then unsupported.
Empty tables give no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.plans.scratch import Scratch

# Verdicts in order of preference among equals, and the labels that mean them.
VERDICTS = ("supported", "refuted", "unsupported")
LABELS = {"supported": "supported", "notsupported": "refuted", "uncertain": "unsupported"}
#: Hashed features: of fields, of words, and the bias as the last.
FIELD_FEATURES, FEATURES = 512, 4096
MAX_JUDGES = 200_000
MIN_JUDGES = 3
_K = len(VERDICTS)


def spelled(c) -> F.Column:
    """A word or name without case, blanks and joining signs; null if nothing is left."""
    s = F.lower(F.regexp_replace(c, r"[\s\p{Z}\p{Pd}\p{Pc}]+", ""))
    return F.when(s != "", s)


def answers(verdicts: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(assertion_id, judge, label): one valid answer per item and judge; label is 0, 1 or 2."""
    v = verdicts.select("assertion_id", spelled("judge").alias("judge"), spelled("verdict").alias("word"), F.lit(1).alias("rank"), "created_at", F.col("verdict_id").cast("long").alias("n"))
    meant = F.col("word")
    for said, means in LABELS.items():
        meant = F.when(F.col("word") == said, means).otherwise(meant)
    a = (
        adjudications.filter(F.coalesce(spelled("cause"), F.lit("")) == "judged")
        .select("assertion_id", spelled("judge").alias("judge"), spelled("label").alias("word"), F.lit(0).alias("rank"))
        .filter(F.col("word").isin(*LABELS))
        .withColumn("word", meant)
    )
    index = F.when(F.col("word") == VERDICTS[0], 0).when(F.col("word") == VERDICTS[1], 1).when(F.col("word") == VERDICTS[2], 2)
    both = v.unionByName(a, allowMissingColumns=True).withColumn("label", index)
    valid = both.filter(F.col("label").isNotNull() & F.col("judge").isNotNull() & F.col("assertion_id").isNotNull())
    latest = F.max_by("label", F.struct("rank", "created_at", "n", -F.col("label")))
    return valid.groupBy("assertion_id", "judge").agg(latest.cast("byte").alias("label"))


def item_features(assertions: DataFrame) -> DataFrame:
    """(assertion_id, x): hashed features of kind, generator, confidence and claim words; one row per item.

    Columns that the table lacks give no features; of several rows of an item the latest counts.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("claim"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2))
    hashed = F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(FEATURES - 1 - FIELD_FEATURES)) + FIELD_FEATURES).cast("int"))
    known = [c for c in ("created_at", "kind", "generator", "confidence", "claim") if c in assertions.columns]
    told = {"kind": F.col("kind"), "generator": F.col("generator"), "confidence": F.floor(F.col("confidence").cast("double") * 10)}
    fields = F.array(*(F.pmod(F.xxhash64(F.lit(f), c), F.lit(FIELD_FEATURES)).cast("int") for f, c in told.items() if f in known)).cast("array<int>")
    none = F.array().cast("array<int>")
    x = F.array_distinct(F.concat(fields, F.coalesce(hashed, none) if "claim" in known else none))
    rows = assertions.filter(F.col("assertion_id").isNotNull()).select("assertion_id", *known)
    once = rows.groupBy("assertion_id").agg(F.max(F.struct(*known)).alias("a")).select("assertion_id", "a.*") if known else rows.distinct()
    return once.select("assertion_id", x.alias("x"))


def _unpack(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Flat arrays of a batch: answer's item, judge, label; feature's item, feature."""
    n_a = b["judges"].str.len().to_numpy()
    n_x = np.array([0 if x is None else len(x) for x in b["x"]], int)
    item = np.repeat(np.arange(len(b)), n_a)
    judge = np.concatenate(b["judges"].to_list()).astype(np.int64)
    label = np.concatenate(b["labels"].to_list()).astype(np.int64)
    some = [x for x in b["x"] if x is not None and len(x)]
    feature = np.concatenate(some).astype(np.int64) if some else np.zeros(0, np.int64)
    x_item = np.repeat(np.arange(len(b)), n_x)
    # the bias
    feature = np.r_[feature, np.full(len(b), FEATURES - 1)]
    x_item = np.r_[x_item, np.arange(len(b))]
    return item, judge, label, x_item, feature


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _posterior(b: pd.DataFrame, log_c: np.ndarray | None, w: np.ndarray):
    item, judge, label, x_item, feature = _unpack(b)
    n = len(b)
    z = np.zeros((n, _K))
    np.add.at(z, x_item, w[feature])
    prior = _softmax(z)
    if log_c is None:  # first pass: shares of the answers
        q = np.zeros((n, _K))
        np.add.at(q, (item, label), 1.0)
        q /= q.sum(1, keepdims=True)
    else:
        q = np.log(prior)
        np.add.at(q, item, log_c[judge, :, label])
        q = _softmax(q)
    return prior, q, (item, judge, label, x_item, feature)


_STAT = "part string, i long, j long, k long, v double"


def _statistics(log_c: np.ndarray | None, w: np.ndarray, n_judges: int, curvature: bool):
    """A pass over items that sums what the maximisation needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((n_judges, _K, _K))
        grad = np.zeros((FEATURES, _K))
        bound = np.zeros(FEATURES)
        for b in batches:
            if not len(b):
                continue
            prior, q, (item, judge, label, x_item, feature) = _posterior(b, log_c, w)
            for t in range(_K):
                np.add.at(counts[:, t, :], (judge, label), q[item, t])
            np.add.at(grad, feature, (q - prior)[x_item])
            if curvature:
                np.add.at(bound, feature, np.bincount(x_item, minlength=len(b)).astype(float)[x_item])
        for part, m in (("c", counts), ("g", grad[:, :, None]), ("x", bound[:, None, None])):
            at = np.nonzero(m)
            if len(at[0]):
                yield pd.DataFrame({"part": part, "i": at[0], "j": at[1], "k": at[2], "v": m[at]})

    return run


class Consensus:
    """Fits the model; then items and judges can be read off."""

    def __init__(self, verdicts: DataFrame, adjudications: DataFrame, assertions: DataFrame, max_iter: int = 100, tolerance: float = 2e-3, ridge: float = 20.0, features: bool = True):
        """``features=False`` leaves the classifier its bias only."""
        spark = verdicts.sparkSession
        self.scratch = Scratch(spark)
        said = self.scratch.cut(answers(verdicts, adjudications))
        names = said.groupBy("judge").count().orderBy("judge").limit(MAX_JUDGES + 1).collect()
        if len(names) > MAX_JUDGES:
            raise ValueError(f"more than {MAX_JUDGES} judges")
        self.judges = [r[0] for r in names]
        number = spark.createDataFrame([(r[0], i) for i, r in enumerate(names)], "judge string, j int")
        packed = said.join(number, "judge").groupBy("assertion_id").agg(F.array_sort(F.collect_list(F.struct("j", "label"))).alias("a"))
        rows = packed.join(item_features(assertions), "assertion_id", "left").select(
            "assertion_id", F.col("a.j").alias("judges"), F.transform("a", lambda s: s["label"].cast("int")).alias("labels"), ("x" if features else F.lit(None).cast("array<int>").alias("x"))
        )
        self.items = self.scratch.cut(rows)
        self._fit(max_iter, tolerance, ridge)

    def _pass(self, log_c, curvature: bool):
        n = len(self.judges)
        sums = self.items.mapInPandas(_statistics(log_c, self.w, n, curvature), _STAT).groupBy("part", "i", "j", "k").agg(F.sum("v").alias("v")).toPandas()
        counts, grad, bound = np.zeros((n, _K, _K)), np.zeros((FEATURES, _K)), np.zeros((FEATURES, 1))
        for part, into in (("c", counts), ("g", grad), ("x", bound)):
            s = sums[sums["part"] == part]
            ijk = (s["i"], s["j"], s["k"]) if part == "c" else (s["i"], s["j"])
            into[tuple(np.asarray(a) for a in ijk)] = s["v"]
        return counts, grad, bound

    def _fit(self, max_iter: int, tolerance: float, ridge: float) -> None:
        n = len(self.judges)
        self.w = np.zeros((FEATURES, _K))
        self.log_c, self.iterations = None, 0
        self.c = np.full((n, _K, _K), 1 / _K)
        self.converged = True
        if not n:
            return
        penalty = np.full(FEATURES, ridge)
        penalty[-1] = 1e-3  # the bias is hardly held back
        step, last, pace = None, self.w, 0
        prior = 0.5 + np.eye(_K) * 1.0
        for self.iterations in range(1, max_iter + 1):
            counts, grad, bound = self._pass(self.log_c, step is None)
            if step is None:
                step = 1 / (0.5 * bound + penalty[:, None])
            c = counts + prior
            c /= c.sum(2, keepdims=True)
            up = step * (grad - penalty[:, None] * self.w)
            w = self.w + up
            moved = max(np.abs(c - self.c).max(), np.abs(up).max() / 2)  # a log odds of 0.004 is as little as a rate of 0.002
            # momentum, until it points against the step
            pace = pace + 1 if (up * (w - last)).sum() >= 0 else 1
            self.c, self.log_c, self.w, last = c, np.log(c), w + (pace - 1) / (pace + 2) * (w - last), w
            self.share = counts.sum((0, 2)) / counts.sum()
            self.n_answers = counts.sum((1, 2))
            self.converged = bool(moved < tolerance)
            if self.converged:
                return
        warnings.warn(f"not converged after {max_iter} iterations: a rate or weight still moved by {moved:.4f}", stacklevel=3)

    def verdicts(self) -> DataFrame:
        """assertion_id, verdict, confidence, n_judges, agreement (share of agreeing pairs of answers)."""
        log_c, w = self.log_c, self.w

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                _, q, (item, _, label, _, _) = _posterior(b, log_c, w)
                n = b["judges"].str.len().to_numpy()
                per = np.zeros((len(b), _K))
                np.add.at(per, (item, label), 1.0)
                pairs = n * (n - 1)
                agreeing = (per * (per - 1)).sum(1)
                best = q.argmax(1)
                yield pd.DataFrame(
                    {
                        "assertion_id": b["assertion_id"],
                        "verdict": np.array(VERDICTS)[best],
                        "confidence": q.max(1).round(6),
                        "n_judges": n.astype(np.int32),
                        "agreement": np.where(pairs > 0, agreeing / np.maximum(pairs, 1), np.nan),
                    }
                )

        out = self.items.mapInPandas(run, "assertion_id long, verdict string, confidence double, n_judges int, agreement double")
        return out.withColumn("agreement", F.nanvl("agreement", F.lit(None)))

    def reliability(self) -> DataFrame:
        """judge, n_answers, accuracy (chance of the true verdict), information (bits per answer), converged."""
        rows = []
        for j, name in enumerate(self.judges):
            joint = self.share[:, None] * self.c[j]
            bits = float((joint * np.log2(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))).sum())
            rows.append((name, int(round(self.n_answers[j])), float(joint.trace()), bits, self.converged))
        return self.items.sparkSession.createDataFrame(rows, "judge string, n_answers long, accuracy double, information double, converged boolean")

    def alpha(self) -> DataFrame:
        """Krippendorff's alpha for nominal answers over all items with two or more answers."""
        a = self.items.filter(F.size("labels") > 1).select("assertion_id", F.size("labels").alias("m"), F.explode("labels").alias("label"))
        per = a.groupBy("assertion_id", "m", "label").count()
        seen = per.groupBy().agg(
            F.sum(F.col("count") * (F.col("m") - F.col("count")) / (F.col("m") - 1)).alias("differ"), F.sum("count").alias("n")
        )
        marginal = per.groupBy("label").agg(F.sum("count").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("same"))
        expected = (F.col("n") * F.col("n") - F.col("same")) / (F.col("n") - 1)
        return seen.crossJoin(marginal).select("n", F.round(1 - F.try_divide("differ", expected), 6).alias("alpha"))
