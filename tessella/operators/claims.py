"""The claim store as pure plans: verdict roll-up, serving policy, status fold, citations, conflicts.

Rows are event logs; nothing is updated in place.  Whole repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.operators.mixed import folded_text

STATUSES = ("active", "rejected", "stale")
VETOES = ("refuted", "unsupported")
# Labels of an adjudication and the verdicts they mean.
LABELS = {"supported": "supported", "not_supported": "refuted", "uncertain": "unsupported"}


def word(c) -> Column:
    """A label in lower case with joining signs as underscores; null if blank."""
    w = F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n"))), r"[ \t_-]+", "_")
    return F.when(w != "", w)


def known_verdicts(verdicts: DataFrame) -> DataFrame:
    """Distinct verdict rows with judge and verdict in one spelling; other words are null."""
    w = word("verdict")
    return verdicts.distinct().select("verdict_id", "assertion_id", word("judge").alias("judge"), F.when(w.isin("supported", *VETOES), w).alias("verdict"), "created_at")


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """(assertion_id, judge, verdict, verdict_id): each judge's latest known verdict on an assertion."""
    some = known_verdicts(verdicts).filter("verdict IS NOT NULL")
    top = F.max_by(F.struct("verdict", "verdict_id"), F.struct("created_at", "verdict_id"))
    return some.groupBy("assertion_id", "judge").agg(top.alias("t")).select("assertion_id", "judge", "t.verdict", "t.verdict_id")


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """(assertion_id, verdicts): 'judge:verdict' in order of verdict_id."""
    some = known_verdicts(verdicts).filter("verdict IS NOT NULL AND judge IS NOT NULL")
    rows = F.array_sort(F.collect_list(F.struct("verdict_id", F.concat_ws(":", "judge", "verdict").alias("t"))))
    return some.groupBy("assertion_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), ", ").alias("verdicts"))


def serving(claims: DataFrame, verdicts: DataFrame, max_tier: int = 2, require_verdict: bool = True, accepted: tuple[str, ...] = ("supported",)) -> DataFrame:
    """(assertion_id, eligible, reason) in the policy's order: status, tier, vetoed, accepted, pending."""
    if not accepted or set(accepted) & set(VETOES):
        raise ValueError("accepted verdicts must be some, and no vetoes")
    v = known_verdicts(verdicts).filter("verdict IS NOT NULL").groupBy("assertion_id").agg(F.bool_or(F.col("verdict").isin(*VETOES)).alias("veto"), F.bool_or(F.col("verdict").isin(*accepted)).alias("accept"))
    rows = claims.select("assertion_id", "status").distinct().join(v, "assertion_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("status") == "active", F.lit(False)), "status")
        .when(F.lit(max_tier < 2), "tier")
        .when(F.col("veto"), "vetoed")
        .when(F.col("accept"), "eligible")
        .when(F.lit(require_verdict), "verdict_required")
        .otherwise("eligible_pending")
    )
    return rows.select("assertion_id", reason.alias("reason")).withColumn("eligible", F.startswith("reason", F.lit("eligible")))


def folded_status(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(assertion_id, status): 'rejected' from the first verdict other than supported; stale stays stale."""
    bad = known_verdicts(verdicts).filter(F.col("verdict").isin(*VETOES)).select("assertion_id").distinct().withColumn("bad", F.lit(True))
    rows = claims.select("assertion_id", "status").distinct().join(bad, "assertion_id", "left")
    return rows.select("assertion_id", F.when((F.col("status") == "active") & F.col("bad"), "rejected").otherwise(F.col("status")).alias("status"))


def unjudged(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Active claims without a supporting verdict."""
    good = known_verdicts(verdicts).filter("verdict = 'supported'").select("assertion_id")
    return claims.distinct().filter("status = 'active'").join(good, "assertion_id", "left_anti").select("assertion_id", "created_at")


def citations(adjudications: DataFrame) -> DataFrame:
    """(assertion_id, path, line_start, line_end): distinct parsed citations ``path:start-end``."""
    c = adjudications.select("assertion_id", F.explode("citations").alias("c")).distinct()
    pattern = F.lit(r"^(.*):([0-9]+)-([0-9]+)$")
    part = lambda i: F.regexp_extract("c", r"^(.*):([0-9]+)-([0-9]+)$", i)
    return c.filter(F.regexp_like("c", pattern)).select("assertion_id", part(1).alias("path"), part(2).cast("int").alias("line_start"), part(3).cast("int").alias("line_end"))


def covered(cited: DataFrame) -> DataFrame:
    """Adds ``covered``: whether another citation of the claim on that path, larger or equal and earlier, holds it."""
    order = W.partitionBy("assertion_id", "path").orderBy("line_start", F.col("line_end").desc()).rowsBetween(W.unboundedPreceding, -1)
    return cited.withColumn("covered", F.coalesce(F.max("line_end").over(order) >= F.col("line_end"), F.lit(False)))


def canonical_documents(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(assertion_id, document): the text of an active claim that retrieval indexes."""
    spot = F.struct("path", "line_start", "line_end", F.concat(F.col("path"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end")).alias("t"))
    e = cited.groupBy("assertion_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(spot)), lambda r: r["t"]), ", ").alias("evidence"))
    rows = claims.filter("status = 'active'").select("assertion_id", "kind", "subject_qualname", "claim").distinct().join(e, "assertion_id", "left")
    text = F.concat(F.lit("kind: "), F.col("kind"), F.lit("\nsubject: "), F.col("subject_qualname"), F.lit("\nclaim: "), F.col("claim"), F.lit("\nevidence: "), F.coalesce("evidence", F.lit("")))
    return rows.select("assertion_id", text.alias("document"))


def conflicts(claims: DataFrame) -> DataFrame:
    """(subject_qualname, kind, n_claims): subjects with several different active claims of a kind (see ``folded_text``)."""
    said = folded_text(F.col("claim"))
    g = claims.filter("status = 'active'").select("subject_qualname", "kind", said.alias("s")).distinct().groupBy("subject_qualname", "kind")
    return g.agg(F.count("*").alias("n_claims")).filter("n_claims > 1")


def relinked(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """(assertion_id, symbol_id): claims tied to the least symbol that has their subject's name now, or null."""
    now = symbols.groupBy(F.col("qualname").alias("subject_qualname")).agg(F.min("symbol_id").alias("symbol_id"))
    return claims.select("assertion_id", "subject_qualname").distinct().join(now, "subject_qualname", "left").select("assertion_id", "symbol_id")
