"""Evidence for answers: numbered sources under a byte budget, citations, and claims with their proof.

Budgets are bytes of UTF-8.  What does not fit is left out with a reason, and later, smaller items
may still be taken.  Ranks count what is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.operators.budget import take_within
from tessella.operators.serving import first_failures

# Fixed value: the largest budget.
MAX_BUDGET = 65_536


def clamped(budget: int) -> int:
    if budget < 0:
        raise ValueError("a budget is not negative")
    return min(budget, MAX_BUDGET)


def numbered(text, first_line) -> Column:
    """The text with its line numbers: ``<n> | line``."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + first_line).cast("string"), F.lit(" | "), line))
    return F.array_join(lines, "\n")


def sections(items: DataFrame, budget: int) -> DataFrame:
    """(group, id, taken, reason) of (group, id, rank, text): sources in rank order that fit the budget.

    An id counts once, at its best rank; a null text is 'missing'; what does not fit is 'budget'.
    """
    once = items.groupBy("group", "id").agg(F.min("rank").alias("rank"), F.max("text").alias("text"))
    some = once.filter("text IS NOT NULL").select("group", "rank", "id", F.octet_length("text").cast("long").alias("size"))
    taken = take_within(some, clamped(budget))
    rows = once.select("group", "id", F.col("text").isNull().alias("missing")).join(taken, ["group", "id"], "left")
    reason = F.when(F.col("missing"), "missing").when(~F.col("taken"), "budget")
    return rows.select("group", "id", F.coalesce("taken", F.lit(False)).alias("taken"), reason.alias("reason"))


def uncovered(spans: DataFrame) -> DataFrame:
    """Spans of a claim that no larger, or equal and earlier, span of it holds."""
    order = W.partitionBy("assertion_id", "repo_id", "path").orderBy("line_start", F.col("line_end").desc(), "span_id").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("__held", F.coalesce(F.max("line_end").over(order) >= F.col("line_end"), F.lit(False))).filter("NOT __held").drop("__held")


def rendered_citations(checks: DataFrame) -> DataFrame:
    """(assertion_id, citations, size) of claims whose every span still holds: places in canonical order, and their bytes."""
    good = checks.join(first_failures(checks).select("assertion_id"), "assertion_id", "left_anti")
    place = F.struct("path", "line_start", "line_end", "span_id", F.concat(F.col("path"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end")).alias("t"))
    g = uncovered(good).groupBy("assertion_id").agg(F.array_sort(F.collect_list(place)).alias("p"), F.sum(F.col("byte_end") - F.col("byte_start")).cast("long").alias("size"))
    return g.select("assertion_id", F.array_join(F.transform("p", lambda x: x["t"]), ", ").alias("citations"), "size")


def claim_evidence(claims: DataFrame, checks: DataFrame, subjects: DataFrame, budget: int) -> DataFrame:
    """(assertion_id, included, reason, subject_reason): a claim comes with all of its citations or not at all.

    reason: no_citations, citation_<why the first failing span fails>, budget.  The subject's own source
    comes along if it can: subject_not_indexed, covered_by_citation (a citation holds its lines), budget.
    claims: assertion_id, subject; subjects: subject, path, line_start, line_end, size (bytes).
    """
    budget = clamped(budget)
    shown = rendered_citations(checks).select("assertion_id", "size")
    any_span = checks.select("assertion_id").distinct().withColumn("spans", F.lit(True))
    rows = claims.select("assertion_id", "subject").distinct().join(any_span, "assertion_id", "left").join(first_failures(checks).select("assertion_id", F.col("reason").alias("why")), "assertion_id", "left").join(shown, "assertion_id", "left")
    reason = F.when(F.col("spans").isNull(), "no_citations").when(F.col("why").isNotNull(), F.concat(F.lit("citation_"), "why")).when(F.col("size") > budget, "budget")
    rows = rows.withColumn("reason", reason).join(subjects.withColumnRenamed("size", "subject_size").withColumn("indexed", F.lit(True)), "subject", "left")
    held = checks.select("assertion_id", F.col("path"), F.col("line_start").alias("a"), F.col("line_end").alias("z"))
    over = rows.select("assertion_id", "path", "line_start", "line_end").join(held, ["assertion_id", "path"]).filter("a <= line_start AND z >= line_end").select("assertion_id").distinct().withColumn("over", F.lit(True))
    rows = rows.join(over, "assertion_id", "left")
    of_subject = F.when(F.col("reason").isNull(), F.when(F.col("indexed").isNull(), "subject_not_indexed").when(F.col("over"), "covered_by_citation").when(F.col("size") + F.col("subject_size") > budget, "budget"))
    return rows.select("assertion_id", F.col("reason").isNull().alias("included"), "reason", of_subject.alias("subject_reason"))


def bundle(candidates: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """(query_id, candidate_type, id, rank, taken) of ranked candidates under a budget.

    sizes: candidate_type, id, size; candidates without a size are left out.
    """
    rows = candidates.select("query_id", "candidate_type", "id", "rank").join(sizes, ["candidate_type", "id"], "left")
    some = rows.filter("size IS NOT NULL").select(F.col("query_id").alias("group"), "rank", F.col("rank").cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    taken = take_within(some, clamped(budget)).select(F.col("group").alias("query_id"), F.col("id").cast("int").alias("rank"), "taken")
    return rows.join(taken, ["query_id", "rank"], "left").select("query_id", "candidate_type", "id", "rank", F.coalesce("taken", F.lit(False)).alias("taken"))
