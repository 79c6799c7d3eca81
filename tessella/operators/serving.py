"""Serving claims: span checks in two stages, first failures, expiry, reinstatement and reports.

Pure plans over event tables: what would be written back (expiries, log rows, baselines) is returned
as rows for the caller to append.  Spans are (assertion_id, repo_id, span_id, path, byte_start,
byte_end, content_hash); a claim without spans is never served.  Null keys match nothing, repeated
rows count once, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions.text import path_escapes
from tessella.operators.code import current_states, first_states

SPAN = ["assertion_id", "repo_id", "span_id", "path", "byte_start", "byte_end", "content_hash"]
# Limits of a submission.
MAX_SPANS, MAX_CLAIM_CHARS = 32, 4096


def evidence_spans(cited: DataFrame, symbols: DataFrame) -> DataFrame:
    """The spans of citations (assertion_id, path, line_start, line_end) that name a symbol's lines exactly."""
    s = symbols.select("repo_id", F.col("symbol_id").alias("span_id"), "path", "line_start", "line_end", "byte_start", "byte_end", "content_hash").distinct()
    return cited.join(s, ["path", "line_start", "line_end"]).select(*SPAN, "line_start", "line_end").distinct()


def _slice_hash(bytes_col: str):
    return F.sha2(F.substr(bytes_col, F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start")), 256)


def baselines(spans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, span_id, mtime0, size0, hash0): what each span was when its file was first seen."""
    once = spans.select("repo_id", "span_id", "path", "byte_start", "byte_end").distinct()
    first = first_states(snapshots).filter("state = 'present' AND bytes IS NOT NULL").select("repo_id", "path", F.col("mtime_ns").alias("mtime0"), F.col("size_bytes").alias("size0"), F.col("bytes").alias("_b"))
    some = once.join(first, ["repo_id", "path"]).filter("byte_start >= 0 AND byte_end > byte_start AND octet_length(_b) >= byte_end")
    return some.select("repo_id", "span_id", "mtime0", "size0", _slice_hash("_b").alias("hash0"))


def with_baselines(spans: DataFrame, base: DataFrame) -> DataFrame:
    """Spans with their baseline, or nulls."""
    return spans.join(base.dropDuplicates(["repo_id", "span_id"]), ["repo_id", "span_id"], "left")


def two_stage(spans: DataFrame, base: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Spans with ``reason`` ('ok' or why not), ``method`` ('stat' or 'hash'), ``observed`` and ``verified_ns``.

    In this order: file_missing, unreadable, invalid_span; unchanged time and size against a baseline
    that had the cited hash are ok without a hash; then span_truncated, hash_mismatch.
    """
    now = current_states(snapshots).select("repo_id", "path", "state", "bytes", "mtime_ns", "size_bytes")
    rows = with_baselines(spans, base).join(now, ["repo_id", "path"], "left")
    gone = F.col("state").isNull() | (F.col("state") == "absent")
    unread = (F.col("state") == "unreadable") | F.col("bytes").isNull()
    bad = ~F.coalesce((F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")), F.lit(False))
    fast = F.coalesce((F.col("mtime_ns") == F.col("mtime0")) & (F.col("size_bytes") == F.col("size0")) & (F.col("hash0") == F.col("content_hash")), F.lit(False))
    short = F.octet_length("bytes") < F.col("byte_end")
    hashed = F.when(~(gone | unread | bad | fast | short), _slice_hash("bytes"))
    rows = rows.withColumn("fast", fast & ~(gone | unread | bad)).withColumn("observed", hashed)
    reason = (
        F.when(gone, "file_missing").when(unread, "unreadable").when(bad, "invalid_span").when(F.col("fast"), "ok")
        .when(short, "span_truncated").when(F.col("observed") != F.col("content_hash"), "hash_mismatch").otherwise("ok")
    )
    method = F.when(F.col("fast"), "stat").otherwise("hash")
    return rows.select(*[c for c in spans.columns], reason.alias("reason"), method.alias("method"), "observed", F.when(F.col("fast"), F.col("mtime0")).otherwise(F.col("mtime_ns")).alias("verified_ns"))


def rebaselined(checks: DataFrame) -> DataFrame:
    """(repo_id, span_id, verified_ns, hash0): the new baselines of spans that a hash has just confirmed."""
    return checks.filter("reason = 'ok' AND method = 'hash'").select("repo_id", "span_id", "verified_ns", F.col("content_hash").alias("hash0")).distinct()


def first_failures(checks: DataFrame) -> DataFrame:
    """(assertion_id, span_id, reason, expected, observed) of each claim's first failing span in order of ids."""
    bad = checks.filter("reason <> 'ok'")
    f = bad.groupBy("assertion_id").agg(F.min(F.struct("span_id", "repo_id", "reason", "content_hash", "observed")).alias("f"))
    return f.select("assertion_id", "f.span_id", "f.reason", F.col("f.content_hash").alias("expected"), "f.observed")


def outcomes(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """(assertion_id, status, outcome, reason): what verification makes of each claim.

    served; no_evidence (no spans); unverifiable (first failure is unreadable: withheld, never expired);
    expired (any other first failure).
    """
    n = checks.groupBy("assertion_id").agg(F.count("*").alias("n"))
    rows = claims.select("assertion_id", "status").distinct().join(n, "assertion_id", "left").join(first_failures(checks).select("assertion_id", "reason"), "assertion_id", "left")
    outcome = F.when(F.col("n").isNull(), "no_evidence").when(F.col("reason").isNull(), "served").when(F.col("reason") == "unreadable", "unverifiable").otherwise("expired")
    return rows.select("assertion_id", "status", outcome.alias("outcome"), "reason")


def servable(claims: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(served, expiries) of the active claims; expiries are rows to append to the log."""
    o = outcomes(claims.filter("status = 'active'"), checks)
    gone = o.filter("outcome = 'expired'").select("assertion_id")
    return o.filter("outcome = 'served'").select("assertion_id"), first_failures(checks).join(gone, "assertion_id", "left_semi")


def mark_stale(claims: DataFrame, expiries: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses, new log rows): active claims that expire become stale, once; what the log has is not logged again."""
    new = expiries.join(claims.filter("status = 'active'").select("assertion_id").distinct(), "assertion_id", "left_semi").join(log.select("assertion_id"), "assertion_id", "left_anti")
    due = expiries.select("assertion_id").distinct().withColumn("due", F.lit(True))
    rows = claims.select("assertion_id", "status").distinct().join(due, "assertion_id", "left")
    return rows.select("assertion_id", F.when((F.col("status") == "active") & F.col("due"), "stale").otherwise(F.col("status")).alias("status")), new


def reinstated(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """(assertion_id, reinstated): stale claims, and whether all their spans match again (those without spans do not)."""
    o = outcomes(claims.filter("status = 'stale'"), checks)
    return o.select("assertion_id", (F.col("outcome") == "served").alias("reinstated"))


def served_assertions(claims: DataFrame, checks: DataFrame, include_stale: bool = True, include_unverifiable: bool = True) -> DataFrame:
    """(assertion_id, state, reason, verified_ns, method): active claims by what their evidence says now.

    A claim was verified when its longest unchecked span was, by its weakest method.
    """
    per = checks.groupBy("assertion_id").agg(F.min("verified_ns").alias("verified_ns"), F.max(F.col("method")).alias("method"))
    o = outcomes(claims.filter("status = 'active'"), checks).filter("outcome <> 'no_evidence'").join(per, "assertion_id")
    state = F.when(F.col("outcome") == "served", "fresh").when(F.col("outcome") == "unverifiable", "unverifiable").otherwise("stale")
    keep = (F.lit(include_stale) | (F.col("state") != "stale")) & (F.lit(include_unverifiable) | (F.col("state") != "unverifiable"))
    return o.withColumn("state", state).filter(keep).select("assertion_id", "state", "reason", "verified_ns", "method")


def refresh_report(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: checked = fresh + expired + unverifiable active claims, and reasons with their counts."""
    o = outcomes(claims.filter("status = 'active'"), checks)
    r = o.groupBy("outcome", F.coalesce("reason", F.when(F.col("outcome") == "no_evidence", F.lit("no_evidence"))).alias("reason")).agg(F.count("*").alias("n"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("outcome").isin(*k), F.col("n"))), F.lit(0))
    by = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", "n")))), ", ")
    return r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), n(["served"]).alias("fresh"), n(["expired", "no_evidence"]).alias("expired"), n(["unverifiable"]).alias("unverifiable"), by.alias("by_reason"))


def narrowed_citations(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """(assertion_id, span_id, symbol_id): spans that end with a symbol of the file but begin inside it."""
    s = symbols.select("repo_id", "path", F.col("byte_end"), F.col("byte_start").alias("symbol_start"), "symbol_id").distinct()
    return spans.join(s, ["repo_id", "path", "byte_end"]).filter("symbol_start < byte_start").select("assertion_id", "span_id", "symbol_id").distinct()


def line_numbers(spans: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, span_id, line_start, line_end) of byte spans of (repo_id, path, bytes), by counting line ends before them."""
    before = lambda n: F.regexp_count(F.substr("bytes", F.lit(1), n).cast("string"), F.lit("\n")) + 1
    some = spans.filter("byte_start >= 0 AND byte_end > byte_start").join(files, ["repo_id", "path"]).filter("octet_length(bytes) >= byte_end")
    return some.select("repo_id", "span_id", before(F.col("byte_start")).alias("line_start"), before(F.col("byte_end") - 1).alias("line_end"))


def claim_admission(claims: DataFrame, spans: DataFrame, subjects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(assertion_id, refusal): the code with which the gate refuses each submission, or null.

    claims: assertion_id, subject, claim.  The first stage that fails decides: evidence_required,
    empty_claim; then the spans' own faults in order of ids (invalid_span, span_escapes_repo,
    evidence_unverifiable); then unknown_subject; then what the files say (evidence_unverifiable where
    unreadable, else evidence_stale).
    """
    none = spans.select("repo_id", "span_id").limit(0).select("*", F.lit(None).cast("long").alias("mtime0"), F.lit(None).cast("long").alias("size0"), F.lit(None).cast("string").alias("hash0"))
    checks = two_stage(spans, none, snapshots)
    lines = ~F.coalesce((F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")), F.lit(False))
    own = (
        F.when((F.col("reason") == "invalid_span") | ~F.coalesce((F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")), F.lit(False)) | lines, "invalid_span")
        .when(path_escapes(F.col("path")), "span_escapes_repo")
        .when(F.coalesce(F.trim("content_hash"), F.lit("")) == "", "evidence_unverifiable")
    )
    later = F.when(F.col("reason") == "unreadable", "evidence_unverifiable").when(F.col("reason") != "ok", "evidence_stale")
    rank = lambda stage, code: F.min(F.when(code.isNotNull(), F.struct(F.lit(stage).alias("stage"), F.col("span_id"), code.alias("code"))))
    per = checks.groupBy("assertion_id").agg(rank(2, own).alias("own"), rank(4, later).alias("later"), F.count("*").alias("n"))
    known = subjects.select(F.col("qualname").alias("subject")).distinct().withColumn("known", F.lit(True))
    rows = claims.select("assertion_id", "subject", "claim").distinct().join(per, "assertion_id", "left").join(known, "subject", "left")
    code = (
        F.when(F.col("n").isNull(), "evidence_required")
        .when(F.coalesce(F.trim("claim"), F.lit("")) == "", "empty_claim")
        .when(F.col("own").isNotNull(), F.col("own.code"))
        .when(F.col("known").isNull(), "unknown_subject")
        .otherwise(F.col("later.code"))
    )
    return rows.select("assertion_id", code.alias("refusal"))


def submission_limits(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """(assertion_id, fault): the first limit a submission (assertion_id, claim, confidence) breaks, or null."""
    n = spans.groupBy("assertion_id").agg(F.count("*").alias("n"))
    c = F.col("confidence")
    fault = (
        F.when(F.col("n") > MAX_SPANS, "too_many_spans")
        .when(F.length("claim") > MAX_CLAIM_CHARS, "claim_too_long")
        .when(c.isNotNull() & (F.isnan(c) | (c < 0) | (c > 1)), "bad_confidence")
    )
    return claims.select("assertion_id", "claim", "confidence").distinct().join(n, "assertion_id", "left").select("assertion_id", fault.alias("fault"))


def verified_hits(hits: DataFrame, eligible: DataFrame, served: DataFrame, k: int, cap: int = 400) -> DataFrame:
    """(query_id, assertion_id, score, rank): of the first ``cap`` hits the first ``k`` that policy and verification let pass.

    Hits that fall out are made up for by later ones, so only fewer than ``k`` good hits give fewer rows.
    """
    from tessella.operators.retrieval import ranked

    pool = hits.filter(F.col("rank") <= cap).drop("rank")
    good = pool.join(eligible.select("assertion_id").distinct(), "assertion_id", "left_semi").join(served.select("assertion_id").distinct(), "assertion_id", "left_semi")
    return ranked(good, "assertion_id", k)
