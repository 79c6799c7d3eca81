"""Code-graph operators: files, symbols, parents, chunks, drift and span checks.

All are compositions of built-in operators.  Null keys match nothing, empty tables give no rows,
and repeated rows count once where an operator speaks of files or symbols.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.functions.text import is_test_path, path_escapes
from tessella.plans.scratch import Scratch
from tessella.plans.spread import spread

MAX_CHUNK_CHARS = 24_000
TRUNCATED = "\n# ... [truncated: symbol exceeds MAX_CHUNK_CHARS]"


def _picked(snapshots: DataFrame, order: list) -> DataFrame:
    """The first row of every (repo_id, path) by ``order``; rows without a path are left out.

    Contents are not shuffled: where the table comes from files, only keys and the places of rows
    (file, row number) are grouped, and only paths with several rows come out of that, which a
    history table has few of.  The scan of the contents then drops the rows that lost; it is a
    broadcast join as long as Spark finds that list small, and a shuffle of the table beyond.
    Tables that do not come from files are ordered by a window.
    """
    rows = snapshots.filter(F.col("path").isNotNull())
    try:
        located = rows.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__row_place"))
    except AnalysisException:
        by_window = W.partitionBy("repo_id", "path").orderBy(*order)
        return rows.withColumn("__row_no", F.row_number().over(by_window)).filter("__row_no = 1").drop("__row_no")
    keys = located.select("repo_id", "path", F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("__row_place").alias("at")).alias("o"))
    won = keys.groupBy("repo_id", "path").agg(F.min("o").alias("o"), F.count("*").alias("n")).filter("n > 1")
    won = Scratch(snapshots.sparkSession).cut(won.select(F.col("repo_id").alias("__won_repo"), F.col("path").alias("__won_path"), F.col("o.at").alias("__won_place")))
    joined = located.join(won, F.col("repo_id").eqNullSafe(F.col("__won_repo")) & (F.col("path") == F.col("__won_path")), "left")
    out = joined.filter(F.col("__won_place").isNull() | (F.col("__won_place") == F.col("__row_place"))).select(*snapshots.columns)
    return spread(out) if "bytes" in snapshots.columns else out


def _last(c) -> list:
    """A number in falling order, nulls last, for use in rising structs."""
    return [F.col(c).isNull(), -F.col(c)]


def current_states(snapshots: DataFrame, present_first: bool = False) -> DataFrame:
    """One row per path: the state with the largest mtime_ns.

    Of equal times the first by name of the state wins ('absent' before 'present'), or with
    ``present_first`` the present one; then the largest size_bytes, if there is that column.
    """
    tie = [F.coalesce(F.col("state") != "present", F.lit(True))] if present_first else [F.col("state")]
    size = _last("size_bytes") if "size_bytes" in snapshots.columns else []
    return _picked(snapshots, [*_last("mtime_ns"), *tie, *size])


def first_states(snapshots: DataFrame) -> DataFrame:
    return _picked(snapshots, [F.col("mtime_ns").isNull(), F.col("mtime_ns"), F.col("state"), *_last("size_bytes")])


def first_definitions(symbols: DataFrame) -> DataFrame:
    """The first definition of every qualname of a repository, in order of path, line and id."""
    order = W.partitionBy("repo_id", "qualname").orderBy("path", F.col("line_start").asc_nulls_last(), "symbol_id")
    return symbols.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def parent_links(symbols: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, qualname, parent_id): the symbol named by the qualname without its last part."""
    parents = symbols.select("repo_id", F.col("qualname").alias("_p"), F.col("symbol_id").alias("parent_id"))
    prefix = F.when(F.col("qualname").contains("."), F.regexp_replace("qualname", r"\.[^.]*$", ""))
    return symbols.withColumn("_p", prefix).join(parents, ["repo_id", "_p"], "left").select("repo_id", "symbol_id", "qualname", "parent_id")


def members(symbols: DataFrame) -> DataFrame:
    """(repo_id, parent_qualname, members): names within each container, in order of line and id."""
    rows = F.struct(F.coalesce("line_start", F.lit(1 << 30)).alias("l"), "symbol_id", "name")
    some = symbols.filter(F.col("parent_qualname").isNotNull())
    return some.groupBy("repo_id", "parent_qualname").agg(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["name"]).alias("members"))


def candidate_symbols(symbols: DataFrame, min_lines: int = 3) -> DataFrame:
    """Functions and methods worth a claim: long enough, public, and not in tests."""
    return symbols.filter(
        F.col("kind").isin("function", "method") & (F.col("line_end") - F.col("line_start") + 1 >= min_lines) & ~F.startswith("name", F.lit("_")) & ~is_test_path(F.col("path"))
    )


def chunk_headers(symbols: DataFrame) -> DataFrame:
    """Adds ``header``: the lines of context that open a symbol's chunk."""
    parent = F.when(F.col("qualname").contains("."), F.concat(F.lit("# defined in: "), F.regexp_replace("qualname", r"\.[^.]*$", "")))
    signature = F.when(F.length("signature") > 0, F.concat(F.lit("# signature: "), F.col("signature")))
    first = F.trim(F.split(F.btrim("docstring", F.lit(" \t\r\n")), "\r?\n")[0])
    purpose = F.when(F.length(first) > 0, F.concat(F.lit("# purpose (from docstring): "), F.substring(first, 1, 200)))
    return symbols.withColumn("header", F.concat_ws("\n", F.concat(F.lit("# "), F.col("path"), F.lit(" -- "), F.col("kind"), F.lit(" "), F.col("qualname")), parent, signature, purpose))


def container_chunks(symbols: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, text) of classes and modules: header, docstring and members; empty ones dropped."""
    held = members(symbols).withColumnRenamed("parent_qualname", "qualname")
    some = chunk_headers(symbols.filter(F.col("kind").isin("class", "module"))).join(held, ["repo_id", "qualname"], "left")
    doc = F.when(F.length("docstring") > 0, F.concat(F.lit('"""'), F.btrim("docstring", F.lit(" \t\r\n")), F.lit('"""')))
    label = F.when(F.col("kind") == "class", "# methods: ").otherwise("# defines: ")
    names = F.when(F.size("members") > 0, F.concat(label, F.array_join("members", ", ")))
    body = F.concat_ws("\n", doc, names)
    return some.filter(F.length(body) > 0).select("repo_id", "symbol_id", F.concat_ws("\n", "header", body).alias("text"))


def source_chunks(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, text) of functions and methods: header and verified source, long ones truncated."""
    some = with_bodies(chunk_headers(symbols.filter("kind IN ('function', 'method')")), snapshots)
    part = F.make_valid_utf8(F.col("body").cast("string"))
    body = F.when(F.length(part) > MAX_CHUNK_CHARS, F.concat(F.substring(part, 1, MAX_CHUNK_CHARS), F.lit(TRUNCATED))).otherwise(part)
    rows = some.select("repo_id", "symbol_id", "header", body.alias("body"))
    return rows.filter(F.length("body") > 0).select("repo_id", "symbol_id", F.concat_ws("\n", "header", "body").alias("text"))


def drift(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """(repo_id, path, drift): 'missing', 'changed' (size or mtime) or 'same' against a baseline."""
    b = baseline.select("repo_id", "path", F.col("size_bytes").alias("size0"), F.col("mtime_ns").alias("mtime0"))
    n = now.select("repo_id", "path", "state", "size_bytes", "mtime_ns")
    moved = ~(F.col("size0").eqNullSafe(F.col("size_bytes")) & F.col("mtime0").eqNullSafe(F.col("mtime_ns")))
    kind = F.when(F.col("state").isNull() | (F.col("state") == "absent"), "missing").when(F.col("state") == "unreadable", "same").when(moved, "changed").otherwise("same")
    return b.join(n, ["repo_id", "path"], "left").select("repo_id", "path", kind.alias("drift"))


def checked_spans(spans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Spans (repo_id, span_id, path, byte_start, byte_end, content_hash) with the reason they fail, or 'ok'.

    In this order: file_missing, unreadable, invalid_span, span_truncated, hash_mismatch.  Unreadable
    files withhold a span and never expire it.
    """
    now = current_states(snapshots).select("repo_id", "path", "state", "bytes")
    size = F.octet_length("bytes")
    text = F.substr("bytes", F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start"))
    reason = (
        F.when(F.col("state").isNull() | (F.col("state") == "absent"), "file_missing")
        .when((F.col("state") == "unreadable") | F.col("bytes").isNull(), "unreadable")
        .when(~F.coalesce((F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")), F.lit(False)), "invalid_span")
        .when(size < F.col("byte_end"), "span_truncated")
        .when(F.sha2(text, 256) != F.col("content_hash"), "hash_mismatch")
        .otherwise("ok")
    )
    return spans.join(now, ["repo_id", "path"], "left").select("repo_id", "span_id", "path", reason.alias("reason"))


def admission(submissions: DataFrame, subjects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The refusal code of each submitted span, or null where it is admitted; the first failing rule wins.

    submissions: repo_id, span_id, subject, claim, path, byte_start, byte_end, line_start, line_end, content_hash.
    """
    known = subjects.select("repo_id", F.col("qualname").alias("subject")).distinct().withColumn("known", F.lit(True))
    state = checked_spans(submissions, snapshots).select("span_id", "reason")
    bad_bytes = ~F.coalesce((F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")), F.lit(False))
    bad_lines = ~F.coalesce((F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")), F.lit(False))
    code = (
        F.when(F.coalesce(F.trim("claim"), F.lit("")) == "", "empty_claim")
        .when(bad_bytes | bad_lines, "invalid_span")
        .when(path_escapes(F.col("path")), "span_escapes_repo")
        .when(F.coalesce(F.trim("content_hash"), F.lit("")) == "", "evidence_unverifiable")
        .when(F.col("known").isNull(), "unknown_subject")
        .when(F.col("reason") == "unreadable", "evidence_unverifiable")
        .when(F.col("reason") != "ok", "evidence_stale")
    )
    return submissions.join(known, ["repo_id", "subject"], "left").join(state, "span_id").select("repo_id", "span_id", code.alias("refusal"))


def with_bodies(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Symbol rows with ``body``, their text in the current files, or null.

    The bytes that the byte fields name, or else the lines that the line fields name, without blanks and
    line ends at either end; a module's text is its whole file.  What has another hash is no text; only
    symbols of a table without content_hash are taken at their fields' word.  Rows of files that are not
    present are left out.
    """
    files = current_states(snapshots, present_first=True).filter("state = 'present' AND bytes IS NOT NULL").select("repo_id", "path", F.col("bytes").alias("__file"))
    named = F.when((F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")), F.substr("__file", F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start")))
    text = F.col("__file").cast("string")
    upto = F.call_function("substring_index", text, F.lit("\n"), F.col("line_end")).cast("binary")
    before = F.when(F.col("line_start") > 1, F.octet_length(F.call_function("substring_index", text, F.lit("\n"), F.col("line_start") - 1)) + 1).otherwise(0)
    lines = F.when((F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")), F.btrim(F.substr(upto, before + 1).cast("string"), F.lit(" \t\r\n\f\x0b")).cast("binary"))
    hashed = "content_hash" in symbols.columns
    right = lambda b: F.when(F.sha2(b, 256) == F.lower("content_hash"), b) if hashed else b
    body = F.when(F.col("kind") == "module", right(F.col("__file"))).otherwise(F.coalesce(right(named), right(lines)))
    return symbols.join(files, ["repo_id", "path"]).withColumn("body", body).drop("__file")


def verified_texts(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, body) of the symbols whose text the current files still hold (see ``with_bodies``)."""
    needed = ["repo_id", "symbol_id", "path", "kind", "line_start", "line_end", "byte_start", "byte_end", "content_hash"]
    rows = symbols.select(*[c for c in needed if c in symbols.columns]).distinct()
    return with_bodies(rows, snapshots).filter("body IS NOT NULL").select("repo_id", "symbol_id", "body").distinct()
