"""Turning the prose of changes into labelled queries: units, labels, blinding, overlap, filters with one reject reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.functions.text import content_tokens, identifier_words, is_boilerplate, looks_like_code, mentions, squeezed, text_units, tokens

MIN_WORDS, MIN_BLIND, MAX_RELEVANT = 5, 3, 5


def blind(text, names) -> Column:
    """The tokens of ``text`` that are no tokens of ``names``, in order."""
    hidden = tokens(names)
    return F.filter(tokens(text), lambda t: ~F.array_contains(hidden, t))


def overlap(query, source) -> Column:
    """Share of the query's distinct tokens that the source has; 0 without tokens."""
    q, s = F.array_distinct(tokens(query)), F.array_distinct(tokens(source))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, s)) / F.size(q))


def token_f1(a, b) -> Column:
    """Harmonic mean of precision and recall over distinct tokens."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def copied(text, source, run: int = 32) -> Column:
    """Whether ``run`` characters of the squeezed text stand in the squeezed source."""
    t, s = squeezed(text), squeezed(source)
    starts = F.sequence(F.lit(1), F.greatest(F.length(t) - run + 1, F.lit(1)))
    return F.coalesce((F.length(t) >= run) & (F.length(s) >= run) & F.exists(starts, lambda p: F.contains(s, F.substr(t, p, F.lit(run)))), F.lit(False))


def classified(candidates: DataFrame) -> DataFrame:
    """Adds ``reject`` to (id, query, names): the first filter a candidate fails, or null.

    In this order: too_short, code_like, too_many (column n_relevant, if there is one), name_only,
    copied_into_source (column source, if there is one), and among the survivors duplicate (of the one
    with the least id, by lower-case squeezed text and names).
    """
    words = F.size(F.filter(F.split(squeezed(F.col("query")), " "), lambda w: w != ""))
    shape = F.when(words < MIN_WORDS, "too_short").when(looks_like_code(F.col("query")), "code_like")
    if "n_relevant" in candidates.columns:
        shape = shape.when(F.col("n_relevant") > MAX_RELEVANT, "too_many")
    shape = shape.when(F.size(blind(F.col("query"), F.col("names"))) < MIN_BLIND, "name_only")
    if "source" in candidates.columns:
        shape = shape.when(copied(F.col("query"), F.col("source")), "copied_into_source")
    shaped = candidates.withColumn("reject", shape)
    same = W.partitionBy(F.lower(squeezed(F.col("query"))), "names", "reject").orderBy("id")
    n = F.row_number().over(same)
    return shaped.withColumn("reject", F.when(F.col("reject").isNull() & (n > 1), "duplicate").otherwise(F.col("reject")))


def suspect_tokens(output, label, given) -> Column:
    """Long tokens (six characters and more) that output and label share and the input lacks, in order."""
    out = F.array_except(F.array_intersect(content_tokens(output), content_tokens(label)), content_tokens(given))
    return F.array_sort(F.filter(out, lambda t: F.length(t) >= 6))


def commit_files(commits: DataFrame, text_col: str = "text") -> DataFrame:
    """(commit_id, path): the Python files that a change's message names."""
    return commits.select("commit_id", F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"[A-Za-z0-9_/]+\.py"), F.lit(0)))).alias("path"))


def eligibility(commits: DataFrame, files: DataFrame, live: DataFrame, symbols: DataFrame) -> DataFrame:
    """(commit_id, skip): why a change (commit_id, subject, prose) is not mined, or null.

    In this order: no_prose, boilerplate, no_live_file (files: commit_id, path; live: path, without tests),
    no_symbols (symbols: path).
    """
    touched = files.join(live.select("path").distinct(), "path", "left_semi")
    n_live = touched.groupBy("commit_id").agg(F.count("*").alias("n_live"))
    n_pool = touched.join(symbols.select("path").distinct(), "path", "left_semi").groupBy("commit_id").agg(F.count("*").alias("n_pool"))
    rows = commits.join(n_live, "commit_id", "left").join(n_pool, "commit_id", "left")
    skip = (
        F.when(F.coalesce(F.length("prose"), F.lit(0)) == 0, "no_prose")
        .when(is_boilerplate(F.col("subject")), "boilerplate")
        .when(F.col("n_live").isNull(), "no_live_file")
        .when(F.col("n_pool").isNull(), "no_symbols")
    )
    return rows.select("commit_id", skip.alias("skip"))


def mined_labels(commits: DataFrame, files: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """(commit_id, symbol_id, label, n_units): what a change (commit_id, prose) says of each symbol of its files.

    symbols: symbol_id, path, name.  The label joins the first ``most`` units that name the symbol.
    """
    units = commits.select("commit_id", F.posexplode(text_units(F.col("prose"))).alias("n", "unit"))
    named = files.join(symbols.select("symbol_id", "path", "name").distinct(), "path").select("commit_id", "symbol_id", "name").distinct()
    hit = units.join(named, "commit_id").filter(mentions(F.col("unit"), F.col("name")))
    g = hit.groupBy("commit_id", "symbol_id").agg(F.array_sort(F.collect_list(F.struct("n", "unit"))).alias("u"))
    return g.select("commit_id", "symbol_id", F.array_join(F.transform(F.slice("u", 1, most), lambda x: x["unit"]), " ").alias("label"), F.size("u").alias("n_units"))


def name_purpose(name, signature) -> Column:
    """The words of a symbol's name and parameters: the least that any description must beat."""
    inside = F.regexp_extract(F.coalesce(signature, F.lit("")), r"\(([^)]*)\)", 1)
    parts = F.transform(F.split(inside, ","), lambda p: F.split(F.split(p, ":")[0], "=")[0])
    return F.array_join(F.concat(identifier_words(name), F.flatten(F.transform(parts, identifier_words))), " ")


def docstring_purpose(docstring, name, signature) -> Column:
    """The docstring's first sentence, or else the words of name and parameters."""
    first = F.split(squeezed(docstring), r"(?<=[.!?])\s+(?=[A-Z`\"'(—-])")[0]
    return F.when(F.length(first) > 0, first).otherwise(name_purpose(name, signature))


def body_purpose(source) -> Column:
    """The distinct content words of a source, in order."""
    return F.array_join(F.array_distinct(content_tokens(source)), " ")


def unambiguous(blinded: DataFrame) -> DataFrame:
    """Of (id, text, relevant) rows: one text with several relevants goes, repeated rows keep the first."""
    all_rel = W.partitionBy("text")
    first = W.partitionBy("text", "relevant").orderBy("id")
    low, high = F.min("relevant").over(all_rel), F.max("relevant").over(all_rel)
    return blinded.withColumn("one", low == high).withColumn("n", F.row_number().over(first)).filter("one AND n = 1").drop("one", "n")
