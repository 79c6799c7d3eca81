"""Claims that models draft and judge: menus of evidence, drafts, answers and the rounds around them.

Models are seams: a callable from a list of prompts to a list of answers, called in batches where the
data is.  Whatever does not parse fails closed, with a cause.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.text import model_family
from tessella.operators.claims import LABELS, word
from tessella.plans.scratch import Scratch
from tessella.plans.ship import ship

# Places on a menu and the largest neighbour on it.
MENU, NEIGHBOUR_BYTES = 12, 4_000
NOT_JUDGED, JUDGED, NO_EVIDENCE = ("parse_failure", "format_failure"), "judged", "no_evidence"


def cleaned(answer) -> Column:
    """An answer without thoughts and fence lines."""
    s = F.regexp_replace(answer, r"(?is)<think>.*?(</think>|\z)", " ")
    return F.btrim(F.regexp_replace(s, r"(?m)^[ \t]*```[^\n]*$", ""), F.lit(" \t\r\n"))


def _field(answer, name: str) -> Column:
    """A text field of the JSON object in an answer: of the whole, of what braces enclose, or picked out alone."""
    c = cleaned(answer)
    inside = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    alone = F.regexp_extract(c, rf'(?i)"{name}"\s*:\s*"([^"]*)"', 1)
    return F.coalesce(F.get_json_object(c, f"$.{name}"), F.get_json_object(F.nullif(inside, F.lit("")), f"$.{name}"), F.nullif(alone, F.lit("")))


def parsed_verdict(answer) -> Column:
    """struct(label, verdict, cause) of a judge's answer; without a known label the verdict is null.

    parse_failure: no label can be read; format_failure: a label that is none of the known ones.
    """
    label = word(_field(answer, "label"))
    verdict = F.lit(None).cast("string")
    for said, means in LABELS.items():
        verdict = F.when(label == said, means).otherwise(verdict)
    cause = F.when(label.isNull(), "parse_failure").when(verdict.isNull(), "format_failure").otherwise(JUDGED)
    return F.struct(label.alias("label"), verdict.alias("verdict"), cause.alias("cause"))


def parsed_draft(answer) -> Column:
    """struct(claim, refs) of a generator's answer: references are whole numbers, alone or listed, bare or quoted.

    true and false are none; without a claim both are empty.
    """
    claim = F.btrim(_field(answer, "claim"), F.lit(" \t\r\n"))
    c = cleaned(answer)
    refs = F.coalesce(F.get_json_object(c, "$.refs"), F.get_json_object(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), "$.refs"))
    numbers = F.transform(F.regexp_extract_all(refs, F.lit(r'(?:^|[\[,])\s*"?([0-9]{1,9})"?\s*(?=[,\]]|$)'), F.lit(1)), lambda x: x.cast("int"))
    some = F.length(claim) > 0
    return F.struct(F.when(some, claim).alias("claim"), F.when(some, F.coalesce(numbers, F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("refs"))


def asked(rows: DataFrame, prompt_col: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``rows`` with ``answer``; the model sees the prompts of a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(answer=list(model(b[prompt_col].to_list())))

    ship(rows.sparkSession)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


def adjudicated(claims: DataFrame, judge: Callable[[list[str]], list[str]], name: str) -> DataFrame:
    """(assertion_id, judge, verdict, cause) of (assertion_id, claim, evidence): claims without evidence are refuted unasked."""
    some = claims.filter(F.length("evidence") > 0).select("assertion_id", F.concat(F.lit("Claim: "), "claim", F.lit("\n\nEvidence:\n"), "evidence").alias("prompt"))
    v = asked(some, "prompt", judge).select("assertion_id", parsed_verdict(F.col("answer")).alias("v")).select("assertion_id", F.lit(name).alias("judge"), "v.verdict", "v.cause")
    bare = claims.filter(F.coalesce(F.length("evidence"), F.lit(0)) == 0).select("assertion_id", F.lit(name).alias("judge"), F.lit(LABELS["not_supported"]).alias("verdict"), F.lit(NO_EVIDENCE).alias("cause"))
    return v.unionByName(bare)


def judge_round(claims: DataFrame, judge: str) -> DataFrame:
    """Adds ``skipped`` to (assertion_id, generator): claims of a generator of the judge's own family are left out."""
    own = F.coalesce(model_family(F.col("generator")) == model_family(F.lit(judge)), F.lit(False))
    return claims.withColumn("skipped", own)


def menus(subjects: DataFrame, edges: DataFrame, sources: DataFrame, places: int = MENU) -> DataFrame:
    """(subject, ref, id, part) of (subject) and edges (src, dst); sources: id, qualname, size of verified text.

    A menu opens with the subject.  Callees get half of what is left, rounded up, or all if there are no
    callers; then come callers, and further callees where callers leave room.  Neighbours are at most 4,000
    bytes, in order of name; who calls and is called counts as callee.  A subject without source has no menu.
    """
    n = places - 1
    known = sources.select("id", "qualname", "size")
    base = subjects.select("subject").distinct().join(known.select(F.col("id").alias("subject")), "subject", "left_semi")
    out = edges.select(F.col("src").alias("subject"), F.col("dst").alias("id"), F.lit(0).alias("side"))
    into = edges.select(F.col("dst").alias("subject"), F.col("src").alias("id"), F.lit(1).alias("side"))
    near = out.unionByName(into).filter("subject <> id").groupBy("subject", "id").agg(F.min("side").alias("side"))
    near = near.join(base, "subject", "left_semi").join(known.filter(F.col("size") <= NEIGHBOUR_BYTES), "id")
    side = W.partitionBy("subject", "side").orderBy("qualname", "id")
    near = near.withColumn("r", F.row_number().over(side)).withColumn("nc", F.count(F.when(F.col("side") == 0, 1)).over(W.partitionBy("subject"))).withColumn("nk", F.count(F.when(F.col("side") == 1, 1)).over(W.partitionBy("subject")))
    first = F.least(F.col("nc"), F.when(F.col("nk") == 0, n).otherwise((n + 1) // 2))
    near = near.withColumn("first", first).withColumn("callers", F.least(F.col("nk"), n - F.col("first")))
    late = (F.col("side") == 0) & (F.col("r") > F.col("first"))
    kept = near.filter(((F.col("side") == 0) & (F.col("r") <= n - F.col("callers"))) | ((F.col("side") == 1) & (F.col("r") <= F.col("callers"))))
    part = F.when(F.col("side") == 1, 2).when(late, 3).otherwise(1)
    rows = kept.select("subject", "id", part.alias("part"), "r").unionByName(base.select("subject", F.col("subject").alias("id"), F.lit(0).alias("part"), F.lit(1).alias("r")))
    return rows.withColumn("ref", F.row_number().over(W.partitionBy("subject").orderBy("part", "r"))).select("subject", "ref", "id", F.element_at(F.array(*map(F.lit, ("subject", "callee", "caller", "callee"))), F.col("part") + 1).alias("part"))


def resolved_drafts(drafts: DataFrame, menu: DataFrame) -> DataFrame:
    """(draft_id, ids, off_menu) of (draft_id, subject, refs): the spans a draft names, each once, and references to nothing."""
    each = drafts.select("draft_id", "subject", F.explode_outer(F.array_distinct("refs")).alias("ref"))
    hit = each.join(menu.select("subject", "ref", "id"), ["subject", "ref"], "left")
    g = hit.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("ref", "id")))).alias("h"), F.array_sort(F.collect_list(F.when(F.col("id").isNull(), F.col("ref")))).alias("off_menu"))
    return g.select("draft_id", F.array_distinct(F.transform("h", lambda x: x["id"])).alias("ids"), "off_menu")


def unlearned(subjects: DataFrame, claims: DataFrame, generator: str) -> DataFrame:
    """Subjects (repo_id, symbol_id, qualname) without an active claim of this generator."""
    done = claims.filter((F.col("status") == "active") & (F.col("generator") == generator)).select(F.col("subject_qualname").alias("qualname"))
    return subjects.join(done, "qualname", "left_anti")


def learned(subjects: DataFrame, menu: DataFrame, texts: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """(subject, claim, ids, outcome): what a generator drafts from each menu; texts: id, text.

    outcome: no_offers, no_claim, off_menu (any reference to nothing), no_evidence (no reference), or drafted.
    An error of the generator ends the round; nothing of it is kept.
    """
    scratch = Scratch(menu.sparkSession)
    menu, texts = scratch.cut(menu), scratch.cut(texts)  # read several times
    shown = menu.join(texts, "id").groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", "text"))), lambda x: F.concat(F.lit("["), x["ref"].cast("string"), F.lit("]\n"), x["text"])), "\n\n").alias("prompt"))
    a = asked(shown, "prompt", generate).select("subject", parsed_draft(F.col("answer")).alias("d")).select("subject", "d.claim", "d.refs")
    a = scratch.cut(a)  # a model is asked once
    r = resolved_drafts(a.select(F.col("subject").alias("draft_id"), "subject", "refs"), menu).withColumnRenamed("draft_id", "subject")
    rows = subjects.select("subject").distinct().join(a.join(r, "subject", "left"), "subject", "left")
    outcome = (
        F.when(F.col("refs").isNull(), "no_offers").when(F.col("claim").isNull(), "no_claim").when(F.size("off_menu") > 0, "off_menu").when(F.coalesce(F.size("ids"), F.lit(0)) <= 0, "no_evidence").otherwise("drafted")
    )
    return rows.select("subject", "claim", "ids", outcome.alias("outcome"))
