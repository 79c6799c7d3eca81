"""Fusion of ranked lists whose candidates are source symbols or claims."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from tessella.plans.scratch import Scratch

# Weight of each list, and provenance tier of each kind of candidate.
LIST_WEIGHTS = {"source_lexical": 1.0, "source_dense": 1.0, "source_graph": 0.3, "assertion_lexical": 1.0, "assertion_subject": 0.5, "source_assertions": 0.5}
RRF_K = 60


def mixed_fusion(votes: DataFrame, k: int = 10, max_tier: int = 2) -> DataFrame:
    """(query_id, candidate_type, id, score, tier, lists, rank) of (query_id, list, rank, candidate_type, id, tier).

    Within a list a candidate votes once, at its first rank.  Candidates above ``max_tier`` leave
    before the cut, so that others take their places.  Ties: sources before claims, then the lesser id.
    """
    once = votes.groupBy("query_id", "list", "candidate_type", "id").agg(F.min("rank").alias("rank"), F.min("tier").alias("tier"))
    w = F.lit(1.0)
    for name, x in LIST_WEIGHTS.items():
        w = F.when(F.col("list") == name, x).otherwise(w)
    g = once.groupBy("query_id", "candidate_type", "id").agg(
        F.round(F.sum(w / (RRF_K + F.col("rank"))), 9).alias("score"), F.min("tier").alias("tier"), F.array_join(F.array_sort(F.collect_set("list")), "+").alias("lists")
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), (F.col("candidate_type") != "source").cast("int"), "id")
    return g.filter(F.col("tier") <= max_tier).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def contributions(votes: DataFrame) -> DataFrame:
    """(query_id, candidate_type, id, list, rank, weight, value): what each list gives each candidate."""
    once = votes.groupBy("query_id", "list", "candidate_type", "id").agg(F.min("rank").alias("rank"))
    w = F.lit(1.0)
    for name, x in LIST_WEIGHTS.items():
        w = F.when(F.col("list") == name, x).otherwise(w)
    return once.select("query_id", "candidate_type", "id", "list", "rank", w.alias("weight"), F.round(w / (RRF_K + F.col("rank")), 9).alias("value"))


def conflicting(votes: DataFrame, claims: DataFrame, max_tier: int = 2) -> DataFrame:
    """(query_id, id): claims among a query's candidates that another one of the same subject and kind contradicts.

    claims: assertion_id, subject, kind, claim.  Texts count as the same after case folding and squeezing
    of blanks, by Unicode's compatibility form.  Candidates above ``max_tier`` do not count; the later cut does.
    """
    some = votes.filter((F.col("candidate_type") == "assertion") & (F.col("tier") <= max_tier)).select("query_id", "id").distinct()
    text = claims.select(F.col("assertion_id").alias("id"), "subject", "kind", folded_text(F.col("claim")).alias("said")).distinct()
    group = W.partitionBy("query_id", "subject", "kind")
    low, high = F.min("said").over(group), F.max("said").over(group)
    return some.join(text, "id").withColumn("differ", low != high).filter("differ").select("query_id", "id").distinct()


@F.pandas_udf(StringType())
def _nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()), na_action="ignore")


def folded_text(c) -> F.Column:
    """NFKC, case-folded and blank-squeezed text; ASCII texts stay in the JVM."""
    plain = F.lower(c)
    other = _nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c))
    return F.trim(F.regexp_replace(F.coalesce(other, plain), r"\s+", " "))


def mixed_search(pool: DataFrame, claim_hits: DataFrame, claims: DataFrame, symbols: DataFrame, k: int = 10, max_tier: int = 2) -> DataFrame:
    """The first ``k`` sources and claims per query: (query_id, candidate_type, id, score, tier, lists, rank).

    pool: query_id, id, score, modality, rank, the fused sources, deeper than ``k``; claim_hits: query_id, assertion_id,
    rank; claims: assertion_id, subject of active claims; symbols: id, qualname.  Lists: each modality's
    members in the pool's order, claims found by text, claims on the pool's subjects, and the subjects of
    claims found by text.  A query for which no list of claims has a row keeps its sources as they are.
    """
    from tessella.functions.text import tier_of
    from tessella.operators.retrieval import pool_order

    scratch = Scratch(pool.sparkSession)
    pool, claim_hits = scratch.cut(pool), scratch.cut(claim_hits)  # small, and read several times
    names = symbols.select("id", F.col("qualname").alias("subject"))
    members = pool.select("query_id", F.explode(F.split("modality", r"\+")).alias("modality"), "id")
    tiers = pool.select("query_id", "id", tier_of(F.col("modality")).alias("tier"))
    sources = pool_order(members, pool).join(tiers, ["query_id", "id"]).select("query_id", F.concat(F.lit("source_"), "modality").alias("list"), "rank", F.lit("source").alias("candidate_type"), "id", "tier")
    vote = lambda df, name, kind, tier: df.select("query_id", F.lit(name).alias("list"), "rank", F.lit(kind).alias("candidate_type"), "id", F.lit(tier).alias("tier"))
    attached = attached_claims(pool.join(names, "id").groupBy("query_id", "subject").agg(F.min("rank").alias("rank")), claims)
    promoted = promoted_sources(claim_hits.join(claims, "assertion_id").select("query_id", "rank", "assertion_id", "subject"))
    promoted = promoted.join(names.groupBy("subject").agg(F.min("id").alias("id")), "subject")
    of_claims = vote(claim_hits.withColumnRenamed("assertion_id", "id"), "assertion_lexical", "assertion", 2)
    of_claims = of_claims.unionByName(vote(attached.withColumnRenamed("assertion_id", "id"), "assertion_subject", "assertion", 2)).unionByName(vote(promoted, "source_assertions", "source", 2))
    of_claims = scratch.cut(of_claims)
    some = of_claims.select("query_id").distinct()
    fused = mixed_fusion(sources.join(some, "query_id", "left_semi").unionByName(of_claims), k, max_tier)
    same = pool.filter(F.col("rank") <= k).join(some, "query_id", "left_anti")
    same = same.select("query_id", F.lit("source").alias("candidate_type"), "id", F.col("score"), tier_of(F.col("modality")).alias("tier"), F.col("modality").alias("lists"), "rank")
    return fused.unionByName(same.filter(F.col("tier") <= max_tier))


def candidate_json(candidates: DataFrame) -> DataFrame:
    """(query_id, rank, json): a candidate as compact JSON, its score with six decimals and its tier by name."""
    label = F.when(F.col("tier") == 0, "parsed").when(F.col("tier") == 1, "resolved").otherwise("inferred")
    body = F.to_json(F.struct(F.concat_ws(":", "candidate_type", "id").alias("key"), F.format_string("%.6f", "score").alias("score"), label.alias("tier"), F.col("lists").alias("via")))
    return candidates.select("query_id", "rank", body.alias("json"))


def promoted_sources(claims: DataFrame) -> DataFrame:
    """(query_id, subject, rank, via): subjects of ranked claims (query_id, rank, assertion_id, subject), first occurrence each."""
    first = claims.filter(F.col("subject").isNotNull()).groupBy("query_id", "subject").agg(F.min(F.struct("rank", "assertion_id")).alias("f"))
    order = W.partitionBy("query_id").orderBy("f")
    return first.select("query_id", "subject", F.row_number().over(order).alias("rank"), F.concat(F.lit("assertion:"), F.col("f.assertion_id")).alias("via"))


def attached_claims(pool: DataFrame, claims: DataFrame, cap: int | None = None) -> DataFrame:
    """(query_id, assertion_id, rank): active claims on pooled subjects (query_id, rank, subject), by pool rank, then id.

    ``cap`` is a query's most claims, over all its subjects.
    """
    hit = pool.withColumnRenamed("rank", "r").join(claims.select("assertion_id", "subject").distinct(), "subject")
    order = W.partitionBy("query_id").orderBy("r", "assertion_id")
    out = hit.select("query_id", "assertion_id", F.row_number().over(order).alias("rank"))
    return out if cap is None else out.filter(F.col("rank") <= cap)
