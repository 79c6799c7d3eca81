"""Queries of the training-data operators: ``QUERIES`` and the SQL that DuckDB can check, ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def p4_found(spark, d):
    from tessella.llm.threads import rebuild_conversations

    return rebuild_conversations(table(spark, d, "messages"))[0].selectExpr("session_id", "cast(turn as int) turn", "uuid")


@query
def p4_sessions(spark, d):
    from tessella.llm.threads import rebuild_conversations

    return rebuild_conversations(table(spark, d, "messages"))[1]


@query
def p3_found(spark, d):
    from tessella.llm.docpairs import documented_functions

    return documented_functions(table(spark, d, "snapshots")).select("repo_id", "path", "qualname", "def_line")


@query
def p3_pairs(spark, d):
    from tessella.llm.docpairs import documented_functions

    return documented_functions(table(spark, d, "snapshots"))


@query
def p6_ids(spark, d):
    from tessella.llm.bpe import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


@query
def p7_found(spark, d):
    from tessella.llm.mixing import FairQueue

    return FairQueue(table(spark, d, "documents"), table(spark, d, "mix_targets")).short_sources()


@query
def p7_mix(spark, d):
    from tessella.llm.mixing import fair_mix

    return fair_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query
def p7_shares(spark, d):
    from tessella.llm.mixing import fair_mix, mix_shares

    return mix_shares(*fair_mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


@query
def p8_found(spark, d):
    from tessella.llm.truncation import truncated

    return truncated(table(spark, d, "documents")).select("doc_id")


@query
def p8_rates(spark, d):
    from tessella.llm.truncation import truncation_rates

    return truncation_rates(table(spark, d, "documents"))


def _oversized(spark, d):
    from tessella.llm.pieces import Oversized

    return Oversized(table(spark, d, "symbols"), table(spark, d, "snapshots"), table(spark, d, "piece_limits"))


@query
def p5_found(spark, d):
    """Symbols that are cut into more than one piece."""
    return _oversized(spark, d).pieces().filter("piece = 2").select("symbol_id")


@query
def p5_pieces(spark, d):
    return _oversized(spark, d).pieces()


def _consensus(spark, d):
    from tessella.llm.consensus import Consensus

    return Consensus(table(spark, d, "verdicts"), table(spark, d, "adjudications"), table(spark, d, "assertions"))


@query
def p2_found(spark, d):
    from tessella.llm.consensus import MIN_JUDGES

    return _consensus(spark, d).verdicts().filter(f"n_judges >= {MIN_JUDGES}").select("assertion_id", "verdict")


@query
def p2_items(spark, d):
    return _consensus(spark, d).verdicts()


@query
def p2_judges(spark, d):
    return _consensus(spark, d).reliability()


@query
def p2_agreement(spark, d):
    return _consensus(spark, d).alpha()
