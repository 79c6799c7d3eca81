"""Strict readers of gold queries, run records and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.plans.merge import write_json_atomically

GOLD = "queries array<struct<query_id string, query string, relevant array<string>, source string, repo string, notes string>>"
RUN = "run_id string, task_id string, arm string, repo string, rep int, ok boolean, n_tool_calls int, total_tokens long, total_cost_usd double, wall_s double, tool_call_counts map<string,int>"


def read_gold(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(query_id, query, relevant, source, repo, notes) of JSON gold files; any fault raises, none is skipped."""
    files = spark.read.schema(GOLD).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    rows = files.select(F.explode("queries").alias("q")).select("q.*")
    bad = rows.filter(F.coalesce(F.trim("query_id"), F.lit("")) == "").limit(1).count()
    empty = rows.filter(F.size("relevant") <= 0).limit(1).count()
    doubled = rows.filter(F.size("relevant") != F.size(F.array_distinct("relevant"))).limit(1).count()
    twice = rows.groupBy("query_id").count().filter("count > 1").limit(1).count()
    for fault, name in ((bad, "a query without id"), (empty, "a query without relevant names"), (doubled, "a name listed twice"), (twice, "an id used twice")):
        if fault:
            raise ValueError(f"gold files hold {name}")
    return rows


def read_runs(spark: SparkSession, path: str, include_void: bool = False) -> DataFrame:
    """Run records, one JSON object per file; runs that were not ok only on demand."""
    runs = spark.read.schema(RUN).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return runs if include_void else runs.filter("ok")


def fold_transcript(lines: DataFrame) -> DataFrame:
    """Per run of (run_id, value) stream-JSON lines: messages, tool calls and tokens."""
    m = F.from_json("value", "type string, message struct<content array<struct<type string, name string>>, usage struct<input_tokens long, output_tokens long>>")
    rows = lines.select("run_id", m.alias("m"))
    tools = F.size(F.filter(F.coalesce("m.message.content", F.array()), lambda c: c["type"] == "tool_use"))
    return rows.groupBy("run_id").agg(
        F.count(F.when(F.col("m.type") == "assistant", 1)).alias("answers"), F.sum(F.greatest(tools, F.lit(0))).alias("tool_calls"),
        F.sum(F.coalesce("m.message.usage.input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("m.message.usage.output_tokens", F.lit(0))).alias("output_tokens"),
    )


def write_gold(gold: DataFrame, path: str) -> None:
    """A gold file that ``read_gold`` takes; a query set is small by its nature (one file)."""
    names = ["query_id", "query", "relevant", "source", "repo", "notes"]
    rows = [r.asDict() for r in gold.select(*names).orderBy("query_id").toLocalIterator()]
    write_json_atomically(path, {"queries": rows})


def review_sample(judged: DataFrame, n: int, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): a blind sample for a human and the labels it is scored against.

    judged: assertion_id, subject, claim, citations, evidence, label.  The sheet has no label; the sample
    goes round the labels, so that rare ones are in it.
    """
    from tessella.operators.evaluation import stratified_sample

    chosen = stratified_sample(judged.select(F.col("assertion_id").alias("id"), F.col("label").alias("stratum")), n, seed).select(F.col("id").alias("assertion_id"))
    rows = judged.join(chosen, "assertion_id", "left_semi").dropDuplicates(["assertion_id"])
    sheet = rows.select("assertion_id", "subject", "claim", "citations", "evidence", F.lit("").alias("human"))
    return sheet, rows.select("assertion_id", "label")


def review_scores(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """(n, unanswered, agreement, precision, recall, kappa) of a filled sheet against its key."""
    from tessella.operators.claims import word
    from tessella.operators.evaluation import calibration, judge_pairs

    filled = sheet.select("assertion_id", word("human").alias("human")).join(key, "assertion_id")
    answers = filled.filter("human IS NOT NULL").select(F.col("assertion_id").alias("item"), F.explode(F.array(F.struct(F.lit("a_human").alias("judge"), F.col("human").alias("label")), F.struct(F.lit("b_judge").alias("judge"), word("label").alias("label")))).alias("x")).select("item", "x.*")
    c = calibration(judge_pairs(answers)).select("n", "agreement", "precision", "recall", "kappa")
    return filled.agg(F.count(F.when(F.col("human").isNull(), 1)).alias("unanswered")).join(c, F.lit(True), "left").select("n", "unanswered", "agreement", "precision", "recall", "kappa")
