"""Streaming forms of folds over logs (an extension: batch semantics are the measure)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tessella.plans.scratch import Scratch


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per event type and tumbling window of (ts, event_type, value); rows later than ``late`` are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def first_terminal(transitions: DataFrame) -> DataFrame:
    """(key, status, ts) of (key, ts, seq, status): the first transition wins, later ones change nothing."""
    return transitions.groupBy("key").agg(F.min_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("t")).select("key", "t.status", "t.ts")


def run_to_end(stream: DataFrame) -> DataFrame:
    """Run a streaming aggregation over all that is there now, and read its last complete result."""
    spark = stream.sparkSession
    scratch = Scratch(spark)
    seen: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        seen.append(scratch.cut(batch))

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{scratch.root}/q-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return seen[-1] if seen else spark.createDataFrame([], stream.schema)
