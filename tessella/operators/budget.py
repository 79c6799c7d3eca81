"""Greedy choice in rank order under a byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def take_within(items: DataFrame, budget: int) -> DataFrame:
    """(group, id, taken) of (group, rank, id, size): an item is taken if it fits into what is left.

    Unlike a running sum, an item that does not fit is passed over and later, smaller ones may fit.
    The choice depends on all before it, so a group's items are folded in order inside one row;
    groups are result lists of one query, whose length the caller bounds.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "size")))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<id:bigint,taken:boolean>>").alias("out"))

    def step(acc, r):
        fits = r["size"] <= acc["left"]
        left = F.when(fits, acc["left"] - r["size"]).otherwise(acc["left"])
        return F.struct(left.cast("long").alias("left"), F.concat(acc["out"], F.array(F.struct(r["id"].cast("long").alias("id"), fits.alias("taken")))).alias("out"))

    folded = items.groupBy("group").agg(F.aggregate(rows, start, step, lambda a: a["out"]).alias("out"))
    return folded.select("group", F.inline("out"))
