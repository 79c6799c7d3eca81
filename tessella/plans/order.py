"""Positions in a global order without ordering all rows in one task.

Rows are range-partitioned by the key; sizes of the parts, a small table, give each part's offset, and
rows are counted within their part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.plans.scratch import Scratch


def in_parts(df: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``df`` written in ranges of ``keys``, with ``__part``, the number of a row's range, in order of the keys."""
    return scratch.cut(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``, the row's place from 0 in the order of ``keys``, which must be unique for a stable result."""
    parts = in_parts(df, keys, Scratch(df.sparkSession))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per part
    place = F.row_number().over(W.partitionBy("__part").orderBy(*keys)) - 1 + F.col("__before")
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, place.cast("long")).drop("__part", "__before")


def at_ranks(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(group, tag, value): the value at place ``at`` (from 0) of its group; values: group, value; wanted: group, tag, at.

    Equal values are counted together first; only ranges that hold a wanted place are put in order.
    """
    counts = values.filter(F.col("value").isNotNull()).groupBy("group", "value").agg(F.count("*").alias("c"))
    parts = in_parts(counts, ["group", "value"], Scratch(values.sparkSession))
    sizes = parts.groupBy("group", "__part").agg(F.sum("c").alias("t"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("group").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before)  # a row per part and group
    asked = wanted.join(offsets, "group").filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("t")))
    run = F.sum("c").over(W.partitionBy("group", "__part").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    rows = parts.join(asked.select("group", "__part").distinct(), ["group", "__part"], "left_semi").withColumn("run", run)
    hit = rows.join(asked.select("group", "__part", "tag", "at", "before"), ["group", "__part"])
    return hit.filter((F.col("before") + F.col("run") > F.col("at")) & (F.col("before") + F.col("run") - F.col("c") <= F.col("at"))).select("group", "tag", "value")


def running(df: DataFrame, groups: list[str], keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds running sums within groups in the order of ``keys``: new name -> column summed up to and with the row."""
    parts = in_parts(df, [*groups, *keys], Scratch(df.sparkSession))
    totals = parts.groupBy(*groups, "__part").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    earlier = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row per part and group
    offsets = totals.select(*groups, "__part", *(F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums))
    here = W.partitionBy(*groups, "__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    rows = parts.join(offsets, [*groups, "__part"])
    return rows.select(*df.columns, *((F.col(f"__b_{n}") + F.sum(c).over(here)).alias(n) for n, c in sums.items()))
