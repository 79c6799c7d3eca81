"""Reading paths through a code graph: seeds, selection, order and the reason of each stop.

nodes: id, qualname, module, centrality; edges: src, dst (with confidence and edge_id for spreading).
Every table is keyed by query_id, so many paths are one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.operators import graph, retrieval
from tessella.plans.scratch import Scratch

# Seeds by centrality, and stops of a path.
CENTRAL_SEEDS, STOPS = 4, 12


def centrality_ranks(nodes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Adds ``centrality_rank``: the place by falling centrality, then name, within a group (a path, a repository)."""
    order = W.partitionBy(*(group or [])).orderBy(F.col("centrality").desc(), "qualname", "id")
    return nodes.withColumn("centrality_rank", F.row_number().over(order))


def seeds(hits: DataFrame, queries: DataFrame, nodes: DataFrame, most: int = STOPS) -> DataFrame:
    """(query_id, id, place): search hits (query_id, id, rank) that are nodes, or else the most central nodes."""
    order = W.partitionBy("query_id").orderBy("rank", "id")
    found = hits.join(nodes.select("id"), "id", "left_semi").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("query_id", "id", "place")
    top = nodes.orderBy(F.col("centrality").desc(), "id").limit(CENTRAL_SEEDS)
    top = top.select("id", F.row_number().over(W.orderBy(F.col("centrality").desc(), "id")).alias("place"))  # CENTRAL_SEEDS rows
    bare = queries.select("query_id").distinct().join(found.select("query_id"), "query_id", "left_anti")
    return found.unionByName(bare.crossJoin(top).select("query_id", "id", "place"))


def selection(chosen: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = STOPS) -> DataFrame:
    """(query_id, id, place): the seeds, then what spreads from them by score, centrality and name, up to ``limit``."""
    scratch = Scratch(chosen.sparkSession)
    chosen, edges = scratch.cut(chosen), scratch.cut(edges)  # read in every hop
    spread = retrieval.expand(edges, chosen, 4 * limit).select("query_id", "id", "score").join(nodes.select("id", "qualname", "centrality"), "id")
    rows = chosen.select("query_id", "id", F.lit(0).alias("late"), "place", F.lit(0.0).alias("score"), F.lit(0.0).alias("centrality"), F.lit("").alias("qualname"))
    rows = rows.unionByName(spread.select("query_id", "id", F.lit(1).alias("late"), F.lit(0).alias("place"), "score", "centrality", "qualname"))
    order = W.partitionBy("query_id").orderBy("late", "place", F.col("score").desc(), F.col("centrality").desc(), "qualname", "id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select("query_id", "id", F.col("n").alias("place"))


def induced(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, src, dst): the edges between a path's own nodes."""
    e = selected.select("query_id", F.col("id").alias("src")).join(edges.select("src", "dst").distinct(), "src")
    return e.join(selected.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"]).filter("src <> dst").select("query_id", "src", "dst")


def ordered(selected: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, stop, tier, component): callees before callers.

    Symbols that call each other are one group.  Groups go by depth, then by the most central group of
    their module at that depth, module, centrality and name; members by centrality and name.
    """
    scratch = Scratch(selected.sparkSession)
    selected = scratch.cut(selected)
    inner = scratch.cut(induced(selected, edges))
    key = lambda c: F.concat_ws(":", "query_id", c)
    paths = inner.select(key("src").alias("src"), key("dst").alias("dst"))
    comp = graph.strong_components(paths)
    deep = graph.depths(paths, comp)
    rows = selected.select("query_id", "id", key("id").alias("k")).join(comp.withColumnRenamed("id", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    rows = rows.join(deep, "component", "left").withColumn("tier", F.coalesce("depth", F.lit(0))).join(nodes.select("id", "qualname", "module", "centrality"), "id")
    rows = scratch.cut(rows)
    lead = rows.groupBy("query_id", "component", "tier").agg(F.min(F.struct(-F.col("centrality"), "qualname", "module")).alias("best"))
    lead = lead.select("query_id", "component", (-F.col("best.col1")).alias("top"), F.col("best.module").alias("home"), F.col("best.qualname").alias("lead"), "tier")
    lead = lead.withColumn("module_top", F.max("top").over(W.partitionBy("query_id", "tier", "home"))).drop("tier")
    order = W.partitionBy("query_id").orderBy("tier", F.col("module_top").desc(), "home", F.col("top").desc(), "lead", F.col("centrality").desc(), "qualname", "id")
    return rows.join(lead, ["query_id", "component"]).select("query_id", "id", F.row_number().over(order).alias("stop"), "tier", "component")


def reasons(stops: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, reason): why a stop stands where it does, in facts that a reader can check."""
    inner = induced(stops, edges)
    where = stops.select("query_id", "id", "component")
    linked = inner.join(where.select("query_id", F.col("id").alias("src"), F.col("component").alias("a")), ["query_id", "src"]).join(where.select("query_id", F.col("id").alias("dst"), F.col("component").alias("b")), ["query_id", "dst"])
    down = linked.filter("a <> b").groupBy("query_id", F.col("src").alias("id")).agg(F.count("*").alias("calls"))
    up = linked.filter("a <> b").groupBy("query_id", F.col("dst").alias("id")).agg(F.count("*").alias("called"))
    size = stops.groupBy("query_id", "component").agg(F.count("*").alias("members"))
    rows = stops.join(size, ["query_id", "component"]).join(down, ["query_id", "id"], "left").join(up, ["query_id", "id"], "left")
    ranked = centrality_ranks(stops.select("query_id", "id").join(nodes.select("id", "qualname", "centrality"), "id"), ["query_id"]).select("query_id", "id", "centrality_rank")
    total = stops.groupBy("query_id").agg(F.count("*").alias("total"))
    calls, called = F.coalesce("calls", F.lit(0)), F.coalesce("called", F.lit(0))
    place = (
        F.when(F.col("members") > 1, F.format_string("In a cycle of %d symbols, read as one", "members"))
        .when((F.col("tier") == 0) & (called > 0), F.format_string("Leaf with %d caller(s) here", called))
        .when(F.col("tier") == 0, F.lit("Leaf that stands alone here"))
        .otherwise(F.format_string("Depth %d on %d callee(s), with %d caller(s) here", "tier", calls, called))
    )
    rows = rows.join(ranked, ["query_id", "id"]).join(total, "query_id")
    return rows.select("query_id", "id", F.concat(place, F.format_string("; centrality %d of %d.", "centrality_rank", "total")).alias("reason"))


def reading_paths(queries: DataFrame, hits: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = STOPS) -> DataFrame:
    """(query_id, id, stop, tier, reason): a path of at most ``limit`` stops per query."""
    scratch = Scratch(queries.sparkSession)
    edges, nodes = scratch.cut(edges), scratch.cut(nodes)
    selected = selection(seeds(hits, queries, nodes, limit), edges, nodes, limit)
    stops = scratch.cut(ordered(selected, edges, nodes))
    return stops.join(reasons(stops, edges, nodes), ["query_id", "id"]).select("query_id", "id", "stop", "tier", "reason")
