"""Graph analytics over (src, dst) edge tables: PageRank, components and longest-path depth.

Iterations are cut by written tables.  Only convergence scalars reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.plans.scratch import Scratch

DAMPING = 0.85


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def pagerank(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-10, damping: float = DAMPING) -> DataFrame:
    """(id, rank): PageRank from caller to callee; the mass of nodes without callees goes to all alike."""
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select("src", "dst").distinct().filter("src <> dst")
    degree = pairs.groupBy("src").agg(F.count("*").alias("degree"))
    links = scratch.cut(pairs.join(degree, "src"))
    every = scratch.cut(nodes_of(edges).join(degree.select(F.col("src").alias("id"), F.lit(True).alias("calls")), "id", "left"))
    n = every.count()
    if not n:
        return every.select("id", F.lit(0.0).alias("rank"))
    ranks = scratch.cut(every.select("id", "calls", F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        old = scratch.last
        lost = ranks.filter("calls IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = links.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = ranks.join(given, F.col("id") == F.col("dst"), "left").crossJoin(lost)  # one row
        value = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        ranks = scratch.cut(new.select("id", "calls", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved")))
        moved = ranks.agg(F.sum("moved")).first()[0]
        ranks = ranks.drop("moved")
        if moved < tolerance:
            break
        scratch.drop(old)
    return ranks.select("id", "rank")


def _spread_least(edges: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): the least label that reaches each node along the edges."""
    while True:
        old = scratch.last
        given = edges.join(labels, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label")
        new = labels.unionByName(given).groupBy("id").agg(F.min("label").alias("label"))
        both = scratch.cut(new.join(labels.withColumnRenamed("label", "was"), "id"))
        changed = both.filter("label <> was").limit(1).count()
        labels = both.drop("was")
        if not changed:
            return labels
        scratch.drop(old)


def _jumped(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, up, dist, low, loop) of (id, up): where each chain of pointers ends and how far that is.

    Doubles the distance covered per round, so a chain of n nodes takes log2(n) rounds.  A chain that has
    not ended by then runs into a cycle (``loop``): its ``up`` then lies on that cycle, and every node of a
    cycle is the ``up`` of some node of it.  ``low`` is the least id seen on the way; from a node of a cycle
    that is the cycle's least.
    """
    now = scratch.cut(pointers.select("id", "up", F.lit(1).cast("long").alias("dist"), F.least("id", "up").alias("low"), F.lit(True).alias("loop")))
    n = now.count()
    for _ in range(max(1, n).bit_length() + 1 if n else 0):
        old = scratch.last
        nxt = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"), F.col("low").alias("low2"))
        on = F.col("up2").isNotNull()
        now = scratch.cut(
            now.drop("loop").join(nxt, "up", "left").select(
                "id", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.least("low", F.coalesce("low2", F.col("low"))).alias("low"), on.alias("loop")
            )
        )
        scratch.drop(old)
        if not now.filter("loop").limit(1).count():
            break
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components named by their least member.

    First everything that needs no search leaves, by pointer jumping along nodes with one caller (then
    one callee): what hangs from a node without callers is a component of its own, and a cycle of such
    nodes is one component, which is contracted.  That repeats as long as it finds something; long chains
    and long cycles take logarithmic rounds.  What is left is coloured: every node takes the least id that
    reaches it; within a colour, the nodes that reach the colour's own node are its component; they leave.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.cut(edges.select("src", "dst").distinct().filter("src <> dst"))
    left = scratch.cut(nodes_of(edges))
    member = left.select("id", F.col("id").alias("rep"))
    single = []
    while left.limit(1).count():
        found = False
        for node, other in (("dst", "src"), ("src", "dst")):
            degree = scratch.cut(pairs.groupBy(F.col(node).alias("id")).agg(F.count("*").alias("n"), F.min(other).alias("up")))
            ends = left.join(degree.select("id"), "id", "left_anti")
            chains = _jumped(degree.filter("n = 1").select("id", "up"), scratch)
            hanging = chains.filter("NOT loop").join(ends.withColumnRenamed("id", "up"), "up", "left_semi").select("id")
            gone = scratch.cut(ends.unionByName(hanging))
            loops = chains.filter("loop").select(F.col("up").alias("id")).distinct().join(chains.select("id", "low"), "id")
            merged = scratch.cut(loops.select("id", F.col("low").alias("into")).filter("id <> into"))
            some_gone, some_merged = bool(gone.limit(1).count()), bool(merged.limit(1).count())
            if some_gone:
                single.append(gone)
                left = scratch.cut(left.join(gone, "id", "left_anti"))
            if some_merged:
                left = scratch.cut(left.join(merged.select("id"), "id", "left_anti"))
                member = scratch.cut(member.join(merged.select(F.col("id").alias("rep"), "into"), "rep", "left").select("id", F.coalesce("into", "rep").alias("rep")))
                a = merged.select(F.col("id").alias("src"), F.col("into").alias("src2"))
                b = merged.select(F.col("id").alias("dst"), F.col("into").alias("dst2"))
                pairs = pairs.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("src2", "src").alias("src"), F.coalesce("dst2", "dst").alias("dst")).distinct().filter("src <> dst")
            if some_gone or some_merged:
                found = True
                pairs = scratch.cut(pairs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if not found:
            break
    of_reps = _coloured(pairs, left, scratch)
    for gone in single:
        of_reps = of_reps.unionByName(gone.select("id", F.col("id").alias("component")))
    placed = scratch.cut(member.join(of_reps.select(F.col("id").alias("rep"), "component"), "rep").select("id", "component"))
    return placed.join(placed.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))


def _coloured(pairs: DataFrame, left: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of the nodes ``left`` by forward colours and backward searches."""
    done = []
    while left.limit(1).count():
        live = scratch.cut(pairs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        colour = _spread_least(live, scratch.cut(left.withColumn("label", F.col("id"))), scratch)
        c = colour.withColumnRenamed("label", "colour")
        same = live.join(c.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").filter("a = b")
        back = scratch.cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = scratch.cut(c.filter("id = colour").select("id", F.col("colour").alias("component")))
        while True:
            more = back.join(found, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "component").distinct().join(found, "id", "left_anti")
            more = scratch.cut(more)
            if not more.limit(1).count():
                break
            found = scratch.cut(found.unionByName(more))
        done.append(found)
        left = scratch.cut(left.join(found, "id", "left_anti"))
    out = left.withColumn("component", F.col("id"))
    for f in done:
        out = out.unionByName(f)
    return out


def depths(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, depth): longest path below each component of the condensed graph; leaves are 0.

    A component with one callee is that callee's depth and one more, so chains of such are jumped over;
    the rounds that remain are as many as a path has components with several callees.
    """
    scratch = Scratch(edges.sparkSession)
    c = components
    up = edges.join(c.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    links = scratch.cut(up.filter("a <> b").select("a", "b").distinct())
    out = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("up"))
    chains = _jumped(out.filter("n = 1").select(F.col("a").alias("id"), "up"), scratch).select("id", F.col("up").alias("root"), "dist")
    every = c.select(F.col("component").alias("id")).distinct()
    place = scratch.cut(every.join(chains, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("dist", F.lit(0)).cast("long").alias("dist")))
    forks = out.filter("n > 1").select("a")
    steps = links.join(forks, "a", "left_semi").join(place.select(F.col("id").alias("b"), "root", "dist"), "b")
    steps = scratch.cut(steps.groupBy("a", "root").agg((F.max("dist") + 1).alias("dist")))
    depth = scratch.cut(place.filter("id = root").select("id", F.lit(0).cast("long").alias("depth")))
    while True:
        old = scratch.last
        below = steps.join(depth.select(F.col("id").alias("root"), "depth"), "root").groupBy("a").agg(F.max(F.col("depth") + F.col("dist")).alias("new"))
        moved = scratch.cut(depth.join(below, F.col("id") == F.col("a"), "left").select("id", F.greatest("depth", F.coalesce("new", F.lit(0))).alias("depth"), F.col("depth").alias("was")))
        changed = moved.filter("depth <> was").limit(1).count()
        depth = moved.drop("was")
        if not changed:
            break
        scratch.drop(old)
    return place.join(depth.withColumnRenamed("id", "root"), "root").select(F.col("id").alias("component"), (F.col("depth") + F.col("dist")).cast("int").alias("depth"))
