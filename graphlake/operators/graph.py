"""Reachability, trees and levels over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(node, hops): what can be reached from ``roots`` (node), with the least number of edges (src, dst); roots have 0.

    One join per hop for the whole frontier; visited nodes are removed by an
    anti-join, so cycles end.  Each frontier is a written table, so a lost
    executor costs one hop and the plan does not grow with the depth.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    steps = scratch.keep(edges.select(F.col(src).alias("at"), F.col(dst).alias("node")).where("at is not null and node is not null").distinct(), "edges")
    frontier = scratch.keep(roots.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)), "frontier")
    found, hops = frontier, 0
    while max_depth is None or hops < max_depth:
        hops += 1
        new = steps.join(frontier.select(F.col("node").alias("at")), "at", "left_semi").select("node").distinct().join(found, "node", "left_anti")
        frontier = scratch.keep(new.withColumn("hops", F.lit(hops)), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def reach_each(starts: DataFrame, edges: DataFrame, every: int = 8) -> DataFrame:
    """(start, node): what can be reached over ``edges`` (src, dst) from each of ``starts`` (start, node), these included; dealt by node.

    One join per hop for the frontiers of all starts.  What the last two hops found is left out of the next one, what all hops
    found in every ``every``-th hop only, so that known pairs are not dealt out again in each; a longer cycle is gone round until then.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    steps = scratch.keep(edges.select(F.col("src").alias("node"), "dst").dropna().distinct(), "edges")
    new, n = scratch.keep_counted(starts.select("start", "node").dropna().distinct(), "frontier")
    known = [new]
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    while n:
        further = new.join(steps, "node").select("start", F.col("dst").alias("node")).distinct()
        seen = known if len(known) % every == 0 else known[-2:]
        new, n = scratch.keep_counted(further.join(union(seen), ["start", "node"], "left_anti"), "frontier")
        known.append(new)
    return union(known).repartition("node").distinct()


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, ancestor, depth) for a table (node, parent): every node is its own ancestor at depth 0.

    Paths double each round: those of the full length reached so far are joined with all
    that are known, so a tree of depth d takes log2(d) joins, whatever its depth, and
    each pair is made once.  In a cycle each node has the others as ancestors, at
    the least depth.
    """
    scratch = Scratch(parents.sparkSession, "ancestors")
    one = parents.where("parent is not null and node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    everyone = parents.select("node").union(parents.select("parent")).where("node is not null").distinct()
    closure = newest = scratch.keep(one, "closure")
    span = 1
    while not newest.isEmpty():
        upper = closure.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        longer = newest.where(F.col("depth") == span).join(upper, "ancestor").where("node <> top").groupBy("node", F.col("top").alias("ancestor")).agg((F.min("more") + span).alias("depth"))
        newest = scratch.keep(longer.join(closure, ["node", "ancestor"], "left_anti"), "closure")
        closure, span = closure.unionByName(newest), span * 2
    return closure.unionByName(everyone.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def common_ancestor(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor) of node pairs: the common ancestor nearest to ``a``; pairs without one are left out."""
    x = closure.select(F.col("node").alias("a"), "ancestor", F.col("depth").alias("da"))
    y = closure.select(F.col("node").alias("b"), "ancestor", F.col("depth").alias("db"))
    both = pairs.join(x, "a").join(y, ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min_by("ancestor", "da").alias("ancestor"))


def representative(closure: DataFrame, container: DataFrame) -> DataFrame:
    """(container, node, representative): the child of the container that holds the node."""
    below = closure.join(container.select(F.col("node").alias("ancestor")), "ancestor").where("depth >= 1").select(F.col("ancestor").alias("container"), "node", "depth")
    upward = closure.select("node", F.col("ancestor").alias("representative"), F.col("depth").alias("d"))
    return below.join(upward, "node").where(F.col("d") == F.col("depth") - 1).select("container", "node", "representative")


def rollup(closure: DataFrame, measures: DataFrame, *columns: str) -> DataFrame:
    """Sums of each node's own measures over all its descendants and itself."""
    return closure.join(measures, "node").groupBy(F.col("ancestor").alias("node")).agg(*[F.sum(c).alias(c) for c in columns])


def level_links(links: DataFrame, places: DataFrame) -> DataFrame:
    """(src, dst, n, internal): links (src, dst, n) lifted to the representatives (node, representative) of both ends."""
    a = places.select(F.col("node").alias("src"), F.col("representative").alias("from"))
    b = places.select(F.col("node").alias("dst"), F.col("representative").alias("to"))
    lifted = links.join(a, "src").join(b, "dst").groupBy(F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.sum("n").alias("n"))
    return lifted.withColumn("internal", F.col("src") == F.col("dst"))


def prefix_chain(mounts: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, path): a node's path prefixed by those of what it is mounted in, outermost first; a cycle ends where it closes.

    ``mounts`` is (node, parent, prefix), ``starts`` (node, path).  One join per
    level, for as many levels as there are; it never broadcasts, since each level would send its rows through the driver.
    """
    scratch = Scratch(starts.sparkSession, "mounts")
    now = starts.select("node", F.col("node").alias("at"), "path", F.array("node").alias("seen"))
    ended = None
    while True:
        step = now.join(mounts.select(F.col("node").alias("at"), "parent", "prefix").hint("merge"), "at", "left")
        goes = F.col("parent").isNotNull() & ~F.array_contains("seen", F.col("parent"))
        step = scratch.keep(step.withColumn("goes", F.coalesce(goes, F.lit(False))), "chain")
        done = step.where("not goes").select("node", "path")
        ended = done if ended is None else ended.unionByName(done)
        now = step.where("goes").select("node", F.col("parent").alias("at"), F.concat("prefix", "path").alias("path"), F.concat("seen", F.array("parent")).alias("seen"))
        if now.isEmpty():
            return ended
