"""Who depends on what: flows that touch targets, hop by hop through what starts them, and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import Scratch


def upstream(touches: DataFrame, starts: DataFrame, targets: DataFrame, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """(flow, hops, type, target): every way in which a flow touches what it depends on, at the flow's least number of hops.

    ``touches`` is (flow, type, target), ``starts`` (target, flow): what starts a flow.
    Hop 1 are the flows that touch ``targets`` (target); the next hop touches what starts
    the flows of the last.  ``types`` are the kinds of touch that count.  A join per hop;
    each hop is a written table.
    """
    scratch = Scratch(touches.sparkSession, "upstream")
    counted = touches.where(F.col("type").isin(types)) if types else touches
    level, found = targets.select("target").distinct(), None
    for hops in range(1, depth + 1):
        ways = counted.join(level, "target", "left_semi").select("flow", "type", "target").distinct()
        if found is not None:
            ways = ways.join(found.select("flow").distinct(), "flow", "left_anti")
        ways = scratch.keep(ways.select("flow", F.lit(hops).alias("hops"), "type", "target"), "ways")
        if hops > 1 and ways.isEmpty():
            break
        found = ways if found is None else found.unionByName(ways)
        level = starts.join(ways.select("flow").distinct(), "flow", "left_semi").select("target").distinct()
    return found


def downstream(touches: DataFrame, starts: DataFrame, flows: DataFrame, depth: int = 2, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``flows`` (flow) touch, themselves or through flows that they start: (type, target, hops), and those flows (flow, hops)."""
    scratch = Scratch(touches.sparkSession, "downstream")
    counted = touches.where(F.col("type").isin(types)) if types else touches
    reached = frontier = scratch.keep(flows.select("flow").distinct().withColumn("hops", F.lit(0)), "flows")
    for hops in range(1, depth + 1):
        targets = counted.join(frontier.select("flow"), "flow", "left_semi").select("target").distinct()
        new = starts.join(targets, "target", "left_semi").select("flow").distinct().join(reached, "flow", "left_anti")
        frontier = scratch.keep(new.withColumn("hops", F.lit(hops)), "flows")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    touched = counted.join(reached, "flow").groupBy("type", "target").agg(F.min("hops").alias("hops"))
    return touched, reached.where("hops > 0")


def grouped(found: DataFrame, places: DataFrame) -> DataFrame:
    """(application, space, hops, flows): flows found, by where ``places`` (flow, application, space) puts them; hops are the least of a group."""
    flows = found.groupBy("flow").agg(F.min("hops").alias("hops")).join(places, "flow", "left")
    name = lambda c, none: F.coalesce(F.col(c), F.lit(none)).alias(c)
    return flows.groupBy(name("application", "?"), name("space", "no space")).agg(F.min("hops").alias("hops"), F.count("*").alias("flows"))


def targets_of(refs: DataFrame, exposes: DataFrame, starts: DataFrame) -> DataFrame:
    """(ref, target): what depending on a node (ref, kind) means: the interfaces of an application (application, interface), what starts a flow (target, flow), else the node itself."""
    kind = F.coalesce("kind", F.lit(""))
    of_applications = refs.where(kind == "application").join(exposes.select(F.col("application").alias("ref"), F.col("interface").alias("target")), "ref").select("ref", "target")
    of_flows = refs.where(kind == "flow").join(starts.select(F.col("flow").alias("ref"), "target"), "ref").select("ref", "target")
    return refs.where(~kind.isin("application", "flow")).select("ref", F.col("ref").alias("target")).unionByName(of_applications).unionByName(of_flows).distinct()


def by_call_site(found: DataFrame, effects: DataFrame) -> DataFrame:
    """(flow, hops, type, target, operation, file, line): what ``upstream`` found, a row for each operation and call site.

    ``effects`` is (flow, type, target, operation, file, line, sites): sites are texts of a line and, perhaps, an
    operation (``120 upsert``); without any the effect's own line is its site.
    """
    sites = F.when(F.size("sites") > 0, text.call_sites(F.col("sites")))
    at = effects.select("flow", "type", "target", "operation", "file", "line", F.explode_outer(sites).alias("site"))
    placed = at.select("flow", "type", "target", F.coalesce("site.operation", "operation").alias("operation"), "file", F.when(F.col("site").isNull(), F.col("line")).otherwise(F.col("site.line")).alias("line")).distinct()
    return found.join(placed, ["flow", "type", "target"]).select("flow", "hops", "type", "target", "operation", "file", "line")


def possible_callers(unknown: DataFrame, endpoints: DataFrame, block: int = 128, rows_per_task: int = 20_000_000) -> DataFrame:
    """(call, endpoint, exact): calls (call, method, shape) whose host is not known, and endpoints of the same method whose path they have or end with.

    A base address may put segments before an endpoint's path, never half of one: each call
    is looked up by its path and by every path that is left without its first segments.
    Nothing ends with the bare root.

    Calls that look up the same path meet its endpoints in blocks, and a block's rows come endpoint by endpoint: an endpoint stands in a run and the
    calls repeat, so that files of the result hold a small part of a byte for each row. With one shape an endpoint, no pair is dealt out. Tasks are as many as the
    rows of the result ask for.
    """
    spark = unknown.sparkSession
    scratch = Scratch(spark, "callers")
    ends = endpoints.select("endpoint", "method", "shape").dropna(subset=["method", "shape"]).distinct().withColumn("ways", F.count("*").over(Window.partitionBy("endpoint")))
    ends = scratch.keep(ends, "endpoints")
    paths = scratch.keep(ends.groupBy("method", "shape").agg(F.count("*").alias("ends")).withColumn("key", F.monotonically_increasing_id()), "paths")

    def keys(ask: Column) -> Column:
        parts = F.slice(F.split(ask["shape"], "/"), 2, 1 << 20)
        n = F.size(parts)
        tails = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.greatest(n - i + 1, F.lit(0))), "/")))
        key = lambda shape, exact: F.struct(ask["method"].alias("method"), shape.alias("shape"), F.lit(exact).alias("exact"))
        return F.concat(F.array(key(ask["shape"], True)), F.transform(F.filter(tails, lambda t: F.length(t) > 1), lambda t: key(t, False)))

    asks = unknown.where("method is not null and shape is not null").groupBy("call").agg(F.collect_set(F.struct(F.upper("method").alias("method"), "shape")).alias("asks"))
    every = asks.select("call", F.array_distinct(F.flatten(F.transform("asks", keys))).alias("every"))
    exact = lambda k: F.struct(k["method"].alias("method"), k["shape"].alias("shape"), F.lit(True).alias("exact"))
    asked = every.select("call", F.inline(F.filter("every", lambda k: k["exact"] | ~F.array_contains("every", exact(k)))))
    # rows of a task are sorted, so that each block is made there and their numbers are always the same
    looked_up = asked.join(paths.drop("ends"), ["method", "shape"]).select("key", "exact", "call").sortWithinPartitions("key", "exact", "call")
    numbered = looked_up.withColumn("block", F.floor(F.monotonically_increasing_id() / block))
    # collected lists leave out a call that is not known
    calls = F.concat(F.collect_list("call"), F.array_repeat(F.lit(None).cast(unknown.schema["call"].dataType), (F.count("*") - F.count("call")).cast("int")))
    blocks = scratch.keep(numbered.groupBy("key", "exact", "block").agg(calls.alias("calls")), "blocks")

    sizes = blocks.groupBy("key").agg(F.sum(F.size("calls")).alias("calls")).join(paths.select("key", "ends"), "key").select("key", (F.col("calls") * F.col("ends")).alias("rows"))
    sizes = scratch.keep(sizes.withColumn("lanes", F.ceil(F.col("rows") / (rows_per_task // 4))), "sizes")
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    tasks = max(-(-rows // rows_per_task), min(spark.sparkContext.defaultParallelism, -(-rows // (rows_per_task // 20))), 1)
    lanes = sizes.select("key", "lanes")
    dealt = lambda df: df.repartition(tasks, "key", "lane")
    ends = ends.join(paths.drop("ends"), ["method", "shape"]).join(lanes, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"), "endpoint", "ways")
    laid = dealt(blocks.join(lanes, "key").select("key", F.pmod(F.xxhash64("block"), F.col("lanes")).alias("lane"), "exact", "calls"))
    pairs = lambda ends: laid.join(dealt(ends).hint("merge"), ["key", "lane"]).select(F.explode("calls").alias("call"), "endpoint", "exact")
    # a call meets an endpoint of one method and shape once, so only pairs of the others are grouped
    return pairs(ends.where("ways = 1")).unionByName(pairs(ends.where("ways > 1")).groupBy("call", "endpoint").agg(F.bool_or("exact").alias("exact")))


def target_place(targets: DataFrame) -> DataFrame:
    """Where a view puts a target: with the application that owns it, else its datastore, else its store, else outside."""
    return targets.withColumn("place", F.coalesce("owner", "datastore", "store", F.lit("external")))


def neighbours(edges: DataFrame, nodes: DataFrame, most: int = 40, parts: int | None = None) -> DataFrame:
    """(node, direction, type, n, others): the neighbours of each of ``nodes`` (node), at most ``most`` named, and how many there are.

    With ``parts``, ends are dealt once by node into so many parts, which all steps keep.
    """
    ends = edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), "type", F.col("src").alias("other")).unionByName(
        edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    )
    dealt = ends.repartition(parts, "node") if parts else ends
    some = dealt.join(nodes.select("node").distinct(), "node", "left_semi").distinct()
    key = ["node", "direction", "type"]
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("other")))
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.col("other")))).alias("others"))
