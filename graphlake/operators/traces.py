"""Traces: the depth-first listing of a flow's calls, and the flows assembled from it.

A depth-first walk that expands every function once visits a function on the
smallest of its simple paths from the roots, where a path is the list of the numbers of the
calls on it.  Where each flow has calls of its own no walk is made: all flows are expanded together, level by level,
each round keeping the smallest path known to each function, until none gets smaller.
The listing is then one join of functions, at their paths, with their calls.

Calls that all flows share are walked once for each root symbol, and what flows have in common is listed once: a flow's roots but the last
(its head) for all flows that begin alike, and its last root for all flows of the same roots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import graph

#: Calling functions of a walk up to which one task walks it; what they call is held while it does.
WALK = 500_000
#: Entries of a part, and flows, that are multiplied at once; rows that one task multiplies them to.
CHUNK, BLOCK, ROWS = 4096, 128, 10_000_000


def depth_first(calls: DataFrame, roots: DataFrame, utilities: DataFrame | None = None, compact_every: int = 8, few: int = 100_000) -> DataFrame:
    """(flow, path, depth, symbol, repeat, recursive, first, interceptor): every call of a flow in call order.

    ``calls`` is (caller, callee, ord), with ``flow`` if each flow has its own; ``roots``
    (flow, symbol), with ``ord`` for their order and ``interceptor`` for what runs before the handler.  A function is
    expanded once per flow: later visits are marked ``repeat`` if it calls
    anything; a visit below itself is ``recursive``; ``utilities`` (symbol) are listed,
    never expanded.  ``first`` marks the visits that are expanded.

    Calls that all flows share are walked once for each root symbol, not once for each flow: see ``shared``.

    With calls of their own, flows take as many rounds as the deepest walk has levels; a round joins the functions
    whose path got smaller with their calls, and compares with the paths of all known
    ones.  They are counted as they are written: where they are at most ``few``, hashes of what they call are broadcast,
    so that late rounds do not deal out all known paths again.  A flow is spread over its functions, and no task holds one.

    Defined results: rows without flow, caller or callee are left out; calls of one
    place go by the callee's name; equal calls are listed each; a root that is met
    below an earlier root is a repeat.
    """
    columns = ["flow", "path", "depth", "symbol", "repeat", "recursive", "first", "interceptor"]
    if "flow" not in calls.columns:
        heads, tails, members = shared(calls, roots, utilities, compact_every, few)
        return of_flows(heads.unionByName(tails), members).select(columns)
    scratch = Scratch(calls.sparkSession, "traces")
    edges, starts = _edges(scratch, calls.withColumnRenamed("flow", "walk"), utilities, ["walk"]), _starts(scratch, roots)
    begun = starts.groupBy(F.col("flow").alias("walk"), "symbol").agg(F.array(F.min("place")).alias("path"))
    tops = starts.select(F.col("flow").alias("walk"), F.array("place").alias("path"), "symbol", "interceptor")
    told = _listed(_by_rounds(scratch, edges, begun, ["walk"], compact_every, few), edges, tops, ["walk"])
    return told.withColumnRenamed("walk", "flow").select("flow", F.array_join("path", ".").alias("path"), F.size("path").alias("depth"), "symbol", _repeat().alias("repeat"), "recursive", "first", "interceptor")


def shared(calls: DataFrame, roots: DataFrame, utilities: DataFrame | None = None, compact_every: int = 8, few: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``depth_first`` for calls that all flows share, in parts: (heads, tails, members).

    Heads and tails are entries as of ``depth_first``, whose ``flow`` numbers a part, with ``place`` and ``at`` for their order, ``visits``,
    how often the part's head visits the symbol, and ``chunk``; tails have their ``head`` too.  ``members`` is (flow, head, head_size, part, size): a flow
    has the entries of its head, which is null if it has one root, and of its part; sizes are at least the numbers of their entries.

    The smallest paths of a flow are those of its first root that reaches a function, whatever other roots it has. So a flow lists the walks of its
    roots and leaves out what is below functions that an earlier root of it expands. This is done once for all flows whose roots, or whose
    roots but the last, are the same; roots are compared by two hashes of 64 bits.
    """
    scratch = Scratch(calls.sparkSession, "traces")
    edges, starts = _edges(scratch, calls, utilities, []), _starts(scratch, roots)
    begun = starts.select(F.col("symbol").alias("walk"), "symbol", F.array().cast("array<int>").alias("path")).distinct()
    walks = scratch.keep(_smallest_paths(scratch, edges, begun, [], compact_every, few), "walks")
    sizes = scratch.keep(walks.groupBy(F.col("walk").alias("symbol")).agg(F.count("*").alias("size")), "sizes")

    marked = starts.withColumns({name: F.xxhash64(F.lit(seed), "place", "symbol", "interceptor") for seed, name in enumerate("ab")})
    of_all = marked.groupBy("flow").agg(F.max("place").alias("place"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max_by(F.struct("symbol", "interceptor", "a", "b"), "place").alias("last"))
    before = {f"before_{c}": F.col(c).bitwiseXOR(F.col(f"last.{c}")) for c in "ab"}
    sequences = scratch.keep(of_all.select("flow", "place", "a", "b", "last.symbol", "last.interceptor", *[c.alias(name) for name, c in before.items()]), "sequences")
    alike = sequences.groupBy("place", "a", "b").agg(F.min("flow").alias("flow"), *[F.min(c).alias(c) for c in ("symbol", "interceptor", *before)])
    alike = scratch.keep(alike.join(sizes, "symbol").withColumn("part", F.monotonically_increasing_id() * 2), "tails")
    several = alike.where("place > 1")
    begin = scratch.keep(several.groupBy("place", *before).agg(F.min("flow").alias("flow")).withColumn("head", F.monotonically_increasing_id() * 2 + 1), "heads")
    rooted = starts.join(begin.select("flow", "head", F.col("place").alias("last")), "flow").where("place < last")
    rooted = scratch.keep(rooted.join(sizes, "symbol").select("head", "place", F.col("symbol").alias("walk"), "interceptor", "size"), "rooted")
    begin = begin.drop("flow").join(rooted.groupBy("head").agg(F.sum("size").alias("head_size")), "head")
    alone = alike.where("place = 1").withColumns({"head": F.lit(None).cast("long"), "head_size": F.lit(0).cast("long")})
    alike = scratch.keep(several.join(begin, ["place", *before]).unionByName(alone).drop("flow", *before), "parts")
    members = scratch.keep(sequences.select("flow", "place", "a", "b").join(alike.drop("symbol", "interceptor"), ["place", "a", "b"]).select("flow", "head", "head_size", "part", "size"), "members")

    begins = F.col("caller").isNull()
    chunk = lambda size: F.pmod(F.xxhash64("place", "at"), F.ceil(F.col(size) / CHUNK)).alias("chunk")
    path = F.concat_ws(".", F.col("place").cast("string"), F.nullif("path", F.lit("")))
    entry = [path.alias("path"), (F.col("depth") + 1).alias("depth"), "symbol", _repeat().alias("repeat"), "recursive", "first", F.when(begins, F.col("interceptor")).alias("interceptor"), "place", "at"]
    every = rooted.drop("size").join(rooted.groupBy("head").agg(F.sum("size").alias("size")), "head").join(walks, "walk")
    earliest = lambda c: F.min("place").over(Window.partitionBy("head", c))
    expanded = every.withColumn("by", earliest("caller")).where(begins | (F.col("by") == F.col("place")))
    heads = expanded.withColumn("first", F.col("first") & (F.col("place") == earliest("symbol")))
    heads = scratch.keep(heads.select(F.col("head").alias("flow"), *entry, F.lit(0).cast("long").alias("visits"), chunk("size"), F.lit(None).cast("long").alias("head")), "heads")

    met = scratch.keep(heads.groupBy(F.col("flow").alias("head"), "symbol").agg(F.count("*").alias("visits")), "met")
    last = alike.select("part", "head", "place", F.col("symbol").alias("walk"), "interceptor", "size").join(walks, "walk")
    alone = last.where("head is null").withColumn("visits", F.lit(0).cast("long"))
    # what is below a function that the head lists is listed there
    after = last.where("head is not null").join(met.select("head", F.col("symbol").alias("caller")), ["head", "caller"], "left_anti").join(met, ["head", "symbol"], "left")
    after = after.withColumn("visits", F.coalesce("visits", F.lit(0).cast("long"))).withColumn("first", F.col("first") & (F.col("visits") == 0))
    tails = after.unionByName(alone).select(F.col("part").alias("flow"), *entry, "visits", chunk("size"), "head")
    return heads, tails, members


def of_flows(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Entries of parts (``flow``, ``chunk``) as entries of all flows that have the part.

    Flows meet the entries of a part in blocks, and a block's rows come entry by entry: an entry stands in a run and the flows repeat, so that
    files of the result hold little for each row. Tasks are as many as the rows of the result ask for.
    """
    spark = entries.sparkSession
    scratch = Scratch(spark, "flows")
    has = members.select("flow", F.col("part"), "size").unionByName(members.where("head is not null").select("flow", F.col("head").alias("part"), F.col("head_size").alias("size")))
    rows = has.agg(F.sum("size")).first()[0] or 0
    parts = max(-(-rows // ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // (ROWS // 20))), 1)
    place = F.row_number().over(Window.partitionBy("part").orderBy("flow"))
    blocks = has.withColumn("block", F.floor((place - 1) / BLOCK)).groupBy("part", "block").agg(F.collect_list("flow").alias("flows"), F.first("size").alias("size"))
    blocks = scratch.keep(blocks.select("part", "flows", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / CHUNK) - 1)).alias("chunk")), "blocks")
    columns = [c for c in entries.columns if c not in ("flow", "chunk")]
    met = entries.withColumnRenamed("flow", "part").repartition(parts, "part", "chunk").join(blocks.repartition(parts, "part", "chunk").hint("merge"), ["part", "chunk"])
    return met.select(F.explode("flows").alias("flow"), *columns)


def _edges(scratch: Scratch, calls: DataFrame, utilities: DataFrame | None, own: list[str]) -> DataFrame:
    """([walk,] caller, callee, n): calls numbered in call order, without those of utilities."""
    named = calls.dropna(subset=[*own, "caller", "callee"]).select(*own, F.col("caller").cast("string").alias("caller"), F.col("callee").cast("string").alias("callee"), "ord")
    edges = named.select(*own, "caller", "callee", F.row_number().over(Window.partitionBy(*own, "caller").orderBy("ord", "callee")).alias("n"))
    if utilities is not None:
        edges = edges.join(utilities.select(F.col("symbol").alias("caller")).distinct(), "caller", "left_anti")
    return scratch.keep(edges, "calls")


def _starts(scratch: Scratch, roots: DataFrame) -> DataFrame:
    """(flow, symbol, place, interceptor): the roots of each flow, numbered."""
    absent = {"ord": F.lit(0), "interceptor": F.lit(None).cast("string")}
    roots = roots.withColumns({c: v for c, v in absent.items() if c not in roots.columns}).dropna(subset=["flow", "symbol"])
    place = F.row_number().over(Window.partitionBy("flow").orderBy("ord", "symbol"))
    return scratch.keep(roots.select("flow", F.col("symbol").cast("string").alias("symbol"), place.alias("place"), "interceptor"), "roots")


def _repeat() -> Column:
    return ~F.col("recursive") & ~F.col("first") & F.col("calls")


def _smallest_paths(scratch: Scratch, edges: DataFrame, begun: DataFrame, own: list[str], compact_every: int, few: int) -> DataFrame:
    """(walk, at, caller, path, depth, symbol, recursive, calls, first): the entries of the walk of each of ``begun`` (walk, symbol, path), numbered in call order.

    First the functions that a walk reaches are found, without paths. A walk of at most ``WALK`` calling functions
    is then made by one task from their calls, in call order, which visits each on its smallest path; larger ones are expanded by rounds.
    """
    reached = _reached(scratch, edges, begun.select("walk"))
    callees = edges.groupBy("caller").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "callee"))), lambda x: x["callee"]).alias("callees"))
    sizes, n = scratch.keep_counted(reached.join(callees.select(F.col("caller").alias("symbol")), "symbol", "left_semi").groupBy("walk").count().where(F.col("count") > WALK), "large")
    large = begun.join(sizes, "walk", "left_semi")
    if n:
        reached = reached.join(sizes, "walk", "left_anti")
    graphs = reached.join(callees.withColumnRenamed("caller", "symbol"), "symbol", "left").where("callees is not null or walk = symbol").select("walk", F.col("symbol").alias("caller"), "callees")
    kind = "walk string, at int, caller string, path string, depth int, symbol string, recursive boolean, calls boolean, first boolean"
    made = graphs.repartition("walk").sortWithinPartitions("walk").mapInArrow(_walked, kind)
    if not n:
        return made
    told = _listed(_by_rounds(scratch, edges, large, own, compact_every, few), edges, large.select("walk", "path", "symbol", F.lit(None).cast("string").alias("interceptor")), own)
    at = (F.row_number().over(Window.partitionBy("walk").orderBy("path")) - 1).alias("at")
    return made.unionByName(told.select("walk", at, "caller", F.array_join("path", ".").alias("path"), F.size("path").alias("depth"), "symbol", "recursive", "calls", "first"))


def _reached(scratch: Scratch, edges: DataFrame, walks: DataFrame) -> DataFrame:
    """(walk, symbol): what each of ``walks`` (walk), which are symbols, reaches, itself included.

    If most functions that call are walked, their reach doubles each round; else each round goes one call further.
    """
    steps = edges.select("caller", "callee").distinct()
    new, n = scratch.keep_counted(walks.select("walk", F.col("walk").alias("symbol")), "reached")
    if 2 * n >= edges.select("caller").distinct().count():
        above = graph.ancestors(steps.select(F.col("caller").alias("node"), F.col("callee").alias("parent"))).where("node <> ancestor")
        return scratch.keep(above.select(F.col("node").alias("walk"), F.col("ancestor").alias("symbol")).join(walks, "walk", "left_semi").unionByName(new), "reached")
    known = [new]
    while n:
        further = new.join(steps.withColumnRenamed("caller", "symbol"), "symbol").select("walk", F.col("callee").alias("symbol")).distinct()
        new, n = scratch.keep_counted(further.join(reduce(DataFrame.unionByName, known), ["walk", "symbol"], "left_anti"), "reached")
        known.append(new)
    return reduce(DataFrame.unionByName, known)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of walks, as ``_smallest_paths`` has them, from rows (walk, caller, callees) that stand together by walk."""
    names = ["walk", "at", "caller", "path", "depth", "symbol", "recursive", "calls", "first"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]

    def entries(walk: str, calls: dict[str, list[str]]) -> Iterator[tuple]:
        yield walk, 0, None, "", 0, walk, False, walk in calls, True
        seen, above, at = {walk}, {walk}, 0
        stack = [(walk, "", enumerate(calls.get(walk, ()), 1))]
        while stack:
            caller, path, rest = stack[-1]
            for n, callee in rest:
                at += 1
                first = callee not in seen
                place = f"{path}.{n}" if path else str(n)
                yield walk, at, caller, place, len(stack), callee, callee in above, callee in calls, first
                if first:
                    seen.add(callee)
                    if callee in calls:
                        above.add(callee)
                        stack.append((callee, place, enumerate(calls[callee], 1)))
                        break
            else:
                stack.pop()
                above.discard(caller)

    def every() -> Iterator[tuple]:
        walk, calls = None, {}
        for batch in batches:
            for at, caller, callees in zip(*(column.to_pylist() for column in batch.columns)):
                if at != walk and walk is not None:
                    yield from entries(walk, calls)
                    calls = {}
                walk = at
                if callees is not None:
                    calls[caller] = callees
        if walk is not None:
            yield from entries(walk, calls)

    rows: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
    for row in every():
        rows.append(row)
        if len(rows) == 10_000:
            yield made()
            rows.clear()
    if rows:
        yield made()


def _listed(at: DataFrame, edges: DataFrame, tops: DataFrame, own: list[str]) -> DataFrame:
    """(walk, caller, path, symbol, recursive, interceptor, calls, first): the calls of functions at their smallest paths, after ``tops`` (walk, path, symbol, interceptor)."""
    listed = at.select("walk", F.col("symbol").alias("caller"), "path", F.concat("above", F.array("symbol")).alias("above")).join(edges, [*own, "caller"])
    listed = listed.select("walk", "caller", F.concat("path", F.array("n")).alias("path"), F.col("callee").alias("symbol"), F.array_contains("above", F.col("callee")).alias("recursive"), F.lit(None).cast("string").alias("interceptor"))
    listed = listed.unionByName(tops.withColumns({"caller": F.lit(None).cast("string"), "recursive": F.lit(False)}))
    calling = edges.select(*own, F.col("caller").alias("symbol"), F.lit(True).alias("calls")).distinct()
    told = listed.join(at.select("walk", "symbol", F.col("path").alias("own")), ["walk", "symbol"], "left").join(calling, [*own, "symbol"], "left")
    return told.select("walk", "caller", "path", "symbol", "recursive", "interceptor", F.col("calls").isNotNull().alias("calls"), (F.col("path") == F.col("own")).alias("first"))


def _by_rounds(scratch: Scratch, edges: DataFrame, begun: DataFrame, own: list[str], compact_every: int, few: int) -> DataFrame:
    """(walk, symbol, path, above): the smallest path to each function of a walk that starts at ``begun`` (walk, symbol, path)."""
    smaller, n = scratch.keep_counted(begun.withColumn("above", F.array().cast("array<string>")), "paths")
    known = [smaller]
    everything = lambda: reduce(DataFrame.unionByName, known)
    smallest = lambda df: df.groupBy("walk", "symbol").agg(F.min(F.struct("path", "above")).alias("at")).select("walk", "symbol", "at.*")
    while n:
        visits = smaller.select("walk", F.col("symbol").alias("caller"), "path", F.concat("above", F.array("symbol")).alias("above"))
        steps = visits.join(edges.hint("merge"), [*own, "caller"]).where(~F.array_contains("above", F.col("callee")))
        found = steps.select("walk", F.col("callee").alias("symbol"), F.struct(F.concat("path", F.array("n")).alias("path"), "above").alias("at"), F.lit(None).cast("array<int>").alias("had"))
        before = everything()
        if n <= few:
            met_now = smaller.select("walk", F.col("symbol").alias("caller")).join(edges.hint("merge"), [*own, "caller"]).select(F.xxhash64("walk", "callee").alias("key")).distinct()
            before = before.withColumn("key", F.xxhash64("walk", "symbol")).join(F.broadcast(met_now), "key", "left_semi")
        before = before.select("walk", "symbol", F.lit(None).cast(found.schema["at"].dataType).alias("at"), F.col("path").alias("had"))
        met = found.unionByName(before).groupBy("walk", "symbol").agg(F.min("at").alias("at"), F.min("had").alias("had"))
        smaller, n = scratch.keep_counted(met.where("at is not null and (had is null or at.path < had)").select("walk", "symbol", "at.path", "at.above"), "paths")
        known.append(smaller)
        if len(known) > compact_every:
            merged = scratch.keep(smallest(everything()), "merged")
            scratch.drop(*[k for k in known if k is not smaller])
            known = [merged]
    return scratch.keep(smallest(everything()), "at")


def with_interceptors(entries: DataFrame, interceptors: DataFrame) -> DataFrame:
    """(flow, symbol, ord, interceptor): the roots of each flow, what runs before its handler first, filters before the others.

    ``entries`` is (flow, application, handler, labels, validated): ``validated`` lists the types that the handler
    has checked.  ``interceptors`` is (symbol, application, kind, http, validates).  One
    applies to requests of its application: to all if ``http``, or to handlers of a type that it ``validates``.
    """
    known = interceptors.select("application", "symbol", F.col("kind").alias("interceptor"), "http", "validates")
    applies = F.coalesce("http", F.lit(False)) | F.coalesce(F.array_contains("validated", F.col("validates")), F.lit(False))
    before = entries.where(F.array_contains("labels", "HttpEndpoint")).join(known, "application").where(applies)
    before = before.select("flow", "symbol", F.when(F.col("interceptor") == "filter", 0).otherwise(1).alias("ord"), "interceptor")
    return before.unionByName(entries.select("flow", F.col("handler").alias("symbol"), F.lit(2).alias("ord"), F.lit(None).cast("string").alias("interceptor")))


def utilities(calls: DataFrame, significant: DataFrame, least: int = 3) -> DataFrame:
    """(symbol): functions that at least ``least`` others call and that are not significant (symbol)."""
    return fan_in(calls, least).select(F.col("callee").alias("symbol")).join(significant.select("symbol"), "symbol", "left_anti")


def kept_gaps(unresolved: DataFrame, own_names: DataFrame, io_words: tuple[str, ...]) -> DataFrame:
    """(symbol, gaps): calls (symbol, line, method, reason) that could not be followed and may matter, by line.

    They matter if their reason is a library type, if some function of the
    organization (name) has the method's name, or if the name holds a word of input or output.
    """
    words = F.lower(F.regexp_replace("method", "([a-z0-9])([A-Z])", "$1 $2"))
    io = F.arrays_overlap(F.split(words, "[^a-z0-9]+"), F.array(*map(F.lit, io_words)))
    named = own_names.select(F.col("name").alias("method"), F.lit(True).alias("own")).distinct()
    kept = unresolved.join(named, "method", "left").where((F.col("reason") == "library type") | F.col("own").isNotNull() | io)
    one = F.struct("line", F.concat_ws(" ", "method", F.concat(F.lit("("), F.col("reason"), F.lit(")"))).alias("text"))
    return kept.groupBy("symbol").agg(F.array_sort(F.collect_set(one)).alias("gaps")).select("symbol", F.transform("gaps", lambda g: g["text"]).alias("gaps"))


def position(path: str) -> Column:
    """A path as numbers, by which entries stand in call order."""
    return F.split(path, r"\.").cast("array<int>")


def dressed(entries: DataFrame, significant: DataFrame, gaps: DataFrame, utilities: DataFrame) -> DataFrame:
    """Entries of ``depth_first`` with ``utility``, ``step`` and ``gaps``.

    ``step`` numbers the visits of a significant function (symbol) in a flow; ``gaps`` (symbol, gaps)
    stand where a function is expanded, and at every visit of a utility, which never is.  Entries of parts (``shared``) are numbered
    after the visits in their head.
    """
    flag = lambda df, name: df.select("symbol", F.lit(True).alias(name)).distinct()
    known = flag(significant, "significant").join(flag(utilities, "utility"), "symbol", "full").join(gaps.select("symbol", F.col("gaps").alias("all_gaps")), "symbol", "full")
    marked = entries.join(known, "symbol", "left")
    part = "visits" in entries.columns
    visit = F.row_number().over(Window.partitionBy("flow", "symbol").orderBy(*(["place", "at"] if part else [position("path")])))
    if part:
        visit = (visit + F.col("visits")).cast("int")
    shows = ~F.col("recursive") & (F.col("first") | F.col("utility").isNotNull())
    return marked.select(*entries.columns, F.col("utility").isNotNull().alias("utility"), F.when(F.col("significant").isNotNull(), visit).alias("step"), F.when(shows, F.col("all_gaps")).alias("gaps"))


def outlined(entries: DataFrame) -> DataFrame:
    """(flow, path, parent, number): shown entries (flow, path, shown) with their outline number among shown ones, as ``2.1.3``.

    An entry's own number is its place under its nearest shown ancestor, at the top after ``before`` others, if there is such a
    column; a ``chunk`` is kept; the outline joins the numbers of all shown ancestors.  Entries are dealt by flow and sorted, then read once: only the
    shown ancestors of the entry at hand are held.
    """
    before = F.coalesce("before", F.lit(0).cast("long")) if "before" in entries.columns else F.lit(0).cast("long")
    kept = ["flow", "path", *[c for c in ("chunk",) if c in entries.columns]]
    shown = entries.where("shown and flow is not null and path is not null").select(before.alias("before"), *kept, position("path").alias("place"))
    dealt = shown.repartition("flow").sortWithinPartitions("flow", "place").drop("place")
    kinds = [f"{c} {shown.schema[c].dataType.simpleString()}" for c in kept]
    return dealt.mapInArrow(_numbered, ", ".join([*kinds, "parent string", "number string"]))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (before, flow, path, …) in call order as (flow, path, …, parent, number)."""
    flow, above, tops = object(), [], 0
    for batch in batches:
        parents, numbers = [], []
        for before, at, path in zip(*(column.to_pylist() for column in batch.columns[:3])):
            if at != flow:
                flow, above, tops = at, [], before
            while above and not path.startswith(above[-1][0]):
                above.pop()
            if above:
                nearest = above[-1]
                nearest[2] += 1
                parent, number = nearest[0][:-1], f"{nearest[1]}.{nearest[2]}"
            else:
                tops += 1
                parent, number = None, str(tops)
            above.append([path + ".", number, 0])
            parents.append(parent)
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(parents, pa.string()), pa.array(numbers, pa.string())], names=[*batch.schema.names[1:], "parent", "number"])


def outlined_parts(heads: DataFrame, tails: DataFrame, members: DataFrame) -> DataFrame:
    """``outlined`` for entries of parts (``shared``) with ``shown``: (flow, path, parent, number, chunk), where ``flow`` is a part.

    What a tail has at the top is numbered after what its head has there.
    """
    scratch = Scratch(heads.sparkSession, "outline")
    of_heads = scratch.keep(outlined(heads), "heads")
    tops = of_heads.where("parent is null").groupBy(F.col("flow").alias("head")).agg(F.count("*").alias("before"))
    earlier = members.where("head is not null").select(F.col("part").alias("flow"), "head").distinct().join(tops, "head").select("flow", "before")
    return of_heads.unionByName(outlined(tails.join(earlier, "flow", "left")))


def assembled(entries: DataFrame) -> DataFrame:
    """(flow, functions, steps, entries, interceptors, unresolved, incomplete, symbols): one row per flow from its dressed entries.

    Symbols are distinct in each task before they meet.
    """
    out = _sums(entries, F.lit(True))
    return out.select("flow", "functions", "steps", "entries", "interceptors", "unresolved", (F.col("unresolved") > 0).alias("incomplete"), "symbols")


def _sums(entries: DataFrame, new: Column) -> DataFrame:
    """Sums over the dressed entries of each flow or part; of its symbols those that are ``new``."""
    lost = F.coalesce(F.size("gaps"), F.lit(0))
    counted = entries.groupBy("flow", "symbol").agg(
        F.count("*").alias("entries"), F.count("step").alias("steps"), F.sum(F.greatest(lost, F.lit(0))).alias("unresolved"), F.count("interceptor").alias("interceptors"), F.bool_and(new).alias("new")
    )
    return counted.groupBy("flow").agg(
        F.count_if("new").alias("functions"), F.sum("steps").alias("steps"), F.sum("entries").alias("entries"), F.sum("interceptors").alias("interceptors"), F.sum("unresolved").alias("unresolved"),
        F.array_sort(F.collect_list(F.when(F.col("new"), F.col("symbol")))).alias("symbols"),
    )


def assembled_parts(entries: DataFrame, members: DataFrame) -> DataFrame:
    """``assembled`` from the dressed entries of parts (``shared``): each part is summed once, and a flow adds its head and its tail.

    Flows come by head, so that lists of symbols that begin alike stand together.
    """
    scratch = Scratch(entries.sparkSession, "assembled")
    sums = scratch.keep(_sums(entries, F.col("visits") == 0), "sums")
    kept = [c for c in sums.columns if c != "flow"]
    of = lambda key: sums.select(F.col("flow").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in kept])
    flows = members.select("flow", "head", "part").join(of("part"), "part")
    alone = flows.where("head is null").select("flow", *[F.col(f"part_{c}").alias(c) for c in kept])
    both = flows.where("head is not null").join(of("head"), "head")
    # both lists are sorted, which sort_array makes use of
    added = [F.sort_array(F.concat("head_symbols", "part_symbols")).alias("symbols") if c == "symbols" else (F.col(f"head_{c}") + F.col(f"part_{c}")).alias(c) for c in kept]
    return both.select("flow", *added).unionByName(alone).select("flow", "functions", "steps", "entries", "interceptors", "unresolved", (F.col("unresolved") > 0).alias("incomplete"), "symbols")


def nearest_shown(entries: DataFrame) -> DataFrame:
    """(flow, path, parent) of shown entries (flow, path, shown): the nearest shown entry above, null at the top."""
    shown = entries.where("shown").select("flow", "path")
    parts = F.split("path", r"\.")
    above = shown.select("flow", "path", F.explode_outer(F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("parent"))
    found = above.join(shown.withColumnRenamed("path", "parent"), ["flow", "parent"]).groupBy("flow", "path").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return shown.join(found, ["flow", "path"], "left")


def folded(entries: DataFrame, depth: int) -> DataFrame:
    """Entries (flow, path, does) folded into their ancestor at ``depth``: its path, and all that is done there or below."""
    top = F.array_join(F.slice(F.split("path", r"\."), 1, depth), ".")
    return entries.groupBy("flow", top.alias("path")).agg(F.array_sort(F.collect_set("does")).alias("does"), F.count("*").alias("entries"))


def fan_in(calls: DataFrame, least: int = 3) -> DataFrame:
    """(callee, callers): functions with at least ``least`` distinct callers."""
    return calls.groupBy("callee").agg(F.count_distinct("caller").alias("callers")).where(F.col("callers") >= least)
