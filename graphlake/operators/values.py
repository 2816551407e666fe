"""Values that calls carry: functions passed through parameters, clients of libraries and what calls of them reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import graph


def passed_functions(wanted: DataFrame, passes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to "whatever function parameter p of a helper holds", resolved, and those for which none is known.

    ``wanted`` is (edge, helper, parameter); ``passes`` (caller, callee, parameter, function, own, line): a call that gives the
    callee's parameter a function, or the caller's own parameter.  Found is (edge, caller, function, line): a row for each
    call that passes a function by name, however many parameters it goes through; lost is (edge, helper, parameter, reason).
    """
    return found_functions(wanted, passes), unknown_functions(wanted, passes)


def _given(passes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that fill a callee's parameter with a function, and parameters (helper, parameter) that are filled from others (caller, own), each once."""
    given = passes.where("callee is not null and parameter is not null").select("caller", F.col("callee").alias("helper"), "parameter", "function", "own", "line")
    through = given.where("function is null").select("helper", "parameter", "caller", "own").dropna().distinct()
    return given.where("function is not null").select("helper", "parameter", "caller", "function", "line").distinct(), through


def _node(helper: str, parameter: str) -> Column:
    return F.struct(F.col(helper).alias("helper"), F.col(parameter).alias("parameter"))


def found_functions(wanted: DataFrame, passes: DataFrame) -> DataFrame:
    """The first table of ``passed_functions``, dealt by edge: what groups by edge needs no other exchange.

    A parameter that receives a parameter of its caller makes that one wanted too.
    """
    named, through = _given(passes)
    every = graph.reach_each(wanted.select(F.col("edge").alias("start"), _node("helper", "parameter").alias("node")), through.select(_node("helper", "parameter").alias("src"), _node("caller", "own").alias("dst")))
    found = named.select(_node("helper", "parameter").alias("node"), "caller", "function", "line").join(every, "node")
    return found.select(F.col("start").alias("edge"), "caller", "function", "line").repartition("edge").distinct()


#: Edges whose items one task makes distinct.
EDGES_PER_TASK = 5000
#: Kinds of items that are counted for each edge, the values of which are numbers: what is told of a parameter as a whole, a call named at several, a caller, a function.
_WHOLE, _CALL, _CALLER, _FUNCTION = range(4)


def found_sums(wanted: DataFrame, passes: DataFrame, items: int = 64) -> DataFrame:
    """(edge, calls, callers, functions, first, line): sums of ``found_functions`` for each edge, whose rows are not made.

    Parameters, callers and functions are numbered, functions in their order. A call that is named at one parameter counts with that; only those named at several are told
    apart. An edge is met by each parameter that it wants with lists of at most ``items`` numbers, which are made distinct once they are dealt by edge.
    """
    scratch = Scratch(wanted.sparkSession, "found")
    named, through = _given(passes)
    named, through = scratch.keep(named, "named"), scratch.keep(through, "through")
    number = F.monotonically_increasing_id()
    places = wanted.select("helper", "parameter").unionByName(named.select("helper", "parameter")).unionByName(through.select("helper", "parameter")).unionByName(through.select(F.col("caller").alias("helper"), F.col("own").alias("parameter")))
    nodes = scratch.keep(places.dropna().distinct().withColumn("node", number), "nodes")
    edges, n = scratch.keep_counted(wanted.select("edge").dropna().distinct().withColumn("start", number), "edges")
    callers = scratch.keep(named.select("caller").dropna().distinct().withColumn("by", number), "callers")
    functions = scratch.keep(named.select("function").distinct().orderBy("function").withColumn("number", number), "functions")

    starts = wanted.join(nodes, ["helper", "parameter"]).join(edges, "edge").select("start", "node")
    links = through.join(nodes.withColumnRenamed("node", "src"), ["helper", "parameter"]).join(nodes.select(F.col("helper").alias("caller"), F.col("parameter").alias("own"), F.col("node").alias("dst")), ["caller", "own"])
    every = graph.reach_each(starts, links.select("src", "dst"))

    told = named.join(nodes, ["helper", "parameter"]).join(functions, "function").join(callers, "caller", "left").select("node", "by", "number", "line")
    # a call is named once at a parameter; one that is named at several is counted apart
    told = scratch.keep(told, "told")
    several = told.groupBy("by", "number", "line").agg(F.count("*").alias("n")).where("n > 1").select(F.col("by").alias("of"), F.col("number").alias("gives"), F.col("line").alias("at"), number.alias("call"))
    several = scratch.keep(several, "several")
    each = told.join(several, F.col("by").eqNullSafe(F.col("of")) & (F.col("number") == F.col("gives")) & F.col("line").eqNullSafe(F.col("at")), "left")
    item = lambda value, kind: value * 4 + kind
    kinds = F.array_compact(F.array(F.lit(_WHOLE).cast("long"), item(F.col("by"), _CALLER), item(F.col("number"), _FUNCTION), item(F.col("call"), _CALL)))
    sums = each.groupBy("node").agg(F.count_if(F.col("call").isNull()).alias("calls"), F.max("line").alias("line"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("item"))
    lists = each.select("node", F.explode(kinds).alias("item")).distinct().withColumn("list", F.floor((place - 1) / items)).groupBy("node", "list").agg(F.collect_list("item").alias("items"))
    lists = scratch.keep(lists.join(sums, "node").drop("list"), "lists")

    met = every.join(lists, "node").select("start", "calls", "line", "items").repartition(max(-(-n // EDGES_PER_TASK), 1), "start").select("start", "calls", "line", F.explode("items").alias("item"))
    whole = F.col("item") == _WHOLE
    distinct = met.groupBy("start", "item").agg(F.sum(F.when(whole, F.col("calls"))).alias("calls"), F.max(F.when(whole, F.col("line"))).alias("line"))
    of = lambda kind: F.col("item") % 4 == kind
    out = distinct.groupBy("start").agg(
        (F.coalesce(F.sum("calls"), F.lit(0)) + F.count_if(of(_CALL))).alias("calls"), F.count_if(of(_CALLER)).alias("callers"), F.count_if(of(_FUNCTION)).alias("functions"),
        F.min(F.when(of(_FUNCTION), F.shiftright("item", 2))).alias("number"), F.max("line").alias("line"),
    )
    return out.join(edges, "start").join(functions, "number").select("edge", "calls", "callers", "functions", F.col("function").alias("first"), "line")


def unknown_functions(wanted: DataFrame, passes: DataFrame) -> DataFrame:
    """The second table of ``passed_functions``.

    Parameters that are known to hold a function are followed to those that they fill, each once for all
    edges that want it; an edge is lost if none of what it wants is met.
    """
    named, through = _given(passes)
    filled = through.select(_node("helper", "parameter").alias("src"), _node("caller", "own").alias("dst"))
    known = graph.reach(filled, named.select(_node("helper", "parameter").alias("node")), reverse=True).select("node.*")
    resolved = wanted.join(known, ["helper", "parameter"], "left_semi").select("edge").distinct()
    reason = F.concat(F.lit("function passed as '"), F.col("parameter"), F.lit("' isn't known at any call site"))
    return wanted.join(resolved, "edge", "left_anti").select("edge", "helper", "parameter", reason.alias("reason"))


def client_calls(calls: DataFrame, ancestry: DataFrame, clients: DataFrame, methods: DataFrame) -> DataFrame:
    """(function, line, client, type, method, target, candidate, ambiguous): what calls on clients of libraries reach.

    ``calls`` is (function, receiver, method, line), ``ancestry`` (node, ancestor) with each type its own ancestor, ``clients``
    (client, class, target, external, base, extends), ``methods`` (client, method, verb, path, operation).  A receiver that is a client's class or
    below it is that client.  One that is only a base that clients name in ``extends`` may be any of them:
    a candidate, and ambiguous if they are several.  A method with a path is an
    HTTP call of base and path; a client that has such methods has no others; a call of an external
    system is a call; another client's method reads or writes as its operation says, or counts for nothing.

    What a call reaches depends on its receiver and method alone.  It is found once for each pair of them, and calls meet
    the pairs: no call is repeated for the types above its receiver, nor are rows of calls and clients written or compared.
    """
    scratch = Scratch(calls.sparkSession, "clients")
    named = clients.select("client", "class", "target", "external", "base", "extends")
    asked = scratch.keep(calls.where("receiver is not null").select("receiver", F.col("method").alias("called")).distinct(), "asked")
    receivers = asked.select("receiver").distinct()
    above = receivers.join(ancestry.select(F.col("node").alias("receiver"), F.col("ancestor").alias("class")), "receiver").unionByName(receivers.withColumn("class", F.col("receiver")))
    sure = scratch.keep(above.distinct().join(named.drop("extends"), "class").select("receiver", "client", "target", "external", "base").distinct().withColumns({"candidate": F.lit(False), "ambiguous": F.lit(False)}), "sure")
    bases = named.select("client", "target", "external", "base", F.explode("extends").alias("receiver")).distinct()
    several = bases.groupBy("receiver").agg((F.count_distinct("client") > 1).alias("ambiguous"))
    maybe = receivers.join(sure.select("receiver"), "receiver", "left_anti").join(bases, "receiver").join(several, "receiver").withColumn("candidate", F.lit(True))
    met = asked.join(sure.unionByName(maybe.select(*sure.columns)), "receiver")

    spec = methods.select("client", F.col("method").alias("called"), "verb", "path", "operation")
    mapped = methods.where("path is not null").select("client", F.lit(True).alias("mapped")).distinct()
    told = met.join(spec, ["client", "called"], "left").join(mapped, "client", "left")
    base, path = F.nullif("base", F.lit("")), F.nullif("path", F.lit(""))
    url = F.coalesce(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/"))), base, path)
    effect = F.when(F.col("external"), "CALLS").when(F.col("operation") == "read", "READS_FROM").when(F.col("operation") == "write", "WRITES_TO")
    kind = F.when(F.col("path").isNotNull(), "CALLS").when(F.col("mapped").isNull(), effect)
    out = told.select(F.col("receiver").alias("to"), "called", "client", kind.alias("type"), F.when(F.col("path").isNotNull(), F.upper(F.coalesce("verb", F.lit("GET")))).alias("method"), F.when(F.col("path").isNotNull(), url).otherwise(F.col("target")).alias("target"), "candidate", "ambiguous")
    reached = scratch.keep(out.where("type is not null"), "reached")
    made = calls.select("function", "line", F.col("receiver").alias("to"), F.col("method").alias("by")).distinct()
    return made.join(reached, (made["to"] == reached["to"]) & made["by"].eqNullSafe(reached["called"])).select("function", "line", "client", "type", "method", "target", "candidate", "ambiguous")


def touched_fields(members: DataFrame, relations: DataFrame) -> DataFrame:
    """(function, field): relations, as ``entity.field``, that a function reads or sets through accessors (function, member).

    ``getX``, ``setX``, ``addX`` and ``isX`` are accessors of ``x``; a builder nested in an entity is the entity's.
    """
    owner, name = F.substring_index("member", "#", 1), F.substring_index(F.substring_index("member", "#", -1), "(", 1)
    bare = F.regexp_extract(name, r"^(?:get|set|add|is)(\p{Lu}.*)$", 1)
    field = F.when(bare != "", F.concat(F.lower(F.left(bare, F.lit(1))), F.substring(bare, 2, 1 << 30))).otherwise(name)
    nested = owner.endswith("Builder") & owner.contains(".")
    entity = F.when(nested, F.regexp_replace(owner, r"\.[^.]*$", "")).otherwise(owner)
    read = members.where(F.col("member").contains("#")).select("function", entity.alias("entity"), field.alias("field")).distinct()
    return read.join(relations.select("entity", "field").distinct(), ["entity", "field"], "left_semi").select("function", F.concat_ws(".", "entity", "field").alias("field"))
