"""Traces against a plain depth-first walk on random graphs with cycles; interceptors, steps, gaps and outlines."""

import random

import pytest
from pyspark.sql import functions as F

from graphlake.operators import traces


def walk(graph, roots, closed=()):
    """(path, symbol, repeat, recursive) as a plain walk lists them."""
    out, expanded = [], set()

    def visit(symbol, path, above):
        calls = graph.get(symbol, [])
        seen = symbol in expanded
        out.append((path, symbol, symbol not in above and seen and bool(calls), symbol in above))
        if symbol in above or seen or symbol in closed:
            return
        expanded.add(symbol)
        for n, callee in enumerate(calls, 1):
            visit(callee, f"{path}.{n}", above | {symbol})

    for n, root in enumerate(roots, 1):
        visit(root, str(n), frozenset())
    return out


@pytest.mark.parametrize("per_flow", [True, False])
def test_equal_to_a_walk_on_random_graphs(spark, per_flow):
    rng = random.Random(4 + per_flow)
    calls, roots, want = [], [], []
    shared = {}
    closed = {"s3", "s7"}
    for flow in range(25):
        graph = {} if per_flow else shared
        if per_flow or not graph:
            for _ in range(rng.randrange(5, 45)):
                a, b = f"s{rng.randrange(14)}", f"s{rng.randrange(14)}"
                graph.setdefault(a, []).append(b)
            for a, callees in graph.items():
                calls += [((flow, a, b, n) if per_flow else (a, b, n)) for n, b in enumerate(callees)]
        own = [f"s{rng.randrange(14)}" for _ in range(rng.randrange(1, 4))]
        roots += [(flow, s, n) for n, s in enumerate(own)]
        want += [(flow, *x) for x in walk(graph, own, closed)]
    rng.shuffle(calls)
    table = spark.createDataFrame(calls, ("flow int, " if per_flow else "") + "caller string, callee string, ord int")
    starts = spark.createDataFrame(roots + [(None, "s1", 0)], "flow int, symbol string, ord int")
    got = traces.depth_first(table, starts, spark.createDataFrame([(s,) for s in closed], "symbol string"), compact_every=2, few=20)
    assert sorted((r.flow, r.path, r.symbol, r.repeat, r.recursive) for r in got.collect()) == sorted(want)
    assert all(r.depth == r.path.count(".") + 1 for r in got.collect())


def test_a_flow_of_very_many_entries(spark):
    calls = spark.range(60_000).select(F.lit("a").alias("caller"), F.concat(F.lit("m"), F.col("id") % 300).alias("callee"), F.col("id").alias("ord")).where("ord < 300")
    leaves = spark.range(60_000).select(F.concat(F.lit("m"), F.col("id") % 300).alias("caller"), F.concat(F.lit("leaf"), F.col("id") % 7).alias("callee"), F.col("id").alias("ord"))
    got = traces.depth_first(calls.unionByName(leaves), spark.createDataFrame([(1, "a")], "flow int, symbol string"))
    # 1 and 300 and 60,000 entries; a leaf calls nothing, so it is never a repeat
    assert got.agg(F.count("*"), F.count_if("repeat"), F.max("depth")).first() == (60_301, 0, 3)


def test_nothing_in_nothing_out(spark):
    calls = spark.createDataFrame([], "caller string, callee string, ord int")
    assert traces.depth_first(calls, spark.createDataFrame([], "flow int, symbol string")).count() == 0
    alone = traces.depth_first(calls, spark.createDataFrame([(1, "a")], "flow int, symbol string")).collect()
    assert [(r.path, r.symbol, r.repeat, r.recursive, r.first) for r in alone] == [("1", "a", False, False, True)]


def test_interceptors_run_first(spark):
    entries = spark.createDataFrame([(1, "app", "h", ["HttpEndpoint"], ["Order"]), (2, "app", "j", ["Topic"], ["Order"]), (3, "other", "k", ["HttpEndpoint"], None)], "flow int, application string, handler string, labels array<string>, validated array<string>")
    known = [("z.log", "app", "filter", True, None), ("a.aspect", "app", "aspect", True, None), ("v", "app", "validator", False, "Order"), ("w", "app", "validator", False, "User"), ("b.filter", "app", "filter", True, None)]
    interceptors = spark.createDataFrame(known, "symbol string, application string, kind string, http boolean, validates string")
    roots = traces.with_interceptors(entries, interceptors)
    calls = spark.createDataFrame([("h", "u", 1), ("h", "z.log", 2), ("v", "u", 1), ("z.log", "x", 1)], "caller string, callee string, ord int")
    got = traces.depth_first(calls, roots)
    rows = sorted((r.flow, [int(n) for n in r.path.split(".")], r.symbol, r.repeat, r.interceptor) for r in got.collect())
    assert rows == [
        (1, [1], "b.filter", False, "filter"), (1, [2], "z.log", False, "filter"), (1, [2, 1], "x", False, None), (1, [3], "a.aspect", False, "aspect"), (1, [4], "v", False, "validator"), (1, [4, 1], "u", False, None),
        (1, [5], "h", False, None), (1, [5, 1], "u", False, None), (1, [5, 2], "z.log", True, None), (2, [1], "j", False, None), (3, [1], "k", False, None),
    ]


def test_steps_gaps_outline_and_assembly(spark):
    calls = spark.createDataFrame([("a", "u", 1), ("a", "b", 2), ("b", "u", 1), ("b", "c", 2), ("a", "b", 3), ("c", "a", 1)], "caller string, callee string, ord int")
    closed = spark.createDataFrame([("u",)], "symbol string")
    unresolved = [("u", 3, "readAll", "unknown"), ("u", 1, "helper", "unknown"), ("c", 2, "map", "unknown"), ("b", 9, "map", "library type")]
    gaps = traces.kept_gaps(spark.createDataFrame(unresolved, "symbol string, line int, method string, reason string"), spark.createDataFrame([("helper",)], "name string"), ("read", "write"))
    significant = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    entries = traces.dressed(traces.depth_first(calls, spark.createDataFrame([(1, "a")], "flow int, symbol string"), closed), significant, gaps, closed)
    rows = {r.path: (r.symbol, r.step, r.gaps, r.repeat, r.recursive) for r in entries.collect()}
    lost = ["helper (unknown)", "readAll (unknown)"]
    assert rows == {
        "1": ("a", 1, None, False, False), "1.1": ("u", None, lost, False, False), "1.2": ("b", 1, ["map (library type)"], False, False), "1.2.1": ("u", None, lost, False, False),
        "1.2.2": ("c", 1, None, False, False), "1.2.2.1": ("a", 2, None, False, True), "1.3": ("b", 2, None, True, False),
    }
    one = traces.assembled(entries).first()
    assert (one.functions, one.steps, one.entries, one.unresolved, one.incomplete, one.symbols) == (4, 5, 7, 5, True, ["a", "b", "c", "u"])
    shown = entries.select("flow", "path", F.col("step").isNotNull().alias("shown"))
    assert {r.path: r.number for r in traces.outlined(shown).collect()} == {"1": "1", "1.2": "1.1", "1.2.2": "1.1.1", "1.2.2.1": "1.1.1.1", "1.3": "1.2"}
    # numbers go by the number, not by the letter
    wide = spark.createDataFrame([(1, f"1.{n}", True) for n in range(1, 13)] + [(1, "1", False)], "flow int, path string, shown boolean")
    assert {r.path: r.number for r in traces.outlined(wide).collect()} == {f"1.{n}": str(n) for n in range(1, 13)}


def test_shared_calls_are_walked_once_for_each_root(spark, monkeypatch):
    begun = []
    walked = traces._smallest_paths
    monkeypatch.setattr(traces, "_smallest_paths", lambda scratch, edges, starts, *rest: begun.append(starts.count()) or walked(scratch, edges, starts, *rest))
    calls = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("i", "b", 1)], "caller string, callee string, ord int")
    roots = spark.range(500).selectExpr("id as flow", "explode(array(named_struct('symbol', 'i', 'ord', 0), named_struct('symbol', 'a', 'ord', 1))) as r").select("flow", "r.*")
    got = traces.depth_first(calls, roots)
    assert begun == [2]
    rows = {(r.path, r.symbol, r.repeat, r.recursive, r.n) for r in got.groupBy("path", "symbol", "repeat", "recursive").agg(F.count("*").alias("n")).collect()}
    assert rows == {(p, s, repeat, recursive, 500) for p, s, repeat, recursive in [("1", "i", False, False), ("1.1", "b", False, False), ("1.1.1", "c", False, False), ("1.1.1.1", "a", False, False), ("1.1.1.1.1", "b", False, True), ("2", "a", True, False)]}
