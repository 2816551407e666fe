"""Flows that share calls: what they have in common is listed once, and the results are those of every flow by itself."""

import random

import pytest
from pyspark.sql import functions as F
from test_traces import walk

from graphlake.operators import traces


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def flows(spark):
    """Calls with circles, closed functions, sixty flows of one to four roots, many of them alike, and what a plain walk lists of each."""
    rng = random.Random(11)
    graph = {}
    for _ in range(26):
        graph.setdefault(f"s{rng.randrange(14)}", []).append(f"s{rng.randrange(14)}")
    calls = spark.createDataFrame([(a, b, n) for a, callees in graph.items() for n, b in enumerate(callees)], "caller string, callee string, ord int")
    heads = [[], ["s1"], ["s4", "s2"], ["s9", "s1", "s5"]]
    roots = {flow: [*rng.choice(heads), f"s{rng.randrange(4)}"] for flow in range(60)}
    starts = spark.createDataFrame([(flow, s, n, "filter" if n + 1 < len(own) else None) for flow, own in roots.items() for n, s in enumerate(own)], "flow long, symbol string, ord int, interceptor string")
    closed = spark.createDataFrame([("s3",), ("s7",)], "symbol string")
    return calls, starts, closed, sorted(((flow, *entry) for flow, own in roots.items() for entry in walk(graph, own, {"s3", "s7"})), key=str)


@pytest.mark.parametrize("most", [500_000, 3])
def test_flows_of_parts_are_those_of_a_plain_walk(spark, monkeypatch, flows, most):
    calls, starts, closed, want = flows
    for name, value in (("WALK", most), ("CHUNK", 4), ("BLOCK", 3)):
        monkeypatch.setattr(traces, name, value)
    got = traces.depth_first(calls, starts, closed)
    assert rows(got, "flow", "path", "symbol", "repeat", "recursive") == want
    # few of many functions are walked: their reach goes on call by call
    few = starts.where("flow < 2 and symbol = 's1'")
    assert rows(traces.depth_first(calls, few, closed), "flow", "path", "symbol") == sorted({(f, p, s) for f, p, s in rows(traces.depth_first(calls, starts.where("symbol = 's1'"), closed), "flow", "path", "symbol") if f < 2}, key=str)


def test_outlines_of_parts(spark, flows):
    calls, starts, closed, want = flows
    significant = spark.createDataFrame([(f"s{n}",) for n in range(0, 14, 2)], "symbol string").withColumn("shown", F.lit(True))
    heads, tails, members = traces.shared(calls, starts, closed)
    shown = lambda entries: entries.join(significant, "symbol", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    got = rows(traces.of_flows(traces.outlined_parts(shown(heads), shown(tails), members), members), "flow", "path", "parent", "number")
    each = []
    for flow in range(60):
        places = {}
        for path in sorted((p for f, p, s, *_ in want if f == flow and int(s[1:]) % 2 == 0), key=lambda p: [int(n) for n in p.split(".")]):
            parent = next((up for n in range(path.count("."), 0, -1) if (up := ".".join(path.split(".")[:n])) in places), None)
            count = sum(1 for _, up in places.values() if up == parent) + 1
            places[path] = (f"{places[parent][0]}.{count}" if parent else str(count), parent)
        each += [(flow, path, parent, number) for path, (number, parent) in places.items()]
    assert got == sorted(each, key=str)


def test_steps_and_sums_of_parts(spark, flows):
    calls, starts, closed, _ = flows
    significant = spark.createDataFrame([(f"s{n}",) for n in range(0, 14, 2)], "symbol string")
    gaps = spark.createDataFrame([(f"s{n}", ["x (y)"] * (n % 3 + 1)) for n in range(0, 14, 3)], "symbol string, gaps array<string>")
    heads, tails, members = traces.shared(calls, starts, closed)
    parts = traces.dressed(heads.unionByName(tails), significant, gaps, closed)
    plain = traces.dressed(traces.depth_first(calls, starts, closed), significant, gaps, closed)
    columns = ["flow", "path", "depth", "symbol", "repeat", "recursive", "first", "interceptor", "utility", "step", "gaps"]
    assert rows(traces.of_flows(parts, members), *columns) == rows(plain, *columns)
    sums = ["flow", "functions", "steps", "entries", "interceptors", "unresolved", "incomplete", "symbols"]
    assert rows(traces.assembled_parts(parts, members), *sums) == rows(traces.assembled(plain), *sums)


def test_what_flows_have_in_common_is_listed_once(spark):
    calls = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("i", "b", 1), ("i", "d", 2)], "caller string, callee string, ord int")
    roots = spark.range(500).selectExpr("id as flow", "inline(array(struct('i' as symbol, 0 as ord), struct(if(id % 2 = 0, 'a', 'c') as symbol, 1 as ord)))")
    heads, tails, members = traces.shared(calls, roots)
    # i, b, c and d; then a and b, or c alone
    assert (heads.count(), tails.count(), members.count()) == (4, 3, 500)
    assert traces.of_flows(heads.unionByName(tails), members).count() == 500 * 4 + 250 * 2 + 250
