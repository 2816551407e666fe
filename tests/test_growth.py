"""Steps whose memory or time must not grow faster than their input."""

import os
import random
import re

import pytest

from graphlake.operators import assembly, graph, joins, query_texts, search, values
from graphlake.plans import answer_queries, model  # noqa: F401
from graphlake.plans.queries import QUERIES
from graphlake.scratch import Scratch

FOLDER = os.environ.get("GRAPHLAKE_SMALL_TABLES", "/root/testdata/sf0.001")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_of_the_same_lines_meet_points_once(spark):
    rng = random.Random(5)
    points = sorted({(rng.randrange(3), rng.randrange(300)) for _ in range(200)})
    ranges = [(rng.randrange(3), scope, first := rng.randrange(0, 300, 50), first + rng.randrange(0, 120, 40)) for scope in range(2000)]
    got = joins.innermost_range(spark.createDataFrame(points, "file int, line int"), spark.createDataFrame(ranges, "file int, scope int, first int, last int"), 64)
    want = {(f, n): min((last - first, scope) for file, scope, first, last in ranges if file == f and first <= n <= last) for f, n in points if any(file == f and first <= n <= last for file, _, first, last in ranges)}
    assert rows(got) == sorted(((*k, scope) for k, (_, scope) in want.items()), key=str)
    joined = plan(got).split("Join ", 1)[1]
    assert "Aggregate" in joined and "min(scope" in joined


def test_calls_are_not_repeated_for_the_types_above_them(spark, monkeypatch):
    kept = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.update({name: keep(self, df, name)}) or kept[name])
    ancestry = graph.ancestors(spark.createDataFrame([(f"t{n}", f"t{n // 2}") for n in range(2, 16)], "node string, parent string"))
    clients = spark.createDataFrame([(f"k{n}", f"t{n}", "x", True, "http://h/", ["base"]) for n in range(1, 16)], "client string, class string, target string, external boolean, base string, extends array<string>")
    methods = spark.createDataFrame([("k1", "m", None, "/p", None), ("k1", "m", "put", "/q", None)], "client string, method string, verb string, path string, operation string")
    calls = spark.range(2000).selectExpr("concat('f', id % 900) as function", "if(id % 10 = 0, 'base', if(id % 10 = 1, null, concat('t', id % 16))) as receiver", "if(id % 3 = 0, 'm', if(id % 3 = 1, 'other', null)) as method", "int(id % 5) as line")
    # a base reaches all clients; a type, the clients of itself and what is above it; k1 has two methods of one name and no others
    above = lambda r: range(1, 16) if r == "base" else [n for k in range(4) if (n := int(r[1:]) >> k)]
    want = []
    for c in {tuple(c) for c in calls.collect()}:
        for n in above(c[1]) if c[1] else []:
            told = [("CALLS", "GET", "http://h/p"), ("CALLS", "PUT", "http://h/q")] if n == 1 and c[2] == "m" else [] if n == 1 else [("CALLS", None, "x")]
            want += [(c[0], c[3], f"k{n}", *x, c[1] == "base", c[1] == "base") for x in told]
    assert rows(values.client_calls(calls, ancestry, clients, methods)) == sorted(want, key=str)
    assert all("function" not in df.columns for df in kept.values())
    assert {name: kept[name].count() for name in ("asked", "sure")} == {"asked": len({(r.receiver, r.method) for r in calls.collect() if r.receiver}), "sure": sum(len(above(r)) for r in {r.receiver for r in calls.collect()} if r and r != "base")}


def test_rows_of_bound_calls_come_by_implementation_in_bounded_tasks(spark):
    # 1,000 calls of 1, two of them not from a known caller, one of 2 and two of nothing; 1 has forty implementations and one that is not known
    calls = spark.createDataFrame([(n if n > 1 else None, 1) for n in range(1000)] + [(7, 2), (7, 3), (8, None)], "caller long, callee long")
    impl = spark.createDataFrame([(1, 100 + n % 40) for n in range(200)] + [(1, None), (2, 9), (None, 5)], "abstract long, concrete long")
    got = assembly.bound_calls(calls, impl, rows_per_task=10_000)
    want = [(n if n > 1 else None, c, True) for n in range(1000) for c in [1, *range(100, 140)]] + [(7, 9, False), (7, 3, False), (8, None, False)]
    assert got.columns == ["caller", "callee", "candidate"] and rows(got) == sorted(want, key=str)
    assert got.rdd.getNumPartitions() == 5
    callees = [r.callee for part in got.rdd.glom().collect() for r in part]
    assert sum(a != b for a, b in zip(callees, callees[1:])) <= len(callees) / 30


def test_sources_of_query_texts_are_never_broadcast(spark, monkeypatch):
    plans = []
    keep = Scratch.keep
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: plans.append(physical(df)) or keep(self, df, name))
    queries = spark.createDataFrame([(1, "select c from A c join c.items i join i.parts p", False), (2, "delete from A c where exists (select 1 from B c join c.parts q)", False), (3, "insert into s.log select * from s.x", True)], "symbol int, query string, native boolean")
    mapped = spark.createDataFrame([("com.A", "ta"), ("com.B", "tb")], "entity string, table string")
    relations = spark.createDataFrame([("com.A", "items", "com.B"), ("com.B", "parts", "com.A")], "entity string, field string, target string")
    touched, lost = query_texts.tables(queries, mapped, relations)
    got = rows(touched.select("symbol", "table", "type"))
    assert got == sorted([(1, "ta", "READS_FROM"), (1, "tb", "READS_FROM"), (2, "ta", "WRITES_TO"), (2, "tb", "READS_FROM"), (3, "log", "WRITES_TO"), (3, "x", "READS_FROM")], key=str)
    assert lost.isEmpty()
    assert len(plans) > 6 and any("SortMergeJoin" in p for p in plans)
    assert not re.search(r"Broadcast\w*Join \[symbol", "".join(plans))


@pytest.mark.parametrize("most", [100_000, 0])
def test_texts_are_split_twice_by_a_search_and_only_tokens_of_its_words_move(spark, monkeypatch, tmp_path, most):
    plans = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or keep(self, df, name))
    monkeypatch.setattr(search, "OTHERS_BROADCAST", most, raising=False)
    said = [(1, "a small widget here"), (2, "smlal widgets"), (3, "widegt"), (4, None), (5, "wigdte smell"), (6, "nothing 0123456789")]
    spark.createDataFrame(said, "doc int, said string").write.parquet(path := str(tmp_path / "texts"))
    got = search.search(search.index(spark.read.parquet(path), "doc", "said"), ["small", "widget"])
    assert rows(got.select("id", "score", "kept")) == [(1, 8, "small widget"), (2, 2, "small widget")]
    assert sum(len(re.findall(r"FileScan parquet \[[^\]]*said", p)) for p in plans.values()) == 2
    # what is not asked for is left out before any join moves it
    assert ("LeftOuter, BuildRight" in plans["matched"] and "other#" in plans["matched"]) == (most > 0)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", ["neighbours", "unique_items", "first_use", "resource_view"])
def test_rows_are_dealt_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr(model, "ROWS_PER_TASK", 500)
    got = QUERIES[name](spark, FOLDER)
    made = re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan(got))
    assert made and {int(n) for n in made} == {12}  # of 6,000 lines
    assert "Expand" not in plan(got)  # rows are not repeated for each thing that is counted
