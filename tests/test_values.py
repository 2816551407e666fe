"""Passed functions, clients, query texts and answers cut to a budget, against plain definitions."""

import json
import random

from pyspark.sql import functions as F

from graphlake.operators import dependents, graph, query_texts, ranking, values
from graphlake.scratch import Scratch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_functions_go_through_parameters_and_circles(spark):
    passes = [
        ("main", "register", "fn", "search", None, 3), ("main", "register", "fn", "grep", None, 4), ("wrap", "register", "fn", None, "f", 9), ("outer", "wrap", "f", None, "g", 1), ("tool", "outer", "g", "read", None, 2),
        ("a", "b", "p", None, "p", 1), ("b", "a", "p", None, "p", 1), ("c", "b", "p", "late", None, 7), ("x", "register", "other", "no", None, 1), (None, "lonely", "fn", None, None, 1),
    ]
    given = spark.createDataFrame(passes, "caller string, callee string, parameter string, function string, own string, line int")
    wanted = spark.createDataFrame([("e1", "register", "fn"), ("e2", "a", "p"), ("e3", "lonely", "fn"), ("e4", "nobody", "q")], "edge string, helper string, parameter string")
    found, lost = values.passed_functions(wanted, given)
    assert rows(found) == [("e1", "main", "grep", 4), ("e1", "main", "search", 3), ("e1", "tool", "read", 2), ("e2", "c", "late", 7)]
    assert [r[0] for r in rows(lost)] == ["e3", "e4"] and "'q'" in rows(lost)[1][3]
    assert values.passed_functions(wanted.limit(0), given)[0].count() == 0


def test_what_is_lost_is_told_without_rows_for_each_edge(spark, monkeypatch):
    written = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: written.append(df.columns) or keep(self, df, name))
    passes = spark.createDataFrame([("b", "a", "p", None, "q", 1), ("c", "b", "q", None, "p", 2), ("b", "c", "p", None, "q", 3), ("d", "c", "p", "named", None, 4), ("y", "x", "p", None, "p", 5)], "caller string, callee string, parameter string, function string, own string, line int")
    wanted = spark.range(300).selectExpr("concat('e', id) as edge", "if(id % 3 = 0, 'x', 'a') as helper", "'p' as parameter")
    lost = values.unknown_functions(wanted, passes)
    assert sorted(r.edge for r in lost.collect()) == sorted(f"e{n}" for n in range(0, 300, 3))
    assert written and not any("edge" in columns for columns in written)


def test_clients(spark):
    ancestry = graph.ancestors(spark.createDataFrame([("MyIndex", "Index"), ("Deep", "MyIndex")], "node string, parent string"))
    clients = spark.createDataFrame([("k1", "Index", "store:v", False, None, None), ("k2", "Llm", "ext:chat", True, None, ["BaseLlm"]), ("k3", "Api", "x", False, "http://h/", ["BaseLlm"])], "client string, class string, target string, external boolean, base string, extends array<string>")
    methods = spark.createDataFrame([("k1", "query", None, None, "read"), ("k1", "add", None, None, "write"), ("k3", "get", None, "/u/{id}", None)], "client string, method string, verb string, path string, operation string")
    calls = [("f", "Deep", "query", 1), ("f", "Index", "add", 2), ("f", "Index", "close", 3), ("g", "BaseLlm", "chat", 4), ("g", "BaseLlm", "get", 5), ("h", "Api", "get", 6), ("h", "Api", "other", 7), ("h", "Nobody", "get", 8)]
    got = values.client_calls(spark.createDataFrame(calls, "function string, receiver string, method string, line int"), ancestry, clients, methods)
    assert sorted(((r.line, r.type, r.method, r.target, r.candidate, r.ambiguous) for r in got.collect()), key=str) == [
        (1, "READS_FROM", None, "store:v", False, False), (2, "WRITES_TO", None, "store:v", False, False), (4, "CALLS", None, "ext:chat", True, True),
        (5, "CALLS", "GET", "http://h/u/{id}", True, True), (5, "CALLS", None, "ext:chat", True, True), (6, "CALLS", "GET", "http://h/u/{id}", False, False),
    ]


def test_query_texts(spark):
    mapped = spark.createDataFrame([("com.Category", "category"), ("com.ValidTime", "category_vt"), ("com.Order", "orders")], "entity string, table string")
    relations = spark.createDataFrame([("com.Category", "validTimes", "com.ValidTime"), ("com.ValidTime", "order", "com.Order"), ("com.Order", "ghost", "com.Ghost")], "entity string, field string, target string")
    texts = {
        "a": ("select c from Category c join fetch c.validTimes vt left join vt.order", False),
        "b": ("UPDATE Order o set o.x = 1 where o.id in (select v.id from ValidTime v)", False),
        "c": ("delete from other.Log l", True),
        "d": ("select x from Unknown u join u.validTimes", False),
        "e": ("select x from Order o join o.ghost g join g.more", False),
        "f": ("select x from Category c where exists (select 1 from Order c join c.ghost) and 1 = (select 2 from Unknown c join c.ghost)", False),
        "g": ("", False), "h": (None, False), "i": ("insert into a.b select * from c join d on 1 = 1 join a.b on 2 = 2", True),
    }
    found, lost = query_texts.tables(spark.createDataFrame([(k, *v) for k, v in texts.items()], "symbol string, query string, native boolean"), mapped, relations)
    assert rows(found) == sorted(
        [
            ("a", "category", "READS_FROM", "select"), ("a", "category_vt", "READS_FROM", "select"), ("a", "orders", "READS_FROM", "select"), ("b", "orders", "WRITES_TO", "update"), ("b", "category_vt", "READS_FROM", "select"),
            ("c", "Log", "WRITES_TO", "delete"), ("e", "orders", "READS_FROM", "select"), ("f", "category", "READS_FROM", "select"), ("f", "orders", "READS_FROM", "select"),
            ("i", "b", "WRITES_TO", "insert"), ("i", "c", "READS_FROM", "select"), ("i", "d", "READS_FROM", "select"),
        ], key=str,
    )
    dropped = {(r.symbol, r.name, r.reason) for r in lost.collect()}
    assert dropped == {("d", "Unknown", "no entity"), ("d", "u.validTimes", "no entity"), ("e", "o.ghost", "not a mapped entity"), ("e", "g.more", "no entity"), ("f", "c.ghost", "not a mapped entity"), ("f", "Unknown", "no entity")}
    assert query_texts.tables(spark.createDataFrame([], "symbol string, query string, native boolean"), mapped, relations)[0].count() == 0


def cut_in_a_loop(lists, budget, fixed):
    """Items taken off one by one, the size counted anew each time."""
    lists = {k: [[own, list(inner)] for own, inner in items] for k, items in lists.items()}
    size = lambda items: sum(own + sum(inner) for own, inner in items)
    total, cut = (lambda: fixed + sum(map(size, lists.values()))), {}
    while total() > budget and len(lists.get("citations", [])) > 3:
        lists["citations"].pop()
        cut["citations"] = cut.get("citations", 0) + 1
    while total() > budget and any(len(v) > 1 for v in lists.values()):
        key = max((k for k in lists if len(lists[k]) > 1), key=lambda k: size(lists[k]))
        lists[key].pop()
        cut[key] = cut.get(key, 0) + 1
    for key, items in lists.items():
        for _, inner in items:
            while total() > budget and len(inner) > 1:
                inner.pop()
                cut[f"{key}.rows"] = cut.get(f"{key}.rows", 0) + 1
    return cut


def test_cut_equals_the_loop(spark):
    rng = random.Random(12)
    want, items, inner, n = {}, [], [], 0
    for answer in range(60):
        lists = {}
        for place, name in enumerate(["flows", "citations", "uses"], 1):
            for _ in range(rng.choice([0, 1, 2, 9])):
                n += 1
                rows_inside = [rng.randrange(5, 40) for _ in range(rng.choice([0, 0, 1, 5]))]
                own = rng.randrange(5, 60)
                lists.setdefault(name, []).append((own, rows_inside))
                items.append((answer, name, place, n, own))
                inner += [(n, "rows", i, b) for i, b in enumerate(rows_inside)]
        want[answer] = cut_in_a_loop(lists, 300, 20)
    got = ranking.cut_to_budget(spark.createDataFrame(items, "answer int, list string, place int, item int, bytes int"), spark.createDataFrame(inner, "item int, inner string, order int, bytes int"), 20, 300)
    found = {}
    for r in got.collect():
        found.setdefault(r.answer, {})[r.what] = r.cut
    assert found == {a: c for a, c in want.items() if c} and len(json.dumps(found)) > 500


def test_callers_by_the_end_of_their_path(spark):
    calls = spark.createDataFrame([(1, "post", "/v1/api/suggestion"), (2, "POST", "/suggestion"), (3, "GET", "/suggestion"), (4, "POST", "/my-suggestion"), (5, "POST", "/"), (6, None, "/suggestion"), (7, "POST", "")], "call int, method string, shape string")
    ends = spark.createDataFrame([(10, "POST", "/suggestion"), (11, "POST", "/"), (12, "POST", "/api/suggestion")], "endpoint int, method string, shape string")
    assert rows(dependents.possible_callers(calls, ends)) == [(1, 10, False), (1, 12, False), (2, 10, True), (5, 11, True)]


def test_call_sites(spark):
    found = spark.createDataFrame([(1, 1, "W", 10), (2, 2, "R", 10)], "flow int, hops int, type string, target int")
    effects = spark.createDataFrame([(1, "W", 10, "save", "a.py", 5, ["12 upsert", "30"]), (2, "R", 10, None, "b.py", 7, None), (2, "R", 11, None, "b.py", 8, [])], "flow int, type string, target int, operation string, file string, line int, sites array<string>")
    got = dependents.by_call_site(found, effects)
    assert rows(got) == [(1, 1, "W", 10, "save", "a.py", 30), (1, 1, "W", 10, "upsert", "a.py", 12), (2, 2, "R", 10, None, "b.py", 7)]
    assert got.where(F.col("line").isNull()).count() == 0


def test_sums_of_passed_functions_without_their_rows(spark, monkeypatch):
    rng = random.Random(8)
    pick = lambda n, lead: f"{lead}{rng.randrange(n)}"
    # circles of any length, calls of one line named at several parameters, what is not known, edges that want several or nothing
    given = [(rng.choice([pick(12, "p"), None]), pick(12, "p"), pick(3, "a"), *rng.choice([(pick(5, "f"), None), (None, pick(3, "a")), (None, None)]), rng.choice([rng.randrange(4), None])) for _ in range(160)]
    passes = spark.createDataFrame([*given, ("p0", "p0", "a0", None, "a0", 1), (None, None, "a1", "f1", None, 1), ("p1", "p2", None, "f1", None, 1)], "caller string, callee string, parameter string, function string, own string, line int")
    wanted = spark.createDataFrame([(pick(30, "e"), pick(14, "p"), pick(4, "a")) for _ in range(50)] + [("e1", None, "a0"), (None, "p1", "a1")], "edge string, helper string, parameter string")
    plain = values.found_functions(wanted, passes).groupBy("edge").agg(F.count("*").alias("calls"), F.count_distinct("caller").alias("callers"), F.count_distinct("function").alias("functions"), F.min("function").alias("first"), F.max("line").alias("line"))
    got = values.found_sums(wanted, passes, items=3)
    assert rows(got) == rows(plain) and got.count() > 10
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in text and "RepartitionByExpression [start" in text
    # a chain: a hop compares with the two before it, and with all of them in every eighth only
    read = []
    kept = graph.Scratch.keep_counted
    monkeypatch.setattr(graph.Scratch, "keep_counted", lambda self, df, name: read.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")) or kept(self, df, name))
    chain = spark.range(20).selectExpr("id as src", "if(id = 19, 0, id + 1) as dst")
    reached = graph.reach_each(spark.createDataFrame([("x", 0), ("x", 0), ("y", 15), (None, 3)], "start string, node long"), chain)
    assert rows(reached) == rows(spark.range(20).selectExpr("explode(array('x', 'y')) as start", "id as node"))
    assert max(n for hop, n in enumerate(read) if hop % 8) <= 4 < max(read)
