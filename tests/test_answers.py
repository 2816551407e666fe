"""Operators of the answers on small tables: nulls, no rows, circles, depth."""

import pytest
from pyspark.sql import functions as F

from graphlake.operators import answers, assembly, dependents, graph, labels, routes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_ancestors_of_deep_trees_and_circles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "node int, parent int")
    got = graph.ancestors(chain).collect()
    assert {(r.node, r.ancestor, r.depth) for r in got} == {(i, j, i - j) for i in range(70) for j in range(i + 1)} and len(got) == 70 * 71 // 2
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 1)], "node int, parent int")
    assert rows(graph.ancestors(circle).where("depth > 0")) == sorted([(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2), (5, 1, 1), (5, 2, 2), (5, 3, 3)])
    diamond = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5), (5, 4)], "node int, parent int")
    assert (1, 4, 2) in rows(graph.ancestors(diamond))
    assert graph.ancestors(chain.limit(0)).collect() == []


def test_mounts_of_any_depth(spark):
    mounts = spark.createDataFrame([(i, i + 1, f"/m{i}") for i in range(30)] + [(100, 101, "/a"), (101, 100, "/b")], "node int, parent int, prefix string")
    starts = spark.createDataFrame([(0, "/x"), (100, "/y"), (None, "/z")], "node int, path string")
    paths = {r.node: r.path for r in graph.prefix_chain(mounts, starts).collect()}
    assert paths[0] == "".join(f"/m{i}" for i in reversed(range(30))) + "/x" and paths[100] == "/a/y" and paths[None] == "/z"


def test_hosts_name_applications(spark):
    names = spark.createDataFrame([("xpayz", 1), ("tax+core", 2), ("tax-core", 3), ("till", 4), ("till", 5), ("a-ledger-b", 6)], "name string, id int")
    calls = [(1, "${A}pay${B}"), (2, "tax+${X}"), (3, "tax-core:80"), (4, "till"), (5, "${X}"), (6, "${S}-ledger-${T}.svc.cluster.local"), (7, "ta${X}"), (8, None), (9, "tax${X}core")]
    got = rows(assembly.service_links(spark.createDataFrame(calls, "call int, host string"), names))
    assert got == [(1, 1, "inferred"), (2, 2, "inferred"), (3, 3, "confirmed"), (6, 6, "inferred")]


def test_dependents_end_in_circles(spark):
    touches = spark.createDataFrame([(1, "WRITES_TO", 10), (2, "READS_FROM", 20), (1, "PRODUCES", 20), (3, "WRITES_TO", 30), (None, "WRITES_TO", 10)], "flow int, type string, target int")
    starts = spark.createDataFrame([(20, 1), (30, 2), (10, 3)], "target int, flow int")
    target = spark.createDataFrame([(10,)], "target int")
    assert rows(dependents.upstream(touches.where("flow is not null"), starts, target, 5)) == [(1, 1, "WRITES_TO", 10), (2, 2, "READS_FROM", 20), (3, 3, "WRITES_TO", 30)]
    assert rows(dependents.upstream(touches, starts, target, 5, ["READS_FROM"])) == []
    touched, flows = dependents.downstream(touches, starts, spark.createDataFrame([(1,)], "flow int"), 1)
    assert rows(flows) == [(3, 1)] and rows(touched) == [("PRODUCES", 20, 0), ("WRITES_TO", 10, 0), ("WRITES_TO", 30, 1)]


@pytest.mark.parametrize(
    "pattern,strip,rewrite,prefix,path,want",
    [
        ("/in/tax/**", 2, None, None, "/in/tax/rates/7", "/rates/7"),
        ("/in/tax/**", 2, None, "v2/", "/in/tax", "/v2"),
        ("/in/tax/**", 5, None, None, "/in/tax", "/"),
        ("/old/{year}", 0, r"/old/(?<y>\d+), /of/${y}", "/v1", "/old/1999", "/v1/of/1999"),
        ("/rates/*", 0, None, None, "/rates/a/b", None),
    ],
)
def test_gateway_paths(spark, pattern, strip, rewrite, prefix, path, want):
    route = spark.createDataFrame([(1, "g", pattern, " get , put", strip, rewrite, prefix)], "route int, gateway string, pattern string, methods string, strip int, rewrite string, prefix string")
    ask = spark.createDataFrame([(1, "g", "GET", path), (2, "g", None, path), (3, "g", "POST", path), (4, "other", "GET", path)], "request int, gateway string, method string, path string")
    assert rows(routes.through_gateway(ask, route)) == ([(1, 1, want), (2, 1, want)] if want else [])


def test_endpoints_are_never_guessed(spark):
    calls = spark.createDataFrame([(1, 7, "get", "/rates/{y}/"), (2, 7, "get", "/rates/1999"), (3, 7, "get", "/till/1"), (4, 8, "get", "/rates/1999"), (5, 7, "put", "/rates/1")], "call int, application int, method string, path string")
    ends = spark.createDataFrame([(1, 7, "GET", "/rates/{year}"), (2, 7, "GET", "/till/{a}"), (3, 7, "GET", "/{x}/1")], "endpoint int, application int, method string, path string")
    assert rows(routes.endpoint_of(calls, ends)) == [(1, 1), (2, 1)]


def test_sources_of_no_rows_and_nulls(spark):
    schema = "repo string, commit string, file string, claim string, ord int"
    cited = spark.createDataFrame([("r", "c", "a/b/x", "one", 2), ("r", None, "a/y", "two", 1), ("r", "c", "top", None, 3), (None, "c", "z", "three", 4), ("s", "d", None, "one", 1)] + [("t", "c", f"d{i:02}/x", f"k{i}", i) for i in range(12)], schema)
    got = {r.repo: r for r in answers.source_groups(cited).collect()}
    assert got["r"].folders == ["a/", "top"] and got["r"].reasons == ["two", "one"] and got["r"].commits == ["c"] and got["r"].more == 0
    assert got["s"].folders == [] and got["t"].more == 4 and len(got["t"].folders) == 8 and len(got["t"].reasons) == 3 and None not in got
    assert answers.source_groups(cited.limit(0)).collect() == []


def test_names_of_symbols(spark):
    df = spark.createDataFrame([("org.acme.tax.Rates#of(int)",), ("core.run",), ("Rates",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(labels.container(F.col("s")), labels.library_of(F.col("s"))).collect()]
    assert got == [("org.acme.tax.Rates", "org.acme.tax"), ("core", "core.run"), ("Rates", "Rates"), ("", None), (None, None)]


def test_expected_facts_meet_by_equal_properties(spark):
    expected = spark.createDataFrame(
        [("a", "1", {"x": "1"}), ("a", "1", {"x": "2"}), ("a", "2", {"x": "1", "y": None}), ("a", "3", {"x": "1", "y": "2"}), ("a", "4", {}), ("a", "5", None), ("a", "6", {"z": None}), (None, "1", {}), ("b", "1", {"x": "1"}), ("b", "1", {"x": "1"})],
        "kind string, key string, props map<string, string>",
    )
    actual = spark.createDataFrame([("a", "1", {"x": "1", "n": "q"}), ("a", "2", {"x": "1"}), ("a", "3", {"y": "2"}), ("a", "3", {"x": "1"}), ("a", "4", {"k": "v"}), ("a", "5", {}), ("a", "6", None), (None, "1", {})], "kind string, key string, props map<string, string>")
    missing = answers.expected_missing(expected, actual)
    assert rows(missing) == rows(spark.createDataFrame([("a", "3"), ("a", "5"), (None, "1"), ("b", "1"), ("b", "1")], "kind string, key string"))
    # no condition is left to test on the pairs of a key
    joins = [line for line in missing._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("forall" in line for line in joins)


def test_possible_callers_are_not_dealt_out_as_pairs(spark):
    calls = spark.createDataFrame([(1, "get", "/v1/p/3"), (1, "GET", "/p/3"), (2, "get", "/v1/p/3"), (2, "get", "/v1/p/3"), (3, "get", None), (None, "get", "/p/3")], "call int, method string, shape string")
    endpoints = spark.createDataFrame([(10, "GET", "/p/3"), (10, "GET", "/p/3"), (11, "GET", "/3"), (11, "GET", "/p/3"), (12, "POST", "/p/3"), (None, "GET", "/v1/p/3")], "endpoint int, method string, shape string")
    found = dependents.possible_callers(calls, endpoints)
    want = [(c, e, x) for c, near in ((1, True), (2, False), (None, True)) for e, x in ((10, near), (11, near))] + [(1, None, True), (2, None, True)]
    assert rows(found) == rows(spark.createDataFrame(want, "call int, endpoint int, exact boolean"))
    # with one shape an endpoint, pairs leave the join as they are
    single = dependents.possible_callers(calls, endpoints.where("endpoint <> 11").distinct())
    plan = [line.strip(" +-:") for line in single._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    assert plan[0].startswith("Union") and plan[1].startswith("Project")


def test_possible_callers_come_endpoint_by_endpoint_in_bounded_tasks(spark):
    # 4,000 calls of one path and 40 of another; 60 endpoints that the first ends with, ten of them by two shapes, and 5 of both
    calls = spark.range(4040).selectExpr("id as call", "'get' as method", "if(id < 4000, '/v1/p/3', '/q/3') as shape")
    ends = [(n, "GET", "/p/3") for n in range(60)] + [(n, "GET", "/v1/p/3") for n in range(10)] + [(n, "GET", "/3") for n in range(60, 65)] + [(99, "POST", "/p/3"), (98, "GET", "/")]
    got = dependents.possible_callers(calls, spark.createDataFrame(ends, "endpoint int, method string, shape string"), rows_per_task=40_000)
    assert rows(got) == rows(spark.range(4040).selectExpr("id as call", "explode(if(id < 4000, sequence(0, 64), sequence(60, 64))) as endpoint").selectExpr("call", "endpoint", "endpoint < 10 as exact"))
    tasks = [[r.endpoint for r in part] for part in got.rdd.glom().collect()]
    assert sum(len(t) > 0 for t in tasks) > 4 and max(map(len, tasks)) < 130_000
    assert sum(a != b for t in tasks for a, b in zip(t, t[1:])) <= sum(map(len, tasks)) / 20
