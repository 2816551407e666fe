"""Operators on small graphs, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphlake.api import Graph
from graphlake.operators import coverage, graph, joins, ranking, state, traces
from graphlake.scratch import Scratch
from graphlake.sources import config, sink
from graphlake.streaming import incremental


def test_reach_is_minimal_and_ends_on_cycles(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    roots = spark.createDataFrame([(3,), (None,)], "node int")
    want, frontier, hops = {3: 0}, {3}, 0
    while frontier:
        hops += 1
        frontier = {b for a, b in pairs if a in frontier} - want.keys()
        want |= dict.fromkeys(frontier, hops)
    assert dict(graph.reach(edges, roots).collect()) == want
    assert dict(graph.reach(edges, roots, 2).collect()) == {n: h for n, h in want.items() if h <= 2}


def test_ancestors_of_a_chain_and_a_cycle(spark):
    parents = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(100, 101), (101, 100)], "node int, parent int")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(parents).collect()}
    assert all(got[i, j] == j - i for i in range(13) for j in range(i, 13))
    assert got[100, 101] == 1


def test_diff_twice_is_empty(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "id int, name string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 5), (4, "w", 0)], "id int, name string, n int")
    assert sorted((r.id, r.change) for r in state.diff(a, b, "id").collect()) == [(2, "modify"), (3, "remove"), (4, "add")]
    assert state.diff(b, b, "id").count() == 0


def test_comparable_ignores_volatile(spark):
    row = spark.range(1).select(
        state.comparable(F.create_map(F.lit("a"), F.lit("1"), F.lit("commit"), F.lit("x"), F.lit("card_text"), F.lit("t"))).alias("x"),
        state.comparable(F.create_map(F.lit("commit"), F.lit("y"), F.lit("a"), F.lit("1"))).alias("y"),
    ).first()
    assert row.x == row.y


def test_agreement_is_silent_where_nobody_looked(spark):
    u = lambda rows: spark.createDataFrame(rows, "channel string, app string, role string")
    code = u([("t", "pay", "produces"), ("t", "led", "consumes"), ("unseen", "pay", "produces")])
    claimed = u([("t", "pay", "produces"), ("t", "aud", "consumes")])
    got = sorted(tuple(r) for r in joins.agreement(code, claimed, claimed).collect())
    assert got == [("t", "aud", "consumes", "declared_only"), ("t", "led", "consumes", "code_only"), ("t", "pay", "produces", "confirmed")]


def test_names_are_never_guessed(spark):
    n = lambda rows: spark.createDataFrame(rows, "name string, id string")
    got = joins.resolve_name(n([("a", ""), ("b", ""), ("c", ""), ("d", "")]), n([("a", "1"), ("b", "2"), ("b", "3")]), n([("b", "9"), ("c", "4"), ("d", "5"), ("d", "6")]))
    assert dict(got.collect()) == {"a": "1", "b": None, "c": "4", "d": None}


def test_depth_first(spark):
    calls = spark.createDataFrame([("f", "a", "b", 1), ("f", "a", "c", 2), ("f", "b", "c", 1), ("f", "c", "d", 1), ("f", "d", "a", 1), ("g", "x", "y", 1)], "flow string, caller string, callee string, ord int")
    roots = spark.createDataFrame([("f", "a"), ("g", "x")], "flow string, symbol string")
    got = [(r.flow, r.path, r.symbol, r.repeat, r.recursive) for r in traces.depth_first(calls, roots).collect()]
    assert sorted(got) == [
        ("f", "1", "a", False, False), ("f", "1.1", "b", False, False), ("f", "1.1.1", "c", False, False), ("f", "1.1.1.1", "d", False, False), ("f", "1.1.1.1.1", "a", False, True),
        ("f", "1.2", "c", True, False), ("g", "1", "x", False, False), ("g", "1.1", "y", False, False),
    ]


def test_prefix_chain_survives_a_cycle(spark):
    mounts = spark.createDataFrame([("c", "m", "/m"), ("m", "n", "/n"), ("n", "m", "/loop")], "node string, parent string, prefix string")
    starts = spark.createDataFrame([("c", "/x"), ("z", "/y")], "node string, path string")
    assert dict(graph.prefix_chain(mounts, starts).collect()) == {"c": "/n/m/x", "z": "/y"}


def test_prefix_chain_sends_no_level_through_the_driver(spark, monkeypatch):
    plans = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, name))
    mounts = spark.createDataFrame([("c", "m", "/m"), ("m", "n", "/n")], "node string, parent string, prefix string")
    assert graph.prefix_chain(mounts.limit(2), spark.createDataFrame([("c", "/x")], "node string, path string")).first().path == "/n/m/x"
    assert len(plans) == 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_keep_close_and_interleave(spark):
    s = spark.createDataFrame([(1, 0.4), (2, 0.3), (3, 0.1), (4, 0.0)], "id int, c double")
    assert sorted(r.id for r in ranking.keep_close(s, "c").collect()) == [1, 2]
    h = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)], "g string, o int")
    assert [r.o for r in ranking.interleave(h, "g", "o", 4).collect()] == [1, 4, 5, 2]


def test_pattern_states(spark):
    old = spark.createDataFrame([("library", "a", "open"), ("library", "b", "covered"), ("library", "c", "ignored")], "signal string, target string, state string")
    seen = spark.createDataFrame([("library", "b", 1, 1, 3, 0), ("library", "d", 2, 2, 2, 1)], "signal string, target string, repositories int, applications int, occurrences int, evidence int")
    got = {r.target: r.state for r in coverage.record(old, seen).collect()}
    assert got == {"a": "covered", "b": "open", "c": "ignored", "d": "open"}


def test_config_files(spark, tmp_path):
    (tmp_path / "app.properties").write_text("# c\nspring.kafka.topic=orders\ndb.password=hunter2\n")
    (tmp_path / "app.json").write_text(json.dumps({"a": {"b": [1, 2]}, "c": [{"d": 1}, {"d": None}]}))
    (tmp_path / "p.xml").write_text("<project><dep name='x'>1</dep><dep name='y'/></project>")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.json").write_text('{"z": 1}')
    found = config.files(spark, str(tmp_path), [".properties", ".json", ".xml"])
    got = {r.key: (r.value, r.line) for r in config.read(found).collect()}
    assert got["spring.kafka.topic"] == ("orders", 2) and got["db.password"][0] is None
    assert got["a.b"][0] == "1,2" and got["c[0].d"][0] == "1" and "c[1].d" not in got and "z" not in got
    assert got["project.dep[0].name"][0] == "x" and got["project.dep[1].name"][0] == "y"
    hit = config.matching(config.read(found), "spring.{KIND}.*").collect()
    assert [(r.KIND, r.value) for r in hit] == [("kafka", "orders")]
    errors = config.unparsed(found).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in errors] == ["bad.json"] and errors[0].error.startswith("JSONDecodeError")


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text("tax:\n  rates: [1, 2]\n  api_key: x\n---\ntill:\n  - name: b\n")
    (tmp_path / "b.yaml").write_text("a: [1\n")
    found = config.files(spark, str(tmp_path), [".yml", ".yaml"])
    got = {r.key: (r.value, r.line) for r in config.read(found).collect()}
    assert got == {"tax.rates": ("1,2", 2), "tax.api_key": (None, 3), "till[0].name": ("b", 6)}
    assert [r.path.rsplit("/", 1)[-1] for r in config.unparsed(found).collect()] == ["b.yaml"]


def test_files_and_lines(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    tests = ["src/test_rates.py", "a/tests/x.py", "RatesTest.java", "b/rates.spec.ts"]
    assert all(one(config.is_test_file(F.lit(p))) for p in tests) and not one(config.is_test_file(F.lit("src/rates.py")))
    assert one(config.glob_matches(F.lit("a/b/rates.yml"), "*.yml")) and one(config.glob_matches(F.lit("a/b.c"), "a/?.c")) and not one(config.glob_matches(F.lit("a/b.cc"), "a/?.c"))
    assert one(config.slice_lines(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(3))) == "b\nc"


def test_rules_over_records(spark, tmp_path):
    doc = {"spec": {"acls": [{"operations": ["Write"], "resource": {"name": "t1"}, "type": "allow"}, {"resource": {"name": "t2"}, "type": "deny"}, {"type": "allow"}]}}
    (tmp_path / "user.json").write_text(json.dumps(doc))
    rows = config.records(config.files(spark, str(tmp_path)), "spec.acls[*]")
    rule = {"when": {"type": "allow", "operations": {"contains": "Write"}}, "emit": {"kind": "edge", "fields": {"to": "topic:{resource.name}"}}}
    assert [(r.kind, dict(r.fields)) for r in config.apply_rule(rows, rule).collect()] == [("edge", {"to": "topic:t1"})]


def test_claims_and_sinks(spark, tmp_path):
    stored = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", 4)], "key string, fields string, removed_job int")
    run = spark.createDataFrame([("a", "1"), ("c", "9"), ("d", "0")], "key string, fields string")
    got = {r.key: (r.fields, r.removed_job) for r in sink.replace_claims(stored, run, 7).collect()}
    assert got == {"a": ("1", None), "b": ("2", 7), "c": ("9", None), "d": ("0", None)}
    path = str(tmp_path / "facts")
    sink.write_owned(spark.createDataFrame([("r1", 1), ("r2", 2)], "repo string, n int"), path)
    sink.write_owned(spark.createDataFrame([("r1", 5)], "repo string, n int"), path)
    assert sorted((r.repo, r.n) for r in spark.read.parquet(path).collect()) == [("r1", 5), ("r2", 2)]


def test_incremental_is_idempotent(spark, tmp_path):
    schema = "id int, v string, at int"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)], [(3, "d", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}-{n}")
        import glob, os, shutil  # noqa: E401

        os.makedirs(source, exist_ok=True)
        shutil.move(glob.glob(f"{source}-{n}/part-*.parquet")[0], f"{source}/{n}.parquet")
        incremental.run(spark, source, schema, "id", "at", work).awaitTermination()
    log = sorted((r.batch, r.id, r.change, r.old and r.old.v, r.new.v) for r in incremental.changes(spark, work).collect())
    assert log == [(0, 1, "add", None, "a"), (0, 2, "add", None, "b"), (1, 2, "modify", "b", "c"), (1, 3, "add", None, "d")]
    assert sorted((r.id, r.v, r["at"]) for r in incremental.current(spark, work, schema, "id").collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([("app:orders", ["Application"], "orders service"), ("topic:new", ["Topic"], "new orders"), ("app:bill", ["Application"], "billing")], "id string, labels array<string>, name string")
    edges = spark.createDataFrame([("PRODUCES", "app:orders", "topic:new"), ("STARTS", "topic:new", "app:bill")], "type string, src string, dst string")
    return Graph(nodes, edges)


def test_graph_answers(small):
    assert {r["id"] for r in small.search("where is the orders").collect()} == {"app:orders", "topic:new"}
    assert {r["id"] for r in small.search("biling").collect()} == {"app:bill"}
    assert {(r.node, r.hops) for r in small.dependents("billing", "upstream", 2).collect()} == {("app:bill", 0), ("topic:new", 1), ("app:orders", 2)}
    assert {(r.direction, r.other) for r in small.node("topic:new").collect()} == {("in", "app:orders"), ("out", "app:bill")}
    assert small.changes(small).count() == 0
    assert {(r.name, r["count"]) for r in small.stats().collect()} == {("Application", 2), ("Topic", 1), ("PRODUCES", 1), ("STARTS", 1)}
