"""Each coverage signal on a few rows, and small functions that no query uses."""

import json

from pyspark.sql import functions as F

from graphlake.functions import ids, text
from graphlake.operators import assembly, signals, state
from graphlake.sources import sink


def targets(df):
    return sorted((r.target, r.app) for r in df.collect())


def make(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_signals(spark):
    libraries = make(spark, "library string, app string", ("tax", "a"), ("till", "a"), ("json", "b"), ("own", "b"))
    modules = make(spark, "library string, app string", ("tax", "c"), ("own", "b"))
    packs = make(spark, "library string", ("till",))
    assert targets(signals.internal_library(libraries, modules)) == [("tax", "a")]
    assert targets(signals.external_library(libraries, modules, packs)) == [("json", "b")]
    assert targets(signals.library(libraries, packs)) == [("json", "b"), ("own", "b"), ("tax", "a")]
    calls = make(spark, "library string, app string, verdict string, explained boolean", ("net", "a", "io", False), ("net", "b", "io", True), ("disk", "a", "file", False), ("math", "a", "none", False))
    assert targets(signals.external_call(calls)) == [("net", "a")] and targets(signals.file_call(calls)) == [("disk", "a")]
    names = make(spark, "pack string", ("p",), ("q",))
    assert targets(signals.silent_witness(names, names.where("pack = 'p'"))) == [("q", None)]
    agreed = make(spark, "agreement string, app string, role string, channel string", ("confirmed", "a", "r", "c"), ("code_only", "a", "r", "d"))
    assert targets(signals.disagreement(agreed)) == [("code_only|a|r|d", "a")]
    functions = make(spark, "symbol string, app string", ("C#run", "a"), ("D#go", "a"), ("E#x", "b"))
    called = make(spark, "callee string", ("D#go",))
    assert targets(signals.inferred_entry(functions, called, functions.where("symbol = 'E#x'"))) == [("C", "a")]
    assert targets(signals.unknown_host(make(spark, "symbol string, app string, host string", ("C#run", "a", None), ("D#go", "a", "h")))) == [("C", "a")]
    dropped = make(spark, "rule string, reason string, app string", ("r", "no name", "a"), ("r", "test code", "a"))
    assert targets(signals.dropped_match(dropped, ["test code"])) == [("r: no name", "a")]
    files = make(spark, "path string, app string", ("x/src/main/conf/a.ini", "a"), ("etc/b.ini", "a"), ("etc/c.ini", "a"))
    assert targets(signals.unread_file(files, files.where("path like '%c.ini'"))) == [(".ini@conf", "a"), (".ini@etc", "a")]
    config = make(spark, "key string, app string", ("a.b.c", "a"), ("a.b.d", "a"), ("x", "a"))
    assert targets(signals.unread_config(config, config.where("key = 'a.b.d'"))) == [("a.b", "a"), ("x", "a")]
    quiet = signals.quiet(make(spark, "signal string, applications int", ("library", 5), ("library", 1), ("one_sided", 9)), "library", 3)
    assert sorted((r.signal, r.quiet) for r in quiet.collect()) == [("library", False), ("library", True), ("one_sided", False)]


def test_evidence(spark):
    items = signals.library(make(spark, "library string, app string", ("org.tax", "a"), ("till", "b")), make(spark, "library string"))
    got = signals.evidenced(items, make(spark, "target string", ("till",), ("till",)), make(spark, "name string", ("tax",)), make(spark, "app string", ("b",))).collect()
    assert {r.target: sorted(r.evidence) for r in got} == {"org.tax": ["name_known"], "till": ["in_library_module", "referenced"]}


def test_cascades_that_are_touched_and_overrides(spark):
    cascaded = make(spark, "flow int, entity string, operation string, chain string", (1, "a", "insert", None), (1, "b", "insert", "a.x"), (1, "c", "insert", "a.x > b.y"), (2, "b", "insert", "a.x"))
    touched = spark.createDataFrame([(1, ["a.x"])], "flow int, fields array<string>")
    assert sorted((r.flow, r.entity) for r in assembly.touched_cascades(cascaded, touched).collect()) == [(1, "a"), (1, "b")]
    methods = make(spark, "owner string, name string, abstract boolean", ("Top", "run", False), ("Mid", "run", True), ("Mid", "go", False))
    above = make(spark, "node string, ancestor string, depth int", ("Low", "Low", 0), ("Low", "Mid", 1), ("Low", "Top", 2))
    assert sorted(map(tuple, assembly.nearest_override(methods, above).collect())) == [("Low", "go", "Mid"), ("Low", "run", "Top")]


def test_small_functions(spark, tmp_path):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.forms(F.lit("shipping"))) == ["shipping", "shipp"] and one(text.forms(F.lit("tax"))) == ["tax"]
    assert one(text.escape(F.lit("a+b:(c)"))) == r"a\+b\:\(c\)"
    assert one(text.config_prefix(F.lit("tax.rates.year"))) == "tax.rates" and one(text.config_prefix(F.lit("tax"))) == "tax"
    assert one(ids.datastore(F.lit("v"), F.lit("h"), F.lit("d"))) == "datastore:v:h:d"
    assert one(state.nulls_for(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == ["a"]
    path = str(tmp_path / "facts")
    sink.export_json(make(spark, "a int, b string", (1, "x"), (2, None)), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"a":1,"b":"x"}', '{"a":2}'] and json.loads('{"a":2}') == {"a": 2}
