"""Column functions, case by case."""

import pytest
from pyspark.sql import functions as F

from graphlake.functions import ids, text, urls, versions


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_words(spark):
    got = lambda s: one(spark, text.meaningful(text.words_of(F.lit(s))))
    assert got("Where do we archive an old invoice?") == ["archive", "old", "invoice"]
    assert got("ledger-core /tax/rates") == ["ledger", "core", "tax", "rates"]
    assert got("by an at") == ["by", "an", "at"]
    assert got("") == []


@pytest.mark.parametrize("word,stem", [("normalize", "normal"), ("invoices", "invoic"), ("allocations", "alloc"), ("used", "used"), ("entries", "entr"), ("tax", "tax"), ("shipping", "shipp")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


@pytest.mark.parametrize("part,word,ok", [("inv", "invoice", True), ("ldg", "ledger", True), ("wrhs", "warehouse", True), ("in", "invoice", False), ("inz", "invoice", False), ("vni", "invoice", False), ("ledger", "ledger", False), ("lgd", "ledger", False)])
def test_abbreviation(spark, part, word, ok):
    assert one(spark, text.is_abbreviation(F.lit(part), F.lit(word))) is ok


def test_identifiers_and_symbols(spark):
    assert one(spark, text.split_identifiers(F.lit("TaxRateTable.load ship_order plain XMLParser v2Api"))) == "tax rate table ship order xml parser v2 api"
    assert one(spark, text.short_symbol(F.lit("org.acme.LedgerStore#post(int,long)"))) == "LedgerStore.post"
    assert one(spark, text.short_symbol(F.lit("core.tasks.Nightly.start"))) == "start"
    assert one(spark, text.package_root(F.lit("org.acme.ledger.deep.Post#by(int)"))) == "org.acme.ledger"
    assert one(spark, text.package_root(F.lit("@Post"))) is None
    assert one(spark, text.cut(F.array(*map(F.lit, "abcd")), 2)) == "a, b (+2 more)"
    sites = one(spark, text.call_sites(F.array(F.lit("31 delete"), F.lit("y"), F.lit("9"))))
    assert [tuple(s) for s in sites] == [(31, "delete"), (None, None), (9, None)]


@pytest.mark.parametrize(
    "url,host,path",
    [
        ("https://tax.example.org/rates", "tax.example.org", "/rates"),
        ("https://{zone}/rates/{year}", None, "/rates/{year}"),
        ("{root}/rates/7/find", None, "/rates/7/find"),
        ("${tax.root-url}rates", None, "/rates"),
        ("/rates/{year}", None, "/rates/{year}"),
        ("http://tax.${STAGE}-core.svc.cluster.local:9000/y", "tax.${STAGE}-core.svc.cluster.local:9000", "/y"),
        ("me:secret@tax.internal/b", "tax.internal", "/b"),
        ("http://host", "host", "/"),
    ],
)
def test_host_and_path(spark, url, host, path):
    assert tuple(one(spark, urls.host_and_path(F.lit(url)))) == (host, path)


def test_paths(spark):
    assert one(spark, urls.path_shape(F.lit("/rates/{year}/?full=1"))) == "/rates/{}"
    assert one(spark, urls.path_shape(F.lit("rates/{of}"))) == "/rates/{}"
    assert one(spark, urls.resource(F.lit("/tax/rates/years/{year}"))) == "/tax/rates"
    assert one(spark, urls.template_fits(F.lit("/rates/{year}"), F.lit("/rates/1999"))) is True
    assert one(spark, urls.template_fits(F.lit("/rates/{year}"), F.lit("/rates/1999/all"))) is False
    assert one(spark, urls.config_keys(F.lit("${b.c}/x/${a:1}/${b.c}"))) == ["a", "b.c"]
    inside = lambda p, strip, prefix: one(spark, urls.inside_path(F.lit(p), F.lit(strip), F.lit(prefix)))
    assert inside("/in/tax/rates", 2, None) == "/rates" and inside("/till/y", 0, "v2/") == "/v2/till/y" and inside("/in", 1, "/v2") == "/v2"
    outside = lambda p, lead, prefix: one(spark, urls.outside_path(F.lit(p), F.lit(lead), F.lit(prefix)))
    assert outside("/rates", "in/tax", None) == "/in/tax/rates" and outside("/v2/y", "", "v2") == "/y" and outside("/y", "", "v2") is None and outside("/y", "in/*", None) is None


@pytest.mark.parametrize("pattern,path,ok", [("/in/tax/**", "/in/tax", True), ("/in/tax/**", "/in/tax/y/z", True), ("/in/tax/**", "/in/taxes", False), ("/t/*", "/t/u", True), ("/t/*", "/t/u/v", False), ("/y/{year}", "/y/{of}", True), ("/t.u", "/txu", False), ("/t+(u)/{a}/**", "/t+(u)/1", True)])
def test_gateway(spark, pattern, path, ok):
    assert one(spark, F.lit(path).rlike(urls.gateway_regex(pattern))) is ok
    assert one(spark, F.rlike(F.lit(path), urls.pattern_regex(F.lit(pattern)))) is ok


@pytest.mark.parametrize(
    "url,want",
    [
        ("jdbc:postgresql://me:pw@ledger.internal:5433/tax?ssl=1", ("postgresql", "ledger.internal:5433", "tax")),
        ("jdbc:oracle:thin:@//vault:1522/rates", ("oracle", "vault:1522", "rates")),
        ("jdbc:oracle:thin:@vault:1522:TAX", ("oracle", "vault:1522", "TAX")),
        ("jdbc:sqlserver://till:1434;databaseName=tax;a=b", ("sqlserver", "till:1434", "tax")),
        ("jdbc:h2:mem:scratch;MODE=a", ("h2", "embedded", "scratch")),
        ("mysql+driver://till/tax", ("mysql", "till", "tax")),
        ("not a url", None),
    ],
)
def test_database(spark, url, want):
    got = one(spark, urls.database_of(F.lit(url)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("version,spec,ok", [("5.1.3", ">=4.6, <6", True), ("6.0", "<6", False), ("5.1.0.FINAL", "==5.1", True), ("2.0.0-beta", "!=2.0", False), ("1.12", ">1.9", True), ("y", ">=1", False), ("20240101120000", ">=20231231", True), ("4.6b.3", ">4.6.2", True), ("4.6b.3", "4.6.3", True), ("5", "<=4.9,>1", False)])
def test_range(spark, version, spec, ok):
    assert one(spark, versions.in_range(F.lit(version), spec)) is ok


def test_range_of_no_version(spark):
    assert one(spark, versions.in_range(F.lit(None).cast("string"), ">=1")) is None


def test_scores(spark):
    assert one(spark, versions.score(F.lit("one_sided"), F.lit(2), F.lit(1), F.lit(0), F.lit(1))) == pytest.approx(3.5 * 210 * 5)
    assert one(spark, versions.band(F.lit(0.95))) == "high" and one(spark, versions.band(F.lit(0.5))) == "medium" and one(spark, versions.band(F.lit(0.1))) == "low"
    assert one(spark, versions.percent(F.lit(1), F.lit(0))) is None


def test_ids(spark):
    assert one(spark, ids.step(F.lit("flow:a"), F.lit("S.run"), F.lit("Impl"), F.lit(2))) == "step:flow:a:S.run@Impl#2"
    assert one(spark, ids.table(F.lit("db"), F.lit(None).cast("string"), F.lit("t"))) == "table:db::t"
    assert one(spark, ids.channel(F.lit("Topic"), F.lit("x"))) == "topic:x"
    assert one(spark, ids.endpoint(F.lit("a"), F.lit("get"), F.lit("/x"))) == "endpoint:a:GET:/x"


def test_times_and_sizes(spark):
    from graphlake.functions import times

    at = lambda s: F.lit(s).cast("timestamp")
    assert str(one(spark, times.last_slot(at("2026-03-02 01:30:00"), 2))) == "2026-03-01 02:00:00"
    assert str(one(spark, times.last_slot(at("2026-03-02 02:00:00"), 2))) == "2026-03-02 02:00:00"
    assert one(spark, times.is_due(at("2026-03-02 03:00:00"), at("2026-03-01 23:00:00"), 2)) is True
    assert [one(spark, times.size_mb(F.lit(s))) for s in ("2g", "512m", "2048k", "x")] == [2048, 512, 2, None]


def test_fill_names_and_joins(spark):
    props = F.create_map(F.lit("a"), F.lit("1/${b}"), F.lit("b"), F.lit("2"))
    assert one(spark, text.filled(F.lit("x/${a}/${c:9}/${d}"), props)) == "x/1/2/9/${d}"
    names = F.array(F.lit("orders"), F.lit("order"), F.lit("c++"))
    assert one(spark, text.names_in(F.lit("the Orders in c++ code"), names)) == ["orders", "c++"]
    assert one(spark, urls.join_path(F.lit("/a/"), F.lit("/b/"))) == "/a/b" and one(spark, urls.join_path(F.lit(""), F.lit(""))) == "/"
    assert one(spark, urls.host_of(F.lit("https://u@api.example.com:1/v1"))) == "u@api.example.com:1" and one(spark, urls.host_of(F.lit("localhost:11434"))) == "localhost:11434"
    assert tuple(one(spark, text.flow_heading(F.lit("topic"), F.lit("orders"), F.lit(None).cast("string"), F.lit(None).cast("string")))) == ("TOPIC", "orders")
