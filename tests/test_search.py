"""Search words and names with placeholders."""

import itertools
import random

from pyspark.sql import functions as F

from graphlake.api import Graph
from graphlake.operators import assembly, search

NAMES = ["client orders", "ent-clt-prd-sub", "payment service", "order ledger", "link plaid account", "deleteConversation"]


def index(spark, names):
    return search.index(spark.createDataFrame(list(enumerate(names)), "id int, name string"), "id", "name")


def found(spark, names, sentence, **more):
    words, _ = search.query_words(sentence)
    return {(names[r.id], r.kept, r.dropped) for r in search.search(index(spark, names), words, **more).collect()}


def test_typos_swaps_and_abbreviations(spark):
    assert found(spark, NAMES, "cleint orders") == {("client orders", "cleint orders", "")}
    assert found(spark, NAMES, "client sub") == {("ent-clt-prd-sub", "client sub", "")}
    # a stem, a prefix; three letters wrong are too many
    assert found(spark, NAMES, "payments servic") == {("payment service", "payments servic", "")}
    assert found(spark, NAMES, "pxyxexts") == set()
    # only the closest eight parts that abbreviate a word count
    many = [f"c{'l' * n}ient" for n in range(1, 3)] + ["clt", "cnt", "cit", "cen", "cle", "clen", "cint", "cient", "clie", "lien"]
    assert {n for n, *_ in found(spark, many, "client")} >= {"clen", "cint", "cient", "clie"}


def test_the_first_words_with_hits_win_and_the_others_are_named(spark):
    assert found(spark, NAMES, "link bank account plaid") == {("link plaid account", "link account plaid", "bank")}
    assert found(spark, NAMES, "order zebra ledger yak") == {("order ledger", "order ledger", "zebra yak")}
    assert found(spark, NAMES, "order zebra yak xenon") == set()
    # words that tie go by their order: the last one is dropped first
    assert found(spark, ["a1 b1", "b1 c1"], "a1 b1 c1") == {("a1 b1", "a1 b1", "c1")}
    assert search.lattice(3) == [0b111, 0b011, 0b101, 0b110] and search.lattice(1) == [1]
    assert len(search.lattice(6)) == 42
    assert search.query_words("How can I delete a conversation?") == (["delete", "conversation"], [])
    assert search.query_words("what is this") == (["what", "is", "this"], [])
    assert search.query_words("one two three four five six seven")[1] == ["seven"]
    assert search.search(index(spark, NAMES), []).count() == 0


def test_levels_do_not_end_a_search(spark):
    names = ["red ring", "red rod", "shop red ring blue rod", "shop blue"]
    levels = spark.createDataFrame([(2,), (3,)], "id int")
    assert found(spark, names, "red ring blue", levels=levels) == {("red ring", "red ring", "blue"), ("shop red ring blue rod", "red ring", "blue")}
    # containers alone are told with the words that found them
    assert found(spark, names, "blue shop", levels=levels) == {("shop red ring blue rod", "blue shop", ""), ("shop blue", "blue shop", "")}


def test_typo_index_is_edit_distance(spark):
    rng = random.Random(3)
    tokens = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 11))) for _ in range(600)})
    words = ["abcda", "dcbaabcd"]

    def distance(a, b):
        # edits, where a swap of neighbours is one
        last = {}
        d = {(-1, -1): len(a) + len(b)}
        for i in range(len(a) + 1):
            d[i, -1], d[i, 0] = len(a) + len(b), i
        for j in range(len(b) + 1):
            d[-1, j], d[0, j] = len(a) + len(b), j
        for i in range(1, len(a) + 1):
            at = 0
            for j in range(1, len(b) + 1):
                k, m = last.get(b[j - 1], 0), at
                same = a[i - 1] == b[j - 1]
                if same:
                    at = j
                d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            last[a[i - 1]] = i
        return d[len(a), len(b)]

    vocabulary = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {(r.token, r.word) for r in search.matches(vocabulary, words, most=0).collect()}
    want = {(t, i) for t, (i, w) in itertools.product(tokens, enumerate(words)) if distance(t, w) <= (2 if len(w) >= 8 else 1) or t.startswith(w)}
    assert got == want and len(want) > 5


def test_graph_search_within(spark):
    nodes = spark.createDataFrame([("app:1", ["Application"], "shop"), ("app:2", ["Application"], "bank"), ("t:1", ["Topic"], "orders made"), ("t:2", ["Topic"], "orders paid")], "id string, labels array<string>, name string")
    edges = spark.createDataFrame([("CONTAINS", "app:1", "t:1"), ("CONTAINS", "app:2", "t:2")], "type string, src string, dst string")
    g = Graph(nodes, edges)
    assert [r.id for r in g.search("ordres").collect()] == ["t:1", "t:2"]
    assert [r.id for r in g.search("orders", within="bank").collect()] == ["t:2"]


def test_templates_meet_few_names(spark):
    names = spark.range(1000).select(F.concat(F.lit("shop-"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("-api")).alias("name"), "id")
    templates = spark.range(300).select(F.concat(F.lit("${env}-"), F.lpad((F.col("id") * 3).cast("string"), 5, "0"), F.lit("-${kind}")).alias("template"))
    met = assembly.template_candidates(templates, names).count()
    assert 300 <= met < 300 * 40
    fits = assembly.template_fits(templates, names)
    assert {(r.template, r.id) for r in fits.collect()} == {("${env}-%05d-${kind}" % (3 * i), 3 * i) for i in range(300)}


def test_names_are_never_guessed_from_templates(spark):
    names = spark.createDataFrame([("prod-orders", 1), ("test-orders", 2), ("prod-users", 3), ("a.b", 4), ("dup", 5), ("dup", 6)], "name string, id int")
    calls = spark.createDataFrame(list(enumerate(["${env}-users", "${env}-orders", "prod-${x}s", "${x}", "a${b}", "prod-users", "dup", "{x}-users:80", None, "${e.n}-users.svc.local"])), "call int, host string")
    got = sorted((r.call, r.id, r.certainty) for r in assembly.service_links(calls, names).collect())
    # one fit only; less than three letters is no name; the first dot cuts a host
    assert got == [(0, 3, "inferred"), (5, 3, "confirmed"), (7, 3, "inferred")]
