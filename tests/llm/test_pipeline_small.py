"""Stages of the pipeline on small awkward tables."""

import hashlib
import random
import re

import pytest

from graphlake.llm import jaccard_join, mixing
from graphlake.llm import pipeline as corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, text, "en", source, len(text or "")) for i, text, source in rows], SCHEMA)


def test_exact_keeps_each_distinct_text(spark):
    rows = [
        (None, "first without id", "a"), (None, "second without id", "a"), (None, "third  without id", "b"), (None, "third without id", "a"),
        (1, "one", "a"), (1, "another one", "a"), (1, "shared text", "a"), (1, "shared text", "b"), (1, "one", "c"),
        (2, "shared  text", "a"), (None, "shared text", "a"), (0, "zero", "a"), (2, "two", "a"), (3, None, "a"), (4, "", "a"), (None, None, "b"),
    ]
    got = corpus_pipeline.exact(spark, table(spark, rows), "").collect()
    norm = lambda text: re.sub("[ \t-\r]+", " ", text or "")
    texts = [norm(r.text) for r in got]
    assert sorted(texts) == sorted({norm(text) for _, text, _ in rows})
    ids = {norm(r.text): r.doc_id for r in got}
    assert ids["shared text"] == 1 and ids["one"] == 1 and ids["third without id"] is None and ids[""] == 3
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(rows)


def test_order_of_the_mixture_reaches_the_result(spark, tmp_path):
    docs = table(spark, [(i, f"text {i}", "abbbccc"[i % 7]) for i in range(700)])
    want = [r.doc_id for r in mixing.mix(docs).select("row.doc_id", "slot", "place").orderBy("slot", "place").collect()]
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.part, r.row))] == want
    assert len({(r.part, r.row) for r in got}) == 700


def awkward(spark):
    """Nulls, repeated ids and rows, long texts, and columns named like those that operators work with."""
    rng = random.Random(1)
    words = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    base = words(60)
    rows = [
        (1, None, None, "a"), (2, "", "en", None), (None, "123 456", "en", "a"), (3, base, "en", "a"), (3, base, "en", "a"), (None, base, None, "b"),
        (4, base + " tail", "en", "a"), (4, words(50), "de", "a"), (None, base + " other tail", "de", None), (5, words(20_000), None, "c"),
        (6, base.upper(), "en", "c"), (7, words(30), "de", "c"), (None, words(30), "de", "c"), (None, words(31), "de", "c"), (8, "one two", "en", "c"), (9, "One two", "en", "c"),
    ]
    clash = "_some string, _n string, _id string, _h string, _row string, hash string, component string, slot string, part string, sha string, kept string, n string"
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *"abcdefghijkl") for i, t, lang, s in rows], SCHEMA + ", " + clash)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_stages_keep_what_they_should(spark):
    docs = awkward(spark)
    everything = [tuple(r) for r in docs.collect()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))

    out = corpus_pipeline.language(spark, docs, "")
    lettered = [r for r in everything if re.search("[A-Za-z]", r[1] or "")]
    assert out.columns == docs.columns
    assert order((*r[:2], *r[3:]) for r in rows_of(out)) == order((*r[:2], *r[3:]) for r in lettered)
    assert all(r[2] is not None for r in rows_of(out))

    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    least = {}
    for r in everything:
        key = norm(r[1])
        best = least.get(key)
        if best is None or (r[0] is None, r[0] or 0) < (best[0] is None, best[0] or 0):
            least[key] = r
    assert rows_of(corpus_pipeline.exact(spark, docs, "")) == order(least.values())

    exact = [r for r in order(least.values())]
    kept = rows_of(corpus_pipeline.near(spark, spark.createDataFrame(exact, docs.schema), ""))
    components, singles = {}, []
    # labels that are unique, so that rows without an id can be told apart
    labels = jaccard_join.brute_force([(i, r[1]) for i, r in enumerate(exact)])
    for (i, size, component), r in zip(labels, exact):
        (components.setdefault(component, []) if size else singles).append(r)
    want = singles + [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in components.values() if len({r[0] for r in group}) == len(group)]
    assert all(len({r[0] for r in group}) == len(group) for group in components.values())
    assert kept == order(want)

    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and rows_of(mixed) == order(everything)

    ids = corpus_pipeline.tokens(spark, docs, "").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.decoded_sha256 for r in ids) == sorted(sha(r[1]) for r in everything)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, stage):
    docs = awkward(spark).limit(0)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.collect() == []
    assert stage == "tokens" or out.columns == docs.columns


def test_whole_pipeline_against_its_parts(spark, tmp_path):
    """The rows of run() are those of plain definitions of its filters."""
    rng = random.Random(7)
    texts = [" ".join("w%d" % rng.randrange(10**6) for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].replace(" ", "  "), "en", "c") for i in range(8)] + [(200 + i, texts[i] + " tail", "en", "c") for i in range(10, 25)] + [(300, None, "en", "a"), (301, "!!!", None, "a")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    distinct = {}
    for i, t, *_ in sorted(r for r in rows if re.search("[A-Za-z]", r[1] or "")):
        distinct.setdefault(re.sub(" +", " ", t), (i, t))
    want = {component for _, _, component in jaccard_join.brute_force(list(distinct.values()))}
    assert sorted(r.doc_id for r in got) == sorted(want)
    of = dict((i, t) for i, t, *_ in rows)
    assert all(r.decoded_sha256 == hashlib.sha256(of[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in got)
    assert len({(r.part, r.row) for r in got}) == len(got)
