"""Operators held against plain definitions: the contract's patterns, a schedule made slot by slot, a parse letter by letter."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphlake.llm import bpe, langid, mixing, pii, secrets

# ---------------------------------------------------------------- the contract's patterns, word for word

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def number(text):
    value = 0
    for c in text:
        value = min(value * 10 + int(c), 1000)
    return value


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def personal(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(number(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def secret(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m.group()) >= 16]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_fixed_patterns_are_the_contracts(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = "".join(rng.choice(["0", "4", "7", "25", "192", "00", ".", ".", "-", " ", "+", "(", ")", "@", "a", "Z", "_", "%", "é", "\n", "10.0.0.1", "+49 30 1234567", "x@y.de"]) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == personal(text), text
        text = "".join(rng.choice(["password", "PassWd", "secret", "token", "api_key", "apikey", "ſecret", ":", "=", " ", '"', "'", "AKIA", "A", "0123456789", "abcdef", "f", "9", "Q", "/", ".", "g", "\n"]) for _ in range(rng.randrange(40)))
        assert secrets.base_spans(text) == secret(text), text


def test_long_runs_of_digits():
    zeros = "0" * 5000
    for text in (f"{zeros}.1.2.3", f"1.{zeros}7.2.3", f"1.2.3.{zeros}256", f"1.2.3.{'9' * 6000}", "4" * 4000, "+" + "1" * 4000, "1." * 2000):
        assert pii.base_spans(text) == personal(text)


SCHEMA = "doc_id bigint, text string, lang string, source string"


def test_span_queries_on_rows_that_repeat_and_long_texts(spark):
    card, key = "4111 1111 1111 1111", "AKIA" + "Q7" * 9
    long = " ".join(f"word{i}" for i in range(20_000)) + f" a@b.org {card} token={key}"
    rows = [(1, long, None, None), (1, long, None, None), (None, f"{key} x@y.org", None, None), (2, None, None, None), (3, "", None, None), (4, f"10.0.{'0' * 4500}.1", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    digest = lambda spans, names: hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    for module, kinds, more, definition in ((pii, pii.KINDS, pii.FIELD_KINDS, personal), (secrets, secrets.KINDS, (secrets.RANDOM,), secret)):
        got = module.span_digests(module.find(docs), kinds, more).collect()
        key_of = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted([(r.doc_id, r.base_sha256) for r in got], key=key_of) == sorted([(i, digest(definition(t or ""), kinds)) for i, t, *_ in rows], key=key_of)


# ---------------------------------------------------------------- the battery


ENGLISH = "the quick brown fox jumps over a lazy dog while seventeen other animals watch silently from behind tall green trees near river".split()
GERMAN = "der schnelle braune fuchs springt ueber den faulen hund waehrend siebzehn andere tiere still hinter hohen gruenen baeumen zusehen".split()
FRENCH = "le rapide renard brun saute par dessus un chien paresseux pendant que dix sept autres animaux regardent derriere les grands arbres".split()
SPANISH = "el veloz zorro marron salta sobre un perro perezoso mientras diecisiete otros animales miran detras de grandes arboles verdes".split()


def identifiers(rng, words, n):
    """Ordinary identifiers of 16 characters and more in the usual styles."""
    out = []
    while len(out) < n:
        pick = [rng.choice(words) for _ in range(rng.randrange(4, 8))]
        out += [t for t in ("_".join(pick), "-".join(pick), "/".join(pick), "".join(x.capitalize() for x in pick), "".join(pick), "_".join(pick).upper(), "".join(pick) + str(rng.randrange(10**4))) if len(t) >= 16]
    return out[:n]


def reported(spark, rows):
    """The texts of the spans that the battery adds, by id."""
    got = secrets.find(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {r[0]: r[1] for r in rows}
    return {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.added] for r in got}


def test_keys_are_found_whatever_else_stands_in_their_text(spark):
    """One corpus with keys alone, and beside 10 and 100 identifiers: recall is the same, by encoding and length; few identifiers are reported."""
    rng = random.Random(8)
    rows, keys = [], {}
    for name in ("upper hex", "base32", "base36", "letters", "base62", "base64"):
        for n in (20, 32):
            for beside in (0, 10, 100):
                for _ in range(12 if beside == 100 else 40):
                    i, key = len(rows), "".join(rng.choice(secrets.ALPHABETS[name]) for _ in range(n))
                    around = identifiers(rng, ENGLISH, beside)
                    rng.shuffle(around)
                    rows.append((i, " ".join([*around[: beside // 2], f"see {key} there", *around[beside // 2 :]]), None, None))
                    keys[i] = (name, n, beside, key)
    got = reported(spark, rows)
    share = {}
    for i, (name, n, beside, key) in keys.items():
        share.setdefault((name, n, beside), []).append(key in got[i])
    share = {k: sum(v) / len(v) for k, v in share.items()}
    for beside in (0, 10, 100):
        mean = sum(v for k, v in share.items() if k[2] == beside) / 12
        assert abs(mean - sum(v for k, v in share.items() if k[2] == 0) / 12) < 0.12, share
    least = {("upper hex", 20): 0.6, ("upper hex", 32): 0.8, ("base36", 32): 0.6, ("base62", 20): 0.3, ("base62", 32): 0.6}
    assert all(share[(*k, 0)] >= v for k, v in least.items()), share
    others = sum(len([t for t in v if t != keys[i][3]]) for i, v in got.items())
    assert others <= 0.01 * sum(k[2] for k in keys.values())


def test_ordinary_text_of_four_languages_is_left_alone(spark):
    rng, rows, n = random.Random(9), [], 0
    for words in (ENGLISH, GERMAN, FRENCH, SPANISH):
        for _ in range(30):
            ids = identifiers(rng, words, 30)
            n += len(ids)
            rows.append((len(rows), " ".join([*ids, *[rng.choice(words) for _ in range(60)]]), None, None))
    rows += [(1000, "0" * 400 + "a", None, None), (1001, "abc" * 3000, None, None), (1002, "-" * 40 + " " + "x-" * 20 + " ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef", None, None)]
    got = reported(spark, rows)
    assert not got[1000] and not got[1001] and not got[1002]
    assert sum(map(len, got.values())) <= 0.003 * n


def test_texts_that_are_not_utf8(spark):
    key = "AKIA" + "Q7" * 9
    docs = spark.createDataFrame([(1, bytearray(b"\xff\xfe " + key.encode())), (2, bytearray(key.encode())), (3, None)], "doc_id bigint, b binary")
    got = {r.doc_id: [(s.start, s.end) for s in r.base if s.kind == "access"] for r in secrets.find(docs.selectExpr("doc_id", "cast(b as string) as text")).collect()}
    assert got == {1: [(3, 25)], 2: [(0, 22)], 3: []}


def test_error_is_shared_by_length():
    counts = lambda *rows: [(n, s, secrets._bin(p), k) for n, s, p, k in rows]
    # of equal evidence the longer candidate passes; many candidates without evidence make it harder for one with some
    assert secrets.thresholds(counts(("hex", 64, 6e-4, 1), ("hex", 16, 6e-4, 1)), 1e-3) == {("hex", 64): secrets._bin(6e-4)}
    assert secrets.thresholds(counts(("hex", 31, 5e-4, 1)), 1e-3) == {("hex", 31): secrets._bin(5e-4)}
    assert secrets.thresholds(counts(("hex", 31, 5e-4, 1), ("hex", 31, 0.5, 9)), 1e-3) == {}
    assert secrets.thresholds([], 1e-3) == {}


# ---------------------------------------------------------------- the mixture


def schedule(weights, blocks):
    """Owner and block of each slot, slot by slot: of released blocks the one of the earliest deadline, anew when a source ends."""
    import math

    given, out = [0] * len(weights), []
    while any(g < b for g, b in zip(given, blocks)):
        active = [i for i in range(len(weights)) if given[i] < blocks[i]]
        divisor = math.gcd(*[weights[i] for i in active])
        total = sum(weights[i] // divisor for i in active)
        done, t = dict.fromkeys(active, 0), 0
        while all(given[i] < blocks[i] for i in active):
            w = {i: weights[i] // divisor for i in active}
            ready = [(-(-(done[i] + 1) * total // w[i]), i) for i in active if done[i] * total // w[i] <= t]
            _, i = min(ready)
            out.append((i, given[i]))
            given[i] += 1
            done[i] += 1
            t += 1
    return out


def test_mixture_is_the_schedule(spark):
    sizes, weights = {"a": 130, "b": 61, "c": 9, None: 33}, {"a": 5, "b": 3, "c": 2, None: 1}
    rows = [(i if i % 7 else None if i % 2 else i // 7, "x", None, s) for s, n in sizes.items() for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=weights, block_docs=4, bucket_docs=16).select("row.doc_id", "source", "block", "slot", "place").collect()
    names = ["a", "b", "c", None]
    want = schedule([weights[s] for s in names], [-(-sizes[s] // 4) for s in names])
    assert {(r.slot, names.index(r.source), r.block) for r in got} == {(t, i, k) for t, (i, k) in enumerate(want)}
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted([(r.doc_id, r.source) for r in got], key=key) == sorted([(r[0], r[3]) for r in rows], key=key)
    assert len({(r.slot, r.place) for r in got}) == len(rows)


def test_mixture_needs_a_weight_for_each_source(spark):
    docs = spark.createDataFrame([(1, "x", None, "a"), (2, "x", None, "b")], SCHEMA)
    with pytest.raises(ValueError, match="positive integer weight"):
        mixing.mix(docs, weights={"a": 1})


# ---------------------------------------------------------------- language


def parse(text, learned, block):
    """Phrases of a text: each the longest match in the learned text; a block's end ends one."""
    n = 0
    for at in range(0, len(text), block):
        piece, i = text[at : at + block], 0
        while i < len(piece):
            size = 1
            while i + size < len(piece) and piece[i : i + size + 1] in learned:
                size += 1
            if piece[i] not in learned:
                size = 1
            i += size
            n += 1
    return n


def test_phrases_are_the_longest_matches():
    rng = random.Random(6)
    letters = "abcdeéжщ"
    make = lambda n: "".join(rng.choice(letters + " ") for _ in range(n))
    training = {"x": [make(400) for _ in range(5)], "y": [make(300) for _ in range(5)]}
    parser = langid.CrossParser(training)
    squeeze = lambda t: re.sub(" +", " ", t)
    texts = [make(n) for n in (1, 5, 255, 256, 257, 900)]
    got = parser.phrases(texts)
    for column, language in enumerate(("x", "y")):
        learned = "".join(squeeze(t) + " " for t in langid.leave_out(training[language])[0])
        assert [parse(squeeze(t), learned, langid.BLOCK) for t in texts] == got[:, column].tolist()


def test_one_language_and_ties(spark):
    rows = [(i, "same words in each", lang, None) for i, lang in enumerate(["b", "a"] * 6)]
    docs = spark.createDataFrame(rows + [(100, "words in each", None, None), (101, "123", None, None)], SCHEMA)
    tied = {r.doc_id: r.lang_pred for r in langid.identify(docs, docs.where("doc_id < 50")).collect()}
    assert tied[100] == "a" and tied[101] == langid.UNDETERMINED
    single = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, docs.where(F.col("lang") == "b")).collect()}
    assert single[100] == ("b", 1.0) and single[101] == (langid.UNDETERMINED, 0.0)


# ---------------------------------------------------------------- bytes that are not UTF-8, many labels


def test_bytes_that_are_not_utf8_are_read_as_the_replacement_character(spark):
    import public_tokenizers

    raw = spark.createDataFrame([(1, bytearray(b"\xff mail a@b.org \xc3")), (2, bytearray(b"plain text")), (None, None)], "doc_id bigint, b binary")
    docs = raw.selectExpr("doc_id", "cast(b as string) as text", "cast('en' as string) as lang")
    assert {r.doc_id: [(s.kind, s.start) for s in r.base] for r in pii.find(docs).collect()} == {1: [("email", 7)], 2: [], None: []}
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True).collect()
    plain = bpe.encode(spark.createDataFrame([(1, "� mail a@b.org �"), (2, "plain text"), (None, None)], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(map(str, ids)) == sorted(map(str, plain))
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, docs).collect()} == {1: "en", 2: "en", None: "und"}


def test_more_labels_than_the_bound(spark):
    rows = [(i, f"word{chr(97 + i % 26)} " * 30, f"l{i % 300:03}", None) for i in range(600)] + [(1000 + i, "etwas ganz anderes steht hier", "de", None) for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taught = langid.training_texts(docs.select("doc_id", "text", "lang"), max_languages=20)
    # the commonest labels, of equal ones the first by name
    assert sorted(taught) == ["de", *[f"l{i:03}" for i in range(19)]]
    got = langid.identify(docs, docs, per_language=2, max_chars=400).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id >= 1000} == {"de"}


def test_words_of_the_corpus_are_counted_over_all_texts(spark):
    # each word stands in two of 6,000 texts
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = spark.createDataFrame([(i, f"q{letters(i % 3000)} 17", None, None) for i in range(6000)], SCHEMA)
    assert set(secrets.words_of_corpus(docs, "text", most=5000)) == {f"q{letters(i)}" for i in range(3000)}
    assert secrets.words_of_corpus(docs.limit(0), "text", most=5000) == list(secrets.WORDS)
