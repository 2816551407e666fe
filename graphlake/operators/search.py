"""Search over named things: an inverted index, words dropped in order until something is found, vectors.

A query word is matched against the vocabulary, each token once; the index is then
joined by token.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import Scratch

#: Most tokens that stand for a word, though they don't begin with it, which are broadcast to the index.
OTHERS_BROADCAST = 100_000


def index(named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id): the inverted index of a text column."""
    return named.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(text.words_of(F.col(text_col)))).alias("token"))


def _stem(word: str) -> str:
    return next((word[: -len(s)] for s in text.SUFFIXES if word.endswith(s) and len(word) - len(s) >= text.STEM_MIN), word)


def _begins(word: str) -> Column:
    return F.col("token").startswith(word) | F.col("token").startswith(_stem(word))


def distinct_tokens(tokens: DataFrame) -> DataFrame:
    """(token): every token of an index once; words are matched against these, not against the index."""
    return tokens.select("token").distinct()


def deletions(token: Column, most: int = 2) -> Column:
    """The token and all that is left of it without one or two of its letters."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    out = F.array(token)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda t: F.when(F.length(t) > 0, without(t)).otherwise(F.array().cast("array<string>"))))))
    return out


def typo_index(vocabulary: DataFrame) -> DataFrame:
    """(variant, token): tokens by what is left of them without up to two letters; made once for a vocabulary.

    Two words of at most two typos have a variant in common, so they meet in a join.
    """
    return vocabulary.where(F.length("token").between(text.FUZZY_MIN - 2, 64)).select("token", F.explode(deletions(F.col("token"))).alias("variant"))


def _deletions(word: str, most: int) -> set[str]:
    out, last = {word}, {word}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out |= last
    return out


def _typos(word: str) -> int:
    return 2 if len(word) >= 8 else 1 if len(word) >= text.FUZZY_MIN else 0


def _within(token: Column, word: str, typos: int) -> Column:
    """Whether a token is at most so many letters put in, left out, changed, or swapped with the next away from a word."""
    swapped = {word}
    near = F.levenshtein(token, F.lit(word), typos) >= 0
    for left in range(typos - 1, -1, -1):
        swapped = {t[:i] + t[i + 1] + t[i] + t[i + 2 :] for t in swapped for i in range(len(t) - 1)} - {word}
        for t in sorted(swapped):
            near = near | ((F.levenshtein(token, F.lit(t), left) >= 0) if left else token == t)
    return near


def matches(vocabulary: DataFrame, words: list[str], typo: DataFrame | None = None, most: int = text.ABBREVIATIONS_PER_WORD) -> DataFrame:
    """(token, word, weight): the tokens that stand for a query word (its place): itself 4, an abbreviation 2, a prefix, stem or typo 1.

    Abbreviations are the closest ``most`` of the vocabulary's tokens without digits.  Typos are found by a join
    with ``typo`` (of ``typo_index``); only tokens that share a variant are compared with the word.  The vocabulary is
    written once, since it may be made of whole texts; without an index, only tokens about as long as some word get variants.
    """
    spark = vocabulary.sparkSession
    vocabulary = Scratch(spark, "vocabulary").keep(vocabulary.select("token"), "tokens")
    place = {w: i for i, w in enumerate(words)}
    plain = []
    for w, i in place.items():
        plain.append(F.when(_begins(w), F.struct(F.lit(i).alias("word"), F.when(F.col("token") == w, 4).otherwise(1).alias("weight"))))
    found = vocabulary.select("token", F.explode(F.filter(F.array(*plain), lambda m: m.isNotNull())).alias("m")).select("token", "m.word", "m.weight")

    names = vocabulary.where(~F.col("token").rlike("[0-9]"))
    short = [F.when(text.is_abbreviation(F.col("token"), F.lit(w)), F.lit(i)) for w, i in place.items()]
    short = names.select("token", F.explode(F.filter(F.array(*short), lambda m: m.isNotNull())).alias("word"))
    short = short.groupBy("word").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.length("token")).alias("n"), "token"))), 1, most).alias("best"))
    found = found.unionByName(short.select(F.explode("best.token").alias("token"), "word", F.lit(2).alias("weight")))

    fuzzy = [(v, i) for w, i in place.items() if _typos(w) for v in sorted(_deletions(w, _typos(w)))]
    if fuzzy:
        # variants of at most six words; what shares one is compared
        probes = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"variant": v, "word": i} for v, i in fuzzy])), "array<struct<variant string, word int>>")))
        lengths = sorted({n for w in place for n in range(len(w) - _typos(w), len(w) + _typos(w) + 1) if _typos(w)})
        met = (typo_index(vocabulary.where(F.length("token").isin(lengths))) if typo is None else typo).join(F.broadcast(probes), "variant").select("token", "word").distinct()
        near = F.lit(False)
        for w, i in place.items():
            if _typos(w):
                near = near | ((F.col("word") == i) & _within(F.col("token"), w, _typos(w)))
        found = found.unionByName(met.where(near).select("token", "word", F.lit(1).alias("weight")))
    return found.groupBy("token", "word").agg(F.max("weight").alias("weight"))


def lattice(n: int) -> list[int]:
    """Sets of kept words as bits, in the order in which they are tried: all, then one dropped, down to half of them."""
    sets = [sum(1 << i for i in kept) for k in range(n, max(1, (n + 1) // 2) - 1, -1) for kept in itertools.combinations(range(n), k)]
    return sets


def query_words(sentence: str) -> tuple[list[str], list[str]]:
    """The words of a query that count, and those beyond the most that are taken."""
    parts = re.sub(r"[^\w]+", " ", sentence.lower()).split()
    longer = [w for w in dict.fromkeys(parts) if len(w) > 1]
    words = [w for w in longer if w not in text.STOP_WORDS] or longer
    return words[: text.MAX_WORDS], words[text.MAX_WORDS :]


def search(tokens: DataFrame, words: list[str], typo: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """(id, score, level, kept, dropped): things that match the first set of words, in the order of ``lattice``, that any thing matches.

    A thing's matched words are bits of one number, made in one pass over the tokens
    (token, id) that stand for some word; the sets of bits that occur, at most 63, decide which set of words
    wins.  What the words stand for is found first: only tokens that begin with a word, or are among the few others,
    are then moved to meet it.  ``levels`` (id) are containers, such as applications, whose texts hold words of all that is in them: they do
    not end the search, but those of the first set that finds any are added.  The score is the sum of the best weights of the kept words.
    """
    spark = tokens.sparkSession
    n = len(words)
    empty = "id string, score int, level boolean, kept string, dropped string"
    if not n:
        return spark.range(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in empty.split(", ")])
    scratch = Scratch(spark, "search")
    meaning = scratch.keep(matches(distinct_tokens(tokens), words, typo), "meanings")
    begins = functools.reduce(Column.__or__, map(_begins, words))
    others, found = scratch.keep_counted(meaning.where(~begins).select("token", F.lit(True).alias("other")).distinct(), "others")
    asked = tokens.join(F.broadcast(others), "token", "left").where(begins | F.col("other")) if found <= OTHERS_BROADCAST else tokens
    best = asked.join(meaning, "token").groupBy("id").agg(*[F.max(F.when(F.col("word") == i, F.col("weight"))).alias(f"w{i}") for i in range(n)])
    bits = sum((F.when(F.col(f"w{i}").isNotNull(), 1 << i).otherwise(0) for i in range(n)), F.lit(0))
    best = best.withColumn("bits", bits)
    best = best.join(levels.select("id", F.lit(True).alias("level")).distinct(), "id", "left").withColumn("level", F.coalesce("level", F.lit(False))) if levels is not None else best.withColumn("level", F.lit(False))
    best = scratch.keep(best, "matched")
    occurring = best.select("bits", "level").distinct().collect()
    hit = lambda kept, level: any(r["bits"] & kept == kept and r["level"] == level for r in occurring)
    of_things = next((kept for kept in lattice(n) if hit(kept, False)), None)
    of_levels = next((kept for kept in lattice(n) if hit(kept, True)), None)
    if of_things is not None and of_levels is not None and lattice(n).index(of_levels) > lattice(n).index(of_things):
        of_levels = None
    told = of_things if of_things is not None else of_levels
    takes = lambda kept, level: F.lit(False) if kept is None else (F.col("bits").bitwiseAND(kept) == kept) & (F.col("level") == level)
    listed = lambda keep: " ".join(w for i, w in enumerate(words) if ((told or 0) >> i & 1) == keep)
    score = sum((F.coalesce(F.col(f"w{i}"), F.lit(0)) for i in range(n) if (told or 0) >> i & 1), F.lit(0))
    out = best.where(takes(of_things, False) | takes(of_levels, True) | takes(of_things, True))
    return out.select("id", score.cast("int").alias("score"), "level", F.lit(listed(1)).alias("kept"), F.lit(listed(0)).alias("dropped"))


def tiered(tokens: DataFrame, words: list[str]) -> DataFrame:
    """(id, tier, score): what ``search`` finds, with the number of words dropped."""
    return search(tokens, words).select("id", F.when(F.col("dropped") == "", 0).otherwise(F.size(F.split("dropped", " "))).alias("tier"), "score")


def functions_named(rows: DataFrame, symbols: str, words: list[str]) -> DataFrame:
    """Rows with the symbols that contain every word or its stem, shortest first."""
    alternatives = [[w, _stem(w)] for w in words]
    every = lambda s: F.forall(F.array(*[F.array(*map(F.lit, a)) for a in alternatives]), lambda ts: F.exists(ts, lambda t: F.contains(F.lower(s), t)))
    found = F.filter(F.col(symbols), every)
    ordered = F.transform(F.array_sort(F.transform(found, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), lambda x: x["s"])
    return rows.withColumn("found", ordered).where(F.size("found") > 0)


def vocabulary(named: DataFrame, text_col: str) -> DataFrame:
    """(part): distinct parts of names that hold no digit."""
    return named.select(F.explode(text.words_of(F.col(text_col))).alias("part")).where(~F.col("part").rlike("[0-9]")).distinct()


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest cosine with the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
