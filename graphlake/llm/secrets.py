"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

A candidate is a run of key characters.  Its encoding is the smallest alphabet
that holds it.  Three statistics are taken in that alphabet: chi-squared
uniformity of the alphabet, runs of characters of one kind (small letters,
capitals, digits, marks), and lag-one serial correlation.

Each is read under two hypotheses.  Under the first the candidate is random, and Fisher's
method joins the p-values of the three tests.  Under the second it is ordinary text: how even,
how restless and how uncorrelated are identifiers of that encoding and length, made of
words of the corpus.  The three p-values are joined again, corrected for their dependence
(Brown's method).  What the battery refutes as random is no key if ordinary text explains it better;
so a run of marks is none, and an uncommonly regular key still is one.

False discoveries are controlled over the whole corpus.  The p-values under ordinary text are
counted by encoding and length; the weighted Benjamini-Hochberg procedure, which gives
longer candidates a larger share of the allowed error, turns the counts into one
threshold for each encoding and length.  Each candidate is then decided by its own p-value, whatever
else stands in its text.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, slices, texts
from .pii import span_digests

KINDS = ("assign", "access", "hex")
#: Kind of the spans that the battery adds.
RANDOM = "random"

#: A name's text is found first; what follows it is matched there.
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, in order."""
    out = []
    if _NAMES.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                out.append((m.start(), 1, m.end()))
    # a hex run is maximal, so short ones may be passed over in the pattern itself
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    out.sort()
    return out


#: Alphabets in order of size; the order of characters is that of their codes. Fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "small letters": "abcdefghijklmnopqrstuvwxyz",
    "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_CODES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
#: Words of which ordinary identifiers are made where the corpus has too few. Fixed values.
WORDS = (
    "about access account action active address after agent alert all amount any api app archive array asset audit auth author backup balance base batch before block body book branch buffer build button cache "
    "call cancel card case catalog change channel chart check child city class clean client close cloud code color column command comment common company complete config connect contact content context control "
    "copy core cost count country create current customer data date day debug default delete depth detail device digest document domain download draft edit email enable end engine entry error event export field "
    "file filter find first flag float folder form format from function get graph group handle header height help history home host house image import index info input insert item job join key label language "
    "last layer left length level library line link list load local lock log long machine main manager map mark master match max member memory menu message method metric mode model module money month move name"
).split()
#: Words that hold letters of the hexadecimal digits alone, and ordinary pieces of such runs. Fixed values.
HEX_PIECES = ("added", "bad", "bead", "beef", "cafe", "dad", "dead", "decade", "deed", "facade", "face", "fade", "feed", "0000", "00000000", "1111", "ffff", "2019", "2024", "123456", "100000", "42")


def _identifier(name: str, n: int, rng: random.Random, words: Sequence[str]) -> str:
    mark = {"base64": "/", "base64url": rng.choice("-_")}.get(name, "")
    if name in ("hex", "base36", "small letters"):
        style = "lower"
    else:
        style = "upper" if name in ("upper hex", "base32", "upper base36", "capitals") else rng.choice(("lower", "camel", "camel", "title", "upper"))
    digits = "234567" if name == "base32" else "" if name in ("small letters", "capitals", "letters") else "0123456789"
    parts: list[str] = []
    size = 0
    while size < n:
        word = rng.choice(HEX_PIECES if "hex" in name else words)
        if style == "title" or style == "camel" and parts:
            word = word.capitalize()
        if digits and rng.random() < 0.2:
            word += "".join(rng.choice(digits) for _ in range(rng.choice((1, 1, 2, 4))))
        word = word.upper() if style == "upper" else word
        parts.append(word + (mark if mark and rng.random() < 0.7 else ""))
        size += len(parts[-1])
    return "".join(parts)[:n]


def ordinary(name: str, n: int, rng: random.Random, words: Sequence[str] = WORDS, tries: int = 40) -> str:
    """An ordinary identifier of ``n`` characters whose encoding is ``name``: words, in the cases and with the marks that it allows, and numbers."""
    for _ in range(tries):
        token = _identifier(name, n, rng, words)
        if encoding(token) == name:
            break
    return token


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token; '=' may end it."""
    chars = set(token.rstrip("="))
    return next((name for name, codes in _CODES.items() if chars <= codes.keys()), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail, by the cube-root normal approximation (exact enough for df of 3 and more), or in closed form for even df."""
    if df % 2 == 0:
        half, term, total = x / 2, 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, math.exp(-half) * total) if half < 700 else 0.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return _normal_tail(z)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


#: The kind of each character of an alphabet (small letter, capital, digit, mark), and each kind's share.
_KINDS = {name: np.array([_kind(c) for c in chars]) for name, chars in ALPHABETS.items()}
_SHARES = {name: np.bincount(kinds, minlength=4) / len(kinds) for name, kinds in _KINDS.items()}


def battery(token: str, name: str, classes: int) -> tuple[float, int, float]:
    """Chi-squared of ``classes`` classes of the alphabet, runs of characters of one kind, lag-one correlation."""
    codes = _CODES[name]
    x = np.fromiter((codes[c] for c in token), dtype=np.int64, count=len(token))
    n, k = len(x), len(codes)
    counts = np.bincount(x * classes // k, minlength=classes)
    expected = n / k * np.bincount(np.arange(k) * classes // k, minlength=classes)
    kinds = _KINDS[name][x]
    centred = x - (k - 1) / 2
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    return float(((counts - expected) ** 2 / expected).sum()), 1 + int((kinds[1:] != kinds[:-1]).sum()), r


def _joined(p: tuple[float, float, float]) -> float:
    """Fisher's statistic of three p-values."""
    return -2 * sum(math.log(max(x, 1e-300)) for x in p)


def randomness(token: str, name: str) -> float:
    """P-value of the three tests together under uniform independent characters of the alphabet."""
    token = token.rstrip("=")
    n, k, share = len(token), len(_CODES[name]), _SHARES[name]
    classes = min(max(3, n // 5), k)
    chi, runs, r = battery(token, name, classes)
    change = 1 - float((share**2).sum())
    both = float((share * (1 - share) ** 2).sum()) - change * change
    var = max((n - 1) * change * (1 - change) + 2 * (n - 2) * both, 1e-9)
    of_runs = min(1.0, 2 * _normal_tail(max(0.0, abs(runs - 1 - (n - 1) * change) - 0.5) / math.sqrt(var)))
    return _chi2_tail(_joined((_chi2_tail(chi, classes - 1), of_runs, min(1.0, 2 * _normal_tail(abs(r) * math.sqrt(n))))), 6)


def _length_step(n: int) -> int:
    """Lengths at which ordinary text is measured: powers of 1.25 from 16 to about a thousand."""
    return round(16 * 1.25 ** min(18, math.floor(math.log(max(n, 16) / 16, 1.25) + 1e-9)))


def _ordinary_p(row, mean: np.ndarray, spread: np.ndarray) -> tuple[float, float, float]:
    """How likely ordinary text is as even, as restless and as uncorrelated."""
    z = (np.asarray(row) - mean) / spread
    return _normal_tail(-z[0]), _normal_tail(z[1]), _normal_tail(-z[2])


class Ordinary:
    """Ordinary text of each encoding and length, measured on identifiers made of ``words`` when it is first asked for."""

    def __init__(self, words: Sequence[str] = WORDS, samples: int = 300):
        self.words, self.samples, self._moments = list(words), samples, {}

    def __getstate__(self):
        return {"words": self.words, "samples": self.samples, "_moments": {}}

    def moments(self, name: str, step: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Mean and spread of the three statistics per character in identifiers of a length, and those of their joint statistic."""
        if (name, step) not in self._moments:
            rng = random.Random(f"{name} {step}")
            rows = []
            for _ in range(self.samples):
                chi, runs, r = battery(ordinary(name, step, rng, self.words), name, len(_CODES[name]))
                rows.append((chi / step, runs / step, abs(r)))
            found = np.array(rows)
            mean, spread = found.mean(axis=0), np.maximum(found.std(axis=0), 1e-3)
            joint = np.array([_joined(_ordinary_p(row, mean, spread)) for row in found])
            self._moments[name, step] = mean, spread, float(joint.mean()), float(max(joint.var(), 1e-3))
        return self._moments[name, step]

    def p_value(self, token: str, name: str) -> float:
        """P-value of the three statistics together under ordinary text of the token's encoding and length."""
        token = token.rstrip("=")
        n = len(token)
        step = _length_step(n)
        mean, spread, joint, var = self.moments(name, step)
        chi, runs, r = battery(token, name, len(_CODES[name]))
        statistic = _joined(_ordinary_p((chi / n, runs / n, abs(r)), mean, spread * math.sqrt(step / n)))
        scale, df = var / (2 * joint), 2 * joint * joint / var
        z = ((statistic / scale / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        return _normal_tail(z)


#: Bins of p-values: eight in a power of ten, down to 1e-30.
_BINS, _LOWEST = 8, -30


def _bin(p: float) -> int:
    """The bin of a p-value, whose upper edge is 10 ** ((bin + 1) / 8)."""
    return min(-1, math.floor(_BINS * max(_LOWEST, math.log10(max(p, 1e-300)))))


def tested(text: str, model: Ordinary, refute: float = 0.001) -> list[tuple[int, int, str, int, int]]:
    """(start, end, encoding, length, bin of the p-value) of each candidate; the length is that at which ordinary text is measured."""
    out = []
    for m in _CANDIDATE.finditer(text):
        token = m.group()
        name = encoding(token)
        if name is None or token.isdigit():
            continue
        p, as_random = model.p_value(token, name), randomness(token, name)
        if as_random < refute and as_random <= p:
            p = 1.0
        out.append((*m.span(), name, _length_step(len(token.rstrip("="))), _bin(p)))
    return out


def thresholds(counts: list[tuple[str, int, int, int]], level: float) -> dict[tuple[str, int], int]:
    """The last bin found of each (encoding, length), from counts (encoding, length, bin, candidates).

    Weighted Benjamini-Hochberg: p-values are divided by their weight, the length up to 64 in ratio to its mean over
    all candidates; the largest such value at which the error expected is within ``level`` of what is found is the
    limit.  A bin counts with its upper edge, so that the control errs to the safe side.
    """
    total = sum(n for *_, n in counts)
    if not total:
        return {}
    mean = sum(min(step, 64) * n for _, step, _, n in counts) / total
    edge = lambda step, b: 10 ** ((b + 1) / _BINS) * mean / min(step, 64)
    limit, found, of_edge = 0.0, 0, {}
    for _, step, b, n in counts:
        of_edge[edge(step, b)] = of_edge.get(edge(step, b), 0) + n
    for q in sorted(of_edge):
        found += of_edge[q]
        if q <= level * found / total:
            limit = q
    out: dict[tuple[str, int], int] = {}
    for name, step, b, _ in counts:
        if edge(step, b) <= limit:
            out[name, step] = max(b, out.get((name, step), b))
    return out


def words_of_corpus(docs: DataFrame, text_col: str, most: int) -> list[str]:
    """The commonest words of three to ten letters in all texts; with fixed ones where these are few.

    Words are counted in each task first, so that no text is moved.
    """
    texts = docs.select(docs[text_col].alias("text")).where("text is not null")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z0-9])([a-z]{3,10})(?![a-z0-9])"), 1)).alias("word"))
    found = [r["word"] for r in words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()]
    return found if len(found) >= len(WORDS) else [*found, *WORDS]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", refute: float = 0.001, level: float = 1e-3, vocabulary: int = 1000) -> DataFrame:
    """(doc_id, base array<struct>, added array<struct>) for every row; structs are (kind, start, end) in code points.

    One scan of the texts writes base spans and candidates with the bin of their p-value; candidates that touch a
    base span are left out.  Bins are counted by encoding and length in each task first;
    the driver holds those counts, at most some hundred classes of 240 bins, and the words of
    ``words_of_corpus``, at most ``vocabulary``, counted in a scan of its own.

    Null and empty texts have no spans; bytes that are not UTF-8 are read as the
    replacement character; repeated rows are searched each; no rows give no rows; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    model = Ordinary(words_of_corpus(docs, text_col, vocabulary))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    test = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("length", pa.int32()), ("bin", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                base, tests = [], []
                for text in texts(part.column(1)):
                    found = base_spans(text) if text else []
                    base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
                    more = tested(text, model, refute) if text else []
                    tests.append([{"start": s, "end": e, "name": n, "length": l, "bin": b} for s, e, n, l, b in more if not any(x < e and s < z for x, _, z in found)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(span)), pa.array(tests, pa.list_(test))], ["doc_id", "base", "tests"])

    source = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {source.schema[0].dataType.simpleString()}, base array<struct<kind:string,start:bigint,end:bigint>>, tests array<struct<start:bigint,end:bigint,name:string,length:int,bin:int>>"
    rows = scratch.keep(source.mapInArrow(run, schema), "tested")
    counts = rows.select(F.explode("tests").alias("t")).groupBy("t.name", "t.length", "t.bin").agg(F.count("*").alias("n")).collect()
    last = thresholds([(r["name"], r["length"], r["bin"], r["n"]) for r in counts], level)
    limits = F.from_json(F.lit(json.dumps({f"{name} {step}": b for (name, step), b in last.items()})), "map<string,int>")
    passed = F.filter("tests", lambda t: t["bin"] <= F.try_element_at(limits, F.concat_ws(" ", t["name"], t["length"].cast("string"))))
    added = F.transform(passed, lambda t: F.struct(F.lit(RANDOM).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return rows.select("doc_id", "base", added.alias("added"))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return span_digests(find(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS, (RANDOM,))
