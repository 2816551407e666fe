"""Language identification by cross-parsing.

For every language a suffix automaton of labelled text is built; a text is cut
into phrases, each the longest match in the automaton, and the language that
needs the fewest phrases, divided by what its own kind of text needs, wins.
Texts are parsed in blocks, all blocks of a batch and all languages at once, one
numpy step per character position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts

#: Characters of a block; a phrase ends where its block ends.
BLOCK = 256
#: Codes of a language that have a column in its table of moves.
WIDTH = 64
UNDETERMINED = "und"


class Alphabet:
    """A code for every letter of the training texts; all that is no letter is one separator."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for text in texts for c in set(text.lower()) if c.isalpha()})
        #: 0 separator, 1 a letter seen in no training text, 2.. the letters
        self.size = len(letters) + 2
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.table = np.fromiter((chr(p).isalpha() for p in range(0x110000)), dtype=self.kind, count=0x110000)
        for i, c in enumerate(letters):
            self.table[ord(c)] = i + 2

    def encode(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def automaton_moves(codes: list[int]) -> list[dict[int, int]]:
    """The moves of each state of the codes' suffix automaton; none leads to the first state."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def suffix_automaton(codes: list[int], size: int) -> np.ndarray:
    """The automaton's moves, a row per state and a column per letter; 0, the first state, where there is no move."""
    moves = automaton_moves(codes)
    out = np.zeros((len(moves), size), dtype=np.int32)
    for state, row in enumerate(moves):
        for c, to in row.items():
            out[state, c] = to
    return out


class Automaton:
    """One language's moves: a table for its ``WIDTH`` most frequent codes, sorted keys for the rest."""

    def __init__(self, codes: list[int], alphabet: Alphabet):
        found, counts = np.unique(np.array([c for c in codes if c], dtype=np.int64), return_counts=True)
        #: own codes by the alphabet's: 0 separator, 1 a letter that this automaton never read, 2.. by frequency
        self.own = np.ones(alphabet.size, dtype=alphabet.kind)
        self.own[0] = 0
        self.own[found[np.argsort(-counts, kind="stable")]] = np.arange(2, len(found) + 2)
        self.size = len(found) + 2
        self.width = min(self.size, WIDTH)
        moves = automaton_moves(self.own[codes].tolist() if codes else [])
        self.flat = np.zeros(len(moves) * self.width, dtype=np.int32)
        rare = {}
        for state, row in enumerate(moves):
            for c, to in row.items():
                if c < self.width:
                    self.flat[state * self.width + c] = to
                else:
                    rare[state * self.size + c] = to
        self.keys = np.array(sorted(rare), dtype=np.int64)
        self.to = np.array([rare[k] for k in self.keys.tolist()], dtype=np.int32)
        self.first = np.zeros(self.size, dtype=np.int32)
        for c, to in moves[0].items():
            self.first[c] = to

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states that follow; 0 where there is no move."""
        if not len(self.keys):
            return self.flat[state * self.width + c]
        beyond = np.flatnonzero(c >= self.width)
        if not len(beyond):
            return self.flat[state * self.width + c]
        out = self.flat[state * self.width + np.minimum(c, self.width - 1)]
        key = state[beyond].astype(np.int64) * self.size + c[beyond]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[beyond] = np.where(self.keys[at] == key, self.to[at], 0)
        return out


def leave_out(texts: list[str], every: int = 5) -> tuple[list[str], list[str]]:
    """Texts for the automaton and texts for its norm: each ``every``-th is left out; of fewer texts, the end of each."""
    if len(texts) >= every:
        return [t for i, t in enumerate(texts) if i % every != every - 1], texts[every - 1 :: every]
    cuts = [len(t) - len(t) // every for t in texts]
    return [t[:n] for t, n in zip(texts, cuts)], [t[n:] for t, n in zip(texts, cuts) if n < len(t)]


class CrossParser:
    """Phrases that each language needs for a text."""

    def __init__(self, training: dict[str, list[str]], max_chars: int = 30_000):
        """``max_chars``: the bound on training characters of each language, and on those left out of its automaton."""
        self.languages = sorted(training)
        kept = {language: leave_out(training[language]) for language in self.languages}
        self.alphabet = Alphabet([t for texts in training.values() for t in texts])
        self.automata = []
        for language in self.languages:
            codes: list[int] = []
            for text in kept[language][0]:
                piece = self.alphabet.encode(text[: max_chars - len(codes)])
                if len(piece):
                    keep = np.ones(len(piece), dtype=bool)
                    keep[1:] = (piece[1:] != 0) | (piece[:-1] != 0)  # runs of separators are one
                    codes += [*piece[keep].tolist(), 0]
                if len(codes) >= max_chars:
                    break
            self.automata.append(Automaton(codes, self.alphabet))
        self.norms = self._measure([kept[language][1] for language in self.languages], max_chars)

    def _measure(self, left_out: list[list[str]], max_chars: int) -> np.ndarray:
        """Phrases per character that each language needs for its own text left out of its automaton.

        A language without such text gets the mean of the others.
        """
        norms = np.full(len(left_out), np.nan)
        for column, texts in enumerate(left_out):
            sample, chars = [], 0
            for text in texts:
                sample.append(text[: max_chars - chars])
                chars += len(sample[-1])
                if chars >= max_chars:
                    break
            used = sum(map(self._length, sample))
            if used:
                norms[column] = self.phrases(sample)[:, column].sum() / used
        known = norms[~np.isnan(norms)]
        return np.where(np.isnan(norms), known.mean() if len(known) else 1.0, norms)

    def _length(self, text: str) -> int:
        """Characters parsed: runs of separators are one; 0 for a text without a letter."""
        codes = self.alphabet.encode(text)
        return int((codes[1:].astype(bool) | codes[:-1].astype(bool)).sum()) + 1 if codes.any() else 0

    def phrases(self, texts: list[str]) -> np.ndarray:
        """A row per text, a column per language."""
        parts, owners, lengths = [], [], []
        for i, text in enumerate(texts):
            codes = self.alphabet.encode(text)
            if len(codes) > 1:
                keep = np.ones(len(codes), dtype=bool)
                keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
                codes = codes[keep]
            blocks = -(-len(codes) // BLOCK)
            padded = np.zeros(blocks * BLOCK, dtype=self.alphabet.kind)
            padded[: len(codes)] = codes
            parts.append(padded)
            owners.append(np.full(blocks, i))
            lengths.append(np.minimum(len(codes) - np.arange(blocks) * BLOCK, BLOCK))
        grid = np.ascontiguousarray(np.concatenate(parts).reshape(-1, BLOCK).T) if parts else np.zeros((BLOCK, 0), self.alphabet.kind)
        owner = np.concatenate(owners) if owners else np.zeros(0, int)
        used = np.concatenate(lengths) if lengths else np.zeros(0, int)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        order = np.argsort(-used, kind="stable")  # full blocks first, so that short ones drop off the end
        grid, owner, used = np.ascontiguousarray(grid[:, order]), owner[order], used[order]
        alive = np.searchsorted(-used, -np.arange(BLOCK), side="left")  # blocks with more than t characters
        for column, automaton in enumerate(self.automata):
            state, count, own = np.zeros(len(owner), dtype=np.int32), np.ones(len(owner), dtype=np.int64), automaton.own[grid]
            for t in range(BLOCK):
                n = alive[t]
                if not n:
                    break
                c = own[t, :n]
                nxt = automaton.step(state[:n], c)
                ended = np.flatnonzero(nxt == 0)
                if len(ended):
                    count[ended] += 1
                    nxt[ended] = automaton.first[c[ended]]
                state[:n] = nxt
            np.add.at(out[:, column], owner, count)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ties go to the language first in order."""
        has_letter = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        need = self.phrases([t if ok else "" for t, ok in zip(texts, has_letter)]) / self.norms
        names, scores = [], []
        for ok, row in zip(has_letter, need):
            if not ok or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            names.append(self.languages[best])
            scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
        return names, scores


def training_texts(labelled: DataFrame, per_language: int = 200, max_chars: int = 30_000, max_languages: int = 256) -> dict[str, list[str]]:
    """A bounded sample for each language: the ``per_language`` rows whose id hashes lowest, an eighth of ``max_chars`` of each text.

    The sample is bounded by its parameters: of more than ``max_languages`` labels the commonest are
    learned, of equally common ones the first by name.  The rank filter is applied before rows are exchanged.
    """
    counted = labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    if len(counted) > max_languages:
        labelled = labelled.where(F.col("lang").isin([r["lang"] for r in counted[:max_languages]]))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    cut = F.substring("text", 1, max_chars // 8)  # so that a language is learned from eight texts at least
    rows = labelled.where("lang is not null and length(text) > 0").select("doc_id", "lang", cut.alias("text")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    out: dict[str, list[str]] = {}
    for row in rows.orderBy("lang", "n").select("lang", "text").collect():
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200, max_chars: int = 30_000, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, *keep) for every row of ``docs``; learned from ``labelled`` alone.

    ``lang_pred`` is a label of ``labelled``, or ``und`` for a text that is null or
    has no letter.  ``score`` is one less the share of phrases, each divided by its
    language's norm, that the winner needs of what the next language needs; 1 if there is but one language, 0 for
    ``und``.  Labels that are null teach nothing; without labels all is ``und``;
    repeated rows are judged each; no rows give no rows; bytes that are not UTF-8 are read as the
    replacement character.  Columns named in
    ``keep`` pass through unread.
    """
    source = labelled.select(labelled[id_col].alias("doc_id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang"))
    parser = CrossParser(training_texts(source, per_language, max_chars), max_chars)
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                names, scores = model.predict(texts(part.column(1)))
                rest = [part.column(at) for at in places]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *rest], ["doc_id", "lang_pred", "score", *[f"k{i}" for i in range(len(keep))]])

    # id and text go to the workers once, also if they are among the columns kept
    others = [c for c in keep if c not in (id_col, text_col)]
    places = [0 if c == id_col else 1 if c == text_col else 2 + others.index(c) for c in keep]
    source = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    out = source.mapInArrow(run, f"doc_id {kinds['doc_id']}, lang_pred string, score double" + "".join(f", k{i} {source.schema[at].dataType.simpleString()}" for i, at in enumerate(places)))
    return out.select("doc_id", "lang_pred", "score", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def held_out(doc_id: Column) -> Column:
    """Whether a document may teach nothing; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, docs.where(~held_out(docs["doc_id"])))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
