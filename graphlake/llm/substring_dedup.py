"""Removal of repeated passages: seed and extend over winnowed anchors.

A window is ``length`` consecutive words.  In every window the smallest hash of
its ``anchor`` -word runs is the window's anchor (winnowing), so equal windows
have equal anchors at equal places, and the windows with one anchor stand side
by side: a run of words around the anchor.

1. Seeds: anchors whose hash occurs at least twice in the corpus.
2. Extension: an occurrence whose whole run equals the run of an earlier
   occurrence is repeated whole.  This settles nearly all, one row per anchor
   instead of one per window.
3. Where an anchor has runs of different text, the first holder of each run is
   extended step by step to both sides: each window of the run is compared by its
   hash with the windows of the other runs, so that all maximal repeats of
   ``length`` words or more are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, filter_bits, key_filter, marked, slices
from .wordhash import Words


#: Salt of the second half of a window's hash.
SECOND = 4


def anchor_runs(w: Words, length: int, anchor: int):
    """Runs of windows with one anchor: (document, first window's first word, windows, anchor hash, run hash)."""
    grams = w.windows(anchor)
    width = length - anchor + 1
    doc = w.owner()
    n = len(w.hash)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = np.arange(n - length + 1)
    whole = at + length <= w.first[doc[at] + 1]
    low = grams[: len(at)].copy()
    where = np.zeros(len(at), dtype=np.int8)
    for o in range(1, width):
        nxt = grams[o : o + len(at)]
        better = nxt < low  # of equal hashes the leftmost is the anchor
        where[better] = o
        np.minimum(low, nxt, out=low)
    at, low, place = at[whole], low[whole], at[whole] + where[whole]
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    first = at[begin]
    # the run's hash covers its words and where the anchor stands in them
    run = w.spans(first, first + size + length - 1) ^ (place[begin] - first).astype(np.uint64)
    return doc[first], first, size, low[begin], run


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, run, doc_id): a row per distinct anchor run of an id in a batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                doc, _, _, h, run = anchor_runs(Words(part.column(1)), length, anchor)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)[doc]
                order = np.lexsort((run, h, ids))
                ids, h, run = ids[order], h[order], run[order]
                new = np.ones(len(ids), dtype=bool)
                new[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]) | (run[1:] != run[:-1])
                yield pa.RecordBatch.from_arrays([_signed(h[new]), _signed(run[new]), pa.array(ids[new])], ["h", "run", "doc_id"])

    return docs.mapInArrow(scan, "h bigint, run bigint, doc_id bigint")


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, anchor: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of ``docs`` with the words that are not repeated.

    A word goes if a window that covers it has its word sequence starting earlier
    too: in a smaller id, or earlier in the same text.  ``kept`` is the other
    words joined by one space.

    Defined results: null and empty texts have no words; of rows that repeat an id the
    windows count as one text's, and each row is cut in the same way if its text is the
    same; a row with a null id has no place in the order, so that it is cut by what repeats inside
    its own text alone and cuts no other; texts
    shorter than a window keep all; no rows give no rows; other columns are ignored.
    Words are compared as 64-bit hashes, windows across texts as 128-bit ones.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    source = bounded_batches(docs).select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))

    rows = scratch.keep(_runs(source.where("doc_id is not null"), length, anchor), "runs")
    # seeds: anchors with two runs or two ids
    seeds = rows.groupBy("h").agg(F.min("run").alias("low"), F.max("run").alias("high"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    seeds = scratch.keep(seeds.where("low < high or first < last").select("h", "first", (F.col("low") < F.col("high")).alias("mixed")), "seeds")
    seen = scratch.keep(rows.join(seeds, "h").where("mixed or doc_id > first").select("h", "run", "doc_id", "mixed"), "seen")
    # of mixed anchors, each run has a first holder
    mixed = seen.where("mixed").select("h", "run", "doc_id")
    holder = scratch.keep(mixed.groupBy("h", "run").agg(F.min("doc_id").alias("holder")), "holders")
    settled = seen.where("not mixed").select("doc_id", "h", "run", F.lit(True).alias("whole")).unionByName(
        mixed.join(holder, ["h", "run"]).select("doc_id", "h", "run", (F.col("doc_id") > F.col("holder")).alias("whole"))
    )
    # a text's runs: repeated whole, or open, to be extended window by window
    scratch.drop(rows)
    lists = settled.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("whole"), F.struct("h", "run"))).alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.struct("h", "run"))).alias("open"),
    )
    lists = scratch.keep(lists, "lists")
    open_docs = lists.where(F.size("open") > 0).select("doc_id", "open")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                w = Words(part.column(1))
                doc, first, size, h, run = anchor_runs(w, length, anchor)
                at = _window_places(part, 2, doc, first, size, h, run)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                x, y, owner = w.windows(length)[at], w.windows(length, SECOND)[at], ids[w.owner()[at]]
                order = np.lexsort((owner, y, x))
                x, y, owner = x[order], y[order], owner[order]
                keep = np.ones(len(x), dtype=bool)
                keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([_signed(x[keep]), _signed(y[keep]), pa.array(owner[keep])], ["x", "y", "doc_id"])

    # only texts that have an open run cross an exchange here, and only those with a list below
    bits = filter_bits(open_docs.count())
    some = marked(source, "some", key_filter(open_docs, "doc_id", bits=bits), "doc_id", bits=bits).where("some").select("doc_id", "text")
    opened = some.join(open_docs, "doc_id").select("doc_id", "text", "open").mapInArrow(windows, "x bigint, y bigint, doc_id bigint")
    opened = scratch.keep(opened, "windows")
    low = scratch.keep(opened.groupBy("x", "y").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("x", "y", "low"), "low")
    later = opened.join(low, ["x", "y"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_list(F.struct("x", "y")).alias("later"))
    extra = lists.select("doc_id", "whole").join(later, "doc_id", "full_outer")
    extra, listed_rows = scratch.keep_counted(extra, "extra")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                w = Words(part.column(1))
                doc, first, size, h, run = anchor_runs(w, length, anchor)
                gone = np.zeros(len(w.hash) + 1, dtype=np.int64)
                at = _window_places(part, 2, doc, first, size, h, run)
                x = _both(w.windows(length), w.windows(length, SECOND))
                at = np.union1d(at, _hash_places(part, 3, w, x, length))
                at = np.union1d(at, _inner_repeats(w, x, length)).astype(np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + length, -1)
                removed = np.cumsum(gone[:-1]) > 0
                kept, raw = [], w.raw
                for d in range(len(w)):
                    a, z = w.first[d], w.first[d + 1]
                    stay = np.flatnonzero(~removed[a:z]) + a
                    kept.append(b" ".join([raw[s:e].tobytes() for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())]).decode())
                total = np.concatenate([[0], np.cumsum(removed)])
                n_removed = total[w.first[1:]] - total[w.first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts().astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept"])

    bits = filter_bits(listed_rows)
    both = marked(source, "some", key_filter(extra, "doc_id", bits=bits), "doc_id", bits=bits)
    none = F.lit(None)
    alone = both.where("not some").select("doc_id", "text", none.cast("array<struct<h:bigint,run:bigint>>").alias("whole"), none.cast("array<struct<x:bigint,y:bigint>>").alias("later"))
    listed = both.where("some").select("doc_id", "text").join(extra, "doc_id", "left").select("doc_id", "text", "whole", "later")
    kind = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return alone.mapInArrow(cut, kind).unionByName(listed.mapInArrow(cut, kind))


def _window_places(part: pa.RecordBatch, column: int, doc, first, size, h, run) -> np.ndarray:
    """First words of all windows of the runs that a list column of (h, run) names for each row."""
    lists = part.column(column)
    values = lists.flatten()
    if not len(values) or not len(doc):
        return np.zeros(0, dtype=np.int64)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    owner = np.repeat(np.arange(len(lists)), lengths)
    vh = np.asarray(values.field(0)).astype(np.int64).view(np.uint64)
    vr = np.asarray(values.field(1)).astype(np.int64).view(np.uint64)
    named = _members(np.asarray(doc), h ^ (run * np.uint64(3)), owner, vh ^ (vr * np.uint64(3)))
    f, s = first[named], size[named]
    return np.repeat(f, s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)


def _hash_places(part: pa.RecordBatch, column: int, w: Words, x: np.ndarray, length: int) -> np.ndarray:
    """First words of the windows whose hash a list column names for each row."""
    lists = part.column(column)
    values = lists.flatten()
    if not len(values) or not len(x):
        return np.zeros(0, dtype=np.int64)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    owner = np.repeat(np.arange(len(lists)), lengths)
    doc = w.owner()[: len(x)]
    whole = np.arange(len(x)) + length <= w.first[doc + 1]
    named = [np.asarray(values.field(i)).astype(np.int64).view(np.uint64) for i in (0, 1)]
    return np.flatnonzero(whole & _members(doc, x, owner, _both(*named)))


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One number of the two halves of a hash, for comparison inside one text."""
    return x + y * np.uint64(0xC2B2AE3D27D4EB4F)


def _members(doc: np.ndarray, x: np.ndarray, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each (doc, x) is among the pairs (owner, value)."""
    place = lambda d, v: v * np.uint64(0x9E3779B97F4A7C15) + (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    return np.isin(place(doc, x), place(owner, values))


def _inner_repeats(w: Words, x: np.ndarray, length: int) -> np.ndarray:
    """First words of windows that start earlier in the same text too."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    doc = w.owner()[: len(x)]
    at = np.flatnonzero(np.arange(len(x)) + length <= w.first[doc + 1])
    order = np.lexsort((at, x[at], doc[at]))
    at = at[order]
    same = np.zeros(len(at), dtype=bool)
    same[1:] = (x[at[1:]] == x[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    return at[same]


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = 20) -> dict[int, tuple[int, int, str]]:
    """The definition, for tests: id to (n_words, n_removed, digest of the kept words)."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = b" ".join(x for x, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
