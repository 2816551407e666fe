"""N-gram Jaccard join by a grouped prefix join.

A document is its set of distinct k-word shingles.  All sets are ordered by one
global order: shingles that few documents hold before those that many hold.  Two
sets that link share a shingle among their prefixes, and sizes within the
threshold's ratio.

1. A scan counts how many documents hold each shingle and keeps two bitmaps of the
   frequent ones.  They shape the order and nothing else: any order gives the same links.
2. Documents of equal sets are one node; nodes of equal prefix and size form one
   group, and only groups post their prefix.
3. Shingles posted by one group alone are dropped.  Groups are expanded to nodes.
4. Candidates pass a bound from parity sketches, then are verified on whole sets.
   Instead of all pairs of a posting, each round ties its nodes to one hub, so a round is
   linear in the postings; linked nodes merge into components, and postings whose
   nodes are all in one component are done.  For the few that are left, pairs between
   different components are compared by size, place and sketch inside the join, and what
   passes is verified, so no link that joins two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, components, filter_bits, key_filter, marked, slices
from .wordhash import Words, mix, shingle_sets

#: Bytes of text that a worker shingles at a time.
PIECE = 1 << 19
#: Bits of the bitmap of each level of frequent shingles: 4 MB.
LEVEL_BITS = 1 << 25
#: Shingles that a counting task holds; beyond twice as many it drops the rarest.
HELD = 1 << 20
#: Bits of a sketch, in 64-bit words.
SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must post: n - least overlap with any partner + 1."""
    least = -((-percent * n) // 100)
    return np.where(n > 0, n - least + 1, 0)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ---------------------------------------------------------------- the order


def count_keys(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts with the keys ``more`` added; beyond ``2 * held`` keys the rarest go."""
    x = np.concatenate([keys, more])
    n = np.concatenate([counts, np.ones(len(more), dtype=np.int64)])
    order = np.argsort(x)
    x, n = x[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    x, n = x[begin], np.add.reduceat(n, begin) if len(x) else n
    least = 1
    while len(x) > 2 * held:
        stay = n > least
        x, n, least = x[stay], n[stay], least * 2
    return x, n


def frequent_levels(scratch: Scratch, docs: DataFrame, k: int, least: int = 16, step: int = 16, bits: int = LEVEL_BITS) -> list[np.ndarray]:
    """Two bitmaps, by the low bits of a shingle: those of ``least`` documents or more, and of ``step`` times as many.

    All shingles of all documents are counted.  They are exchanged as sorted arrays of four
    bytes each, dealt out by other bits of the shingle, and a task that counts holds
    a bounded table.  ``least`` rises by powers of two until the shingles of a bitmap are an
    eighth of its bits at most.
    """
    spark = docs.sparkSession
    deal = 1 << min(16, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()))
    mask = np.uint64((deal << 32) - 1)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held) & mask)
        bucket = (x >> np.uint64(32)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(x) else np.zeros(0, int)
        ends = np.append(begin[1:], len(x))
        low = x.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array([low[a:z].tobytes() for a, z in zip(begin.tolist(), ends.tolist())], pa.binary())], ["bucket", "low"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 0, PIECE):
                _, x = shingle_sets(Words(part.column(0), lower=True), k)
                held.append(x)
                size += len(x)
                if size >= HELD:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, size = [], 0
        for batch in batches:
            for bucket, low in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.frombuffer(low.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
                size += len(held[-1])
                if size >= HELD:
                    keys, counts = count_keys(keys, counts, np.concatenate(held), HELD)
                    held, size = [], 0
        if size:
            keys, counts = count_keys(keys, counts, np.concatenate(held), HELD)
        often = counts >= least
        yield pa.RecordBatch.from_arrays([_signed(keys[often] & np.uint64(bits - 1)), pa.array(counts[often])], ["slot", "n"])

    counted = scratch.keep(docs.select("text").mapInArrow(scan, "bucket int, low binary").repartition("bucket").mapInArrow(count, "slot bigint, n bigint"), "frequent")
    sizes = {r[0]: r[1] for r in counted.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}
    floor = max(1, least).bit_length() - 1
    while sum(n for power, n in sizes.items() if power >= floor) > bits // 8:
        floor += 1
    out = []
    for at_least in (1 << floor, step << floor):
        slot = F.col("slot") + 1
        bitmap = counted.where(F.col("n") >= at_least).groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
        level = np.zeros(bits // 8, dtype=np.uint8)
        for r in bitmap.collect():  # at most bits / 8 bytes
            level[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
        out.append(level)
    scratch.drop(counted)
    return out


def level_of(x: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many of the bitmaps hold each shingle."""
    out = np.zeros(len(x), dtype=np.int64)
    for level in levels:
        slot = x & np.uint64(len(level) * 8 - 1)
        out += (level[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
    return out


# ---------------------------------------------------------------- scans of the texts


def _digest(d: np.ndarray, x: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Order-free hash of the values of each document."""
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(mix(x ^ np.uint64(salt)), out=total[1:])
    first = np.searchsorted(d, np.arange(n + 1))
    return mix(total[first[1:]] - total[first[:-1]] + np.uint64(salt))


def sketches(d: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """A row of bits for each document: whether the number of its shingles in each bucket of the hash space is odd.

    A bit that differs between two documents needs a shingle that one of them alone holds.
    """
    bucket = (x >> np.uint64(64 - (SKETCH_WORDS * 64 - 1).bit_length())).astype(np.int64)
    odd = np.bincount(d * SKETCH_WORDS * 64 + bucket, minlength=n * SKETCH_WORDS * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, SKETCH_WORDS)


class _Posting:
    """Scans of the texts; one per step, so that no set is written for documents that have no candidate."""

    def __init__(self, k: int, percent: int, levels):
        self.k, self.percent, self.levels = k, percent, levels

    def _pieces(self, batches: Iterator[pa.RecordBatch], column: int):
        for batch in batches:
            for part in slices(batch, column, PIECE):
                w = Words(part.column(column), lower=True)
                d, x = shingle_sets(w, self.k)
                yield part, len(w), d, x, np.bincount(d, minlength=len(w))

    def _prefixes(self, d: np.ndarray, x: np.ndarray, sizes: np.ndarray):
        """(document, shingle, level, position, group of the documents) of the prefixes."""
        level = level_of(x, self.levels.value)
        order = np.argsort(d * 4 + level, kind="stable")  # by shingle within a level already
        d, x, level = d[order], x[order], level[order]
        position = np.arange(len(d)) - np.concatenate([[0], np.cumsum(sizes)])[d]
        keep = position < prefix_length(sizes, self.percent)[d]
        d, x, level, position = d[keep], x[keep], level[keep], position[keep]
        return d, x, level, position, _digest(d, x, len(sizes), 0x3C3C) ^ mix(sizes.astype(np.uint64))

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, size, set1, set2, grp, s0 .., and the columns after the text)."""
        for part, n, d, x, sizes in self._pieces(batches, 1):
            grp = self._prefixes(d, x, sizes)[-1]
            sketch = sketches(d, x, n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes.astype(np.int32)), _signed(_digest(d, x, n, 0x5151)), _signed(_digest(d, x, n, 0xA7A7)), _signed(grp), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)], *part.columns[2:]],
                ["doc_id", "size", "set1", "set2", "grp", *SKETCH, *part.schema.names[2:]],
            )

    def postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, grp, pos, often) for the distinct groups of a piece."""
        for _, n, d, x, sizes in self._pieces(batches, 0):
            pd_, px, level, pos, grp = self._prefixes(d, x, sizes)
            leads = np.zeros(n, dtype=bool)
            leads[np.unique(grp, return_index=True)[1]] = True
            keep = leads[pd_]
            pd_, px, level, pos = pd_[keep], px[keep], level[keep], pos[keep]
            yield pa.RecordBatch.from_arrays([_signed(px), _signed(grp[pd_]), pa.array(pos.astype(np.int32)), pa.array(level > 0)], ["h", "grp", "pos", "often"])

    def sets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, set1, items) for every document."""
        for part, n, d, x, sizes in self._pieces(batches, 1):
            cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), _signed(_digest(d, x, n, 0x5151)), pa.ListArray.from_arrays(pa.array(cuts), _signed(x))], ["doc_id", "set1", "items"])


# ---------------------------------------------------------------- candidates


def _needed(a, b, percent: int):
    """Least intersection of linked sets of sizes a and b."""
    return F.ceil((a + b) * percent / (100.0 + percent) - 1e-9)


def _fits(size, pos, other_size, other_pos, percent: int):
    """Whether two sets can link: by their sizes, and by what is left of both from a shingle that they share.

    At its first shared shingle, which both prefixes hold, a linking pair passes.
    """
    return (F.least(size, other_size) * 100 >= F.greatest(size, other_size) * percent) & (F.least(size - pos, other_size - other_pos) >= _needed(size, other_size, percent))


def _may_link(size, other_size, sketch, other_sketch, percent: int):
    """Whether the bits that differ, each a shingle of one set alone, leave enough for a link."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(sketch, other_sketch)), F.lit(0))
    return size + other_size - differ >= 2 * _needed(size, other_size, percent)


def _verified(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, source: DataFrame, posting: _Posting) -> DataFrame:
    """(a, b) of the pairs whose whole sets link; sets are made, by another scan of the texts, only for what is asked."""
    percent = posting.percent
    ends = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc", "set1"), "node"), "ends")
    bits = filter_bits(ends.count())
    asked = marked(source, "asked", key_filter(ends.select(F.col("doc").alias("doc_id")), "doc_id", bits=bits), "doc_id", bits=bits).where("asked")
    sets = asked.select("doc_id", "text").mapInArrow(posting.sets, "doc bigint, set1 bigint, items array<bigint>")
    # rows that repeat id and text give a set once; the exchange is that of the join
    keyed = sets.select(F.coalesce("doc", F.lit(0)).alias("doc"), "set1", "items").groupBy("doc", "set1").agg(F.first("items").alias("items"))
    keys = ends.select("node", F.coalesce("doc", F.lit(0)).alias("doc"), "set1")
    held = scratch.keep(keys.join(keyed, ["doc", "set1"]).select("node", "items"), "sets")
    both = pairs.select("a", "b").join(held.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    linked = scratch.keep(both.where(shared * 100 >= (total - shared) * percent).select("a", "b"), "linked")
    scratch.drop(ends, held)
    return linked


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 75,
    hub_rounds: int = 2,
    frequent: int = 16,
    carry: dict[str, Column] | None = None,
    label: str | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, *carry, label) for every row of ``docs``.

    ``carry`` adds expressions over ``docs``; ``label`` names a column that is the same in all
    rows of a component, whatever their ids, and null for a row without words.

    Words are lower-cased in A-Z.  A document of fewer than ``k`` words has its whole
    sequence as one shingle; one without words, or null, has none and links
    with nothing.  Sets link when 100 * intersection >= percent * union.
    Shingles of ``frequent`` documents or more are put last in the order.

    Defined results: each row is a document of its own, also one that repeats an id or
    has none; a component's id is the smallest id of its rows, null if none has one,
    and that of a row without words is its own; no rows give no rows; other columns are
    ignored.  Shingles are compared as 64-bit hashes, whole sets as 128-bit ones.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    source = bounded_batches(docs).select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"), *[c.alias(f"k{i}") for i, c in enumerate((carry or {}).values())])
    kept = source.columns[2:]
    posting = _Posting(k, percent, spark.sparkContext.broadcast(frequent_levels(scratch, source, k, frequent)))

    rows = scratch.keep(source.mapInArrow(posting.documents, "doc_id bigint, size int, set1 bigint, set2 bigint, grp bigint, " + ", ".join([*(f"{s} bigint" for s in SKETCH), *(f"{c} {source.schema[c].dataType.simpleString()}" for c in kept)])), "documents")
    nodes = rows.where("size > 0").groupBy("size", "set1", "set2", "grp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("mult"), *[F.min(s).alias(s) for s in SKETCH])
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    posted = source.select("text").mapInArrow(posting.postings, "h bigint, grp bigint, pos int, often boolean")
    # a shingle that is not frequent stands in few postings; one that is frequent is taken as shared
    by_shingle = Window.partitionBy("h", "salt")
    posted = posted.withColumn("salt", F.when(F.col("often"), F.pmod("grp", F.lit(997))))
    shared = posted.select("h", "grp", "pos", "often", F.min("grp").over(by_shingle).alias("low"), F.max("grp").over(by_shingle).alias("high")).where("often or low < high")
    shared = scratch.keep(shared.select("h", "grp", "pos"), "postings")

    # groups to nodes; a group of several nodes is a posting of its own
    members = nodes.select("grp", "node", "mult", "size")
    expanded = shared.distinct().join(members, "grp").select("h", "node", "mult", "size", "pos")
    crowd = members.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    inner = members.join(crowd, "grp", "left_semi").select(F.xxhash64("grp", F.lit("group")).alias("h"), "node", "mult", "size", F.lit(0).alias("pos"))
    posts = scratch.keep(expanded.unionByName(inner), "posts")
    scratch.drop(shared)

    ends = {e: nodes.select(F.col("node").alias(e), F.col("size").alias(f"size_{e}"), *[F.col(s).alias(f"{s}_{e}") for s in SKETCH]) for e in "ab"}
    sketch = {e: [F.col(f"{s}_{e}") for s in SKETCH] for e in "ab"}
    may_link = _may_link(F.col("size_a"), F.col("size_b"), sketch["a"], sketch["b"], percent)
    open_posts = posts.withColumn("component", F.col("node"))
    comp = edges = tested = None

    def settle(pairs: DataFrame) -> None:
        """Verify the pairs, add their links and merge components."""
        nonlocal comp, edges, tested
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = _verified(scratch, pairs, nodes, source, posting)
        edges = found if edges is None else edges.unionByName(found)
        comp = scratch.keep(components(scratch, edges), "components")

    for turn in range(hub_rounds):
        # the hub: the node with most copies at first, then one drawn anew for each posting and round
        place = ["node", "size", "component", "pos"]
        rank = F.struct(-F.col("mult"), *place) if turn == 0 else F.struct(F.xxhash64("h", "node", F.lit(turn)), *place)
        hubs = open_posts.groupBy("h").agg(F.min(rank).alias("hub"), F.count("*").alias("n")).where("n > 1")
        hubs = scratch.keep(hubs.select("h", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in place]), "hubs")
        fits = _fits(F.col("size"), F.col("pos"), F.col("hub_size"), F.col("hub_pos"), percent)
        pairs = open_posts.join(hubs, "h").where("component <> hub_component").where(fits).select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        pairs = pairs.join(ends["a"], "a").join(ends["b"], "b").where(may_link).select("a", "b")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        settle(scratch.keep(pairs, "pairs"))
        scratch.drop(hubs)
        labelled = posts.join(comp, "node", "left").select("h", "node", "mult", "size", "pos", F.coalesce("component", "node").alias("component"))
        labelled = scratch.keep(labelled, "labelled")
        # the pair of a posting of two has been seen
        mixed = labelled.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("h")
        open_posts = scratch.keep(labelled.join(mixed, "h", "left_semi"), "open")
        scratch.drop(labelled)
        if open_posts.isEmpty():
            break
    else:
        sided = open_posts.join(nodes.select("node", *SKETCH), "node")
        side = {e: sided.select("h", *[F.col(c).alias(f"{c}_{e}") for c in ("node", "size", "pos", "component", *SKETCH)]) for e in "ab"}
        fits = _fits(F.col("size_a"), F.col("pos_a"), F.col("size_b"), F.col("pos_b"), percent)
        rest = side["a"].join(side["b"], "h").where("node_a < node_b and component_a <> component_b").where(fits).where(may_link)
        rest = rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        settle(scratch.keep(rest, "rest"))
    scratch.drop(posts, open_posts)

    # the id of a component is the smallest of its documents
    labels = nodes.join(comp, "node", "left").select("size", "set1", "set2", "doc", F.coalesce("component", "node").alias("component"))
    labels = labels.join(labels.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("size", "set1", "set2", "component_id", "component")
    labels = scratch.keep(labels, "labels")
    more = [F.col(c).alias(name) for c, name in zip(kept, carry or {})] + ([F.col("component").alias(label)] if label else [])
    linked = rows.where("size > 0").join(labels, ["size", "set1", "set2"]).select("doc_id", F.col("size").cast("bigint").alias("n_shingles"), "component_id", *more)
    alone = rows.where("size = 0").withColumn("component", F.lit(None).cast("bigint"))
    return linked.unionByName(alone.select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int | None, str | None]], k: int = 5, percent: int = 75) -> list[tuple[int | None, int, int | None]]:
    """The definition, for tests: (id, n_shingles, component) of every row."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets, by = [], {}
    root = list(range(len(rows)))

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    for d, (_, text) in enumerate(rows):
        words = (text or "").encode().translate(lower).split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
        for e in {e for s in sets[d] for e in by.get(s, ())}:
            i = len(sets[d] & sets[e])
            if 100 * i >= percent * (len(sets[d]) + len(sets[e]) - i):
                root[find(d)] = find(e)
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    least = {}
    for d, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(d)] = min(least.get(find(d), doc_id), doc_id)
    return [(doc_id, len(sets[d]), least.get(find(d))) for d, (doc_id, _) in enumerate(rows)]
