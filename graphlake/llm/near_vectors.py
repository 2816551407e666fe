"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits recursively at the median of a random projection; vectors close
to a split go to both sides (spill).  Vectors that share a leaf of some tree are
compared, in double precision; links are counted once, in the first leaf that a
pair shares, and joined into components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components


class Tree:
    """One tree: arrays of node directions, thresholds and children; children under 0 are leaves -1-n."""

    def __init__(self, sample: np.ndarray, leaf: int, spill: float, seed: int):
        self.rng, self.leaf, self.spill = np.random.default_rng(seed), leaf, spill
        self.directions: list[np.ndarray] = []
        self.thresholds: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, 0)

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        if len(rows) > self.leaf and depth < 40:
            direction = self.rng.standard_normal(rows.shape[1])
            direction /= np.linalg.norm(direction)
            value = rows @ direction
            cut = float(np.median(value))
            low, high = value <= cut + self.spill, value > cut - self.spill
            # a split that leaves nearly all rows on both sides tells nothing apart
            if max(low.sum(), high.sum()) < 0.95 * len(rows):
                at = len(self.directions)
                self.directions.append(direction)
                self.thresholds.append(cut)
                self.children.append([0, 0])
                self.children[at][0] = self._grow(rows[low], depth + 1)
                self.children[at][1] = self._grow(rows[high], depth + 1)
                return at
        self.leaves += 1
        return -self.leaves

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; a row is in one leaf at least."""
        out_rows, out_leaves, todo = [], [], [(self.root, np.arange(len(rows)))]
        while todo:
            at, some = todo.pop()
            if not len(some):
                continue
            if at < 0:
                out_rows.append(some)
                out_leaves.append(np.full(len(some), -1 - at))
                continue
            value = rows[some] @ self.directions[at]
            cut = self.thresholds[at]
            todo.append((self.children[at][0], some[value <= cut + self.spill]))
            todo.append((self.children[at][1], some[value > cut - self.spill]))
        if not out_rows:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def _unit(column: pd.Series) -> np.ndarray:
    """Vectors of length 1; each is divided by its largest component first, so that none over- or underflows."""
    m = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))
    largest = np.abs(m).max(axis=1)
    m = m / np.where(largest > 0, largest, 1)[:, None]
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1)[:, None]


def compare(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    return a @ b.T >= cosine


def _local_labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable by links, for a square symmetric table."""
    label = np.arange(len(linked))
    big = len(linked)
    while True:
        near = np.where(linked, label[None, :], big).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links_of(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Link counts and spanning edges of one pair of blocks of a leaf (one block if they are the same)."""
    left = pdf[pdf["side"] != 1].reset_index(drop=True)
    right = left if (pdf["bi"].iloc[0] == pdf["bj"].iloc[0]) else pdf[pdf["side"] == 1].reset_index(drop=True)
    same = right is left
    empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})
    if not len(left) or not len(right):
        return empty
    x = _unit(left["embedding"])
    y = x if same else _unit(right["embedding"])
    linked = compare(x, y, cosine)
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return empty
    # a pair counts in the first leaf that it shares: drop it where an earlier leaf holds both
    leaf = int(pdf["leaf"].iloc[0])
    earlier_l = [[m for m in row if m < leaf] for row in left["member"]]
    earlier_r = earlier_l if same else [[m for m in row if m < leaf] for row in right["member"]]
    ids = {m: i for i, m in enumerate(sorted({m for row in earlier_l for m in row} & {m for row in earlier_r for m in row}))}

    def indicator(rows):
        out = np.zeros((len(rows), max(1, len(ids))), dtype=np.float32)
        for i, row in enumerate(rows):
            for m in row:
                if m in ids:
                    out[i, ids[m]] = 1
        return out

    mine = indicator(earlier_l)
    first = linked & (mine @ (mine if same else indicator(earlier_r)).T == 0)
    node_l, node_r = left["node"].to_numpy(), right["node"].to_numpy()
    if same:
        counts = [(node_l, first @ left["mult"].to_numpy(dtype=np.float64))]
        table = linked
        nodes = node_l
    else:
        counts = [(node_l, first @ right["mult"].to_numpy(dtype=np.float64)), (node_r, left["mult"].to_numpy(dtype=np.float64) @ first)]
        n = len(node_l)
        table = np.zeros((n + len(node_r),) * 2, dtype=bool)
        table[:n, n:], table[n:, :n] = linked, linked.T
        nodes = np.concatenate([node_l, node_r])
    label = nodes[_local_labels(table)]
    out = [pd.DataFrame({"node": v[c > 0], "n": np.rint(c[c > 0]).astype("int64"), "other": v[c > 0]}) for v, c in counts]
    tied = label != nodes
    out.append(pd.DataFrame({"node": nodes[tied], "n": 0, "other": label[tied]}))
    return pd.concat(out, ignore_index=True)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.95,
    trees: int = 4,
    leaf_rows: int = 600,
    sample_rows: int = 20_000,
    block_rows: int = 1536,
    max_lengths: int = 16,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    * Equal vectors are one class with a count; classes are compared, and counts
      carried, so copies are never expanded into pairs.
    * Splits are fitted on at most ``sample_rows`` classes, those whose id hashes
      lowest; every class is then sent down every tree.  Leaves are sized so that
      the average one holds about ``leaf_rows`` classes as far as the sample can
      tell them apart.
    * A leaf of more than ``block_rows`` classes is cut into blocks and compared
      block by block, each pair of blocks a group of its own, so no task grows
      with a leaf.
    * The spill is half the spread that the projection of a pair at the
      threshold has.

    Defined results: vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null id, link with nothing (a null id's component
    is null); vectors of different length are never linked, and those of other than the
    ``max_lengths`` commonest lengths are compared with all of their length; rows that repeat an id
    count as vectors of their own but share its row's values; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    v = vectors[vector_col].cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors[id_col].isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    base = vectors.select(vectors[id_col].alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), v).alias("embedding"))
    base = base.select("vec_id", "embedding", F.xxhash64(F.lit(1), "embedding").alias("k1"), F.xxhash64(F.lit(2), "embedding").alias("k2"), F.size("embedding").alias("dim"))
    usable = base.where("embedding is not null")
    classes = scratch.keep(usable.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"), F.first("embedding").alias("embedding")), "classes")
    by_length = classes.groupBy("dim").agg(F.count("*").alias("n"))
    sizes = {r["dim"]: r["n"] for r in by_length.orderBy(F.desc("n"), "dim").limit(max_lengths).collect()}

    def within_leaves(placed: DataFrame) -> DataFrame:
        """Links within leaves: blocks of a leaf meet pairwise, each pair of blocks a group of its own."""
        in_leaf = placed.select("node", "mult", "embedding", "member", F.explode("member").alias("leaf"))
        leaf_sizes = in_leaf.groupBy("leaf").agg(F.count("*").alias("rows")).where("rows > 1").select("leaf", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"))
        blocked = in_leaf.join(leaf_sizes, "leaf").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int"))
        pairs = blocked.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
            "leaf", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), F.when(F.col("b") > F.col("o"), 1).otherwise(0).alias("side"), "node", "mult", "embedding", "member"
        )
        return pairs.groupBy("leaf", "bi", "bj").applyInPandas(lambda pdf: _links_of(pdf, cosine), "node bigint, n bigint, other bigint")

    # vectors of the rarer lengths, of which there may be any number, are compared with all of their length
    rare = classes.where(~F.col("dim").isin(list(sizes))) if sizes else classes
    parts = [within_leaves(rare.select("node", "mult", "embedding", F.array(F.col("dim").cast("bigint")).alias("member")))]
    for dim, n in sorted(sizes.items()):
        own = classes.where(F.col("dim") == dim)
        rows = own.orderBy(F.xxhash64("node"), "node").select("embedding").limit(sample_rows).toPandas()["embedding"]
        sample = _unit(rows)
        leaf = max(24, int(leaf_rows * len(sample) / n))
        spill = 0.5 * float(np.sqrt(2 - 2 * cosine)) / float(np.sqrt(dim))
        forest = [Tree(sample, leaf, spill, seed + t) for t in range(trees)]
        shared = spark.sparkContext.broadcast(forest)

        def place(batches):
            for pdf in batches:
                unit = _unit(pdf["embedding"])
                member: list[list[int]] = [[] for _ in range(len(pdf))]
                for t, tree in enumerate(shared.value):
                    for r, x in zip(*(a.tolist() for a in tree.assign(unit))):
                        member[r].append(t << 32 | x)
                yield pd.DataFrame({"node": pdf["node"], "mult": pdf["mult"], "embedding": pdf["embedding"], "member": [sorted(m) for m in member]})

        placed = scratch.keep(own.select("node", "mult", "embedding").mapInPandas(place, "node bigint, mult bigint, embedding array<double>, member array<bigint>"), "placed")
        parts.append(within_leaves(placed))

    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = scratch.keep(found, "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(scratch, found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_class = scratch.keep(
        classes.select("k1", "k2", "node", "mult").join(counts, "node", "left").join(labels, "node", "left").select(
            "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
        ),
        "result",
    )
    linked = usable.select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = base.where("embedding is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
