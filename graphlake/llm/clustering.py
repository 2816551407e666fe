"""Centroid clustering by sort-means, in exact integers.

Each round, the other centroids are put in order of their distance from every
centroid.  A vector starts at the centroid it had before and goes through the
others in that order; it stops at the first that lies strictly beyond twice its
distance from where it started, since by the triangle inequality neither that
one nor any later one can be as near.

A round is one pass without an exchange: tasks assign their rows and write them,
and add one row for each of their clusters with its count and sums.  Those few rows are
what the next centroids are made of; vectors never leave their task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, matrix, whole_vector

#: Integers below this are exact as doubles.
EXACT = 1 << 53


class Centroids:
    """Centroids of one round, and for each the others in order of distance from it."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.bound = max((abs(x) for row in rows for x in row), default=0)
        self._near: dict[tuple[int, bool], tuple] = {}

    def table(self, exact: bool) -> np.ndarray:
        return np.array(self.rows, dtype=np.float64 if exact else object)

    def near(self, c: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The others by rising squared distance from centroid ``c``, and those distances."""
        key = (c, table.dtype == object)
        if key not in self._near:
            apart = squares(table - table[c])
            order = np.argsort(apart, kind="stable")
            order = order[order != c]
            self._near[key] = order, apart[order]
        return self._near[key]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each row, and the number of distances computed; ties go to the smaller number."""
        most = max(self.bound, int(np.abs(x).max()) if x.size else 0)
        exact = 4 * most * most * max(1, x.shape[1]) * 4 < EXACT
        x, table = x.astype(np.float64 if exact else object), self.table(exact)
        start = squares(x - table[before])
        cluster, distance, computed = before.copy(), start.copy(), len(x)
        for c in np.unique(before).tolist():
            own = np.flatnonzero(before == c)
            own = own[np.argsort(-start[own], kind="stable")]
            order, apart = self.near(c, table)
            # rows stand by falling distance, so those that go on to an other centroid are the first ones
            scanning = np.searchsorted(-4 * start[own], -apart, side="right")
            rows, best, found = x[own], start[own].copy(), np.full(len(own), c)
            for other, n in zip(order.tolist(), scanning.tolist()):
                if not n:
                    break
                there = squares(rows[:n] - table[other])
                computed += n
                nearer = (there < best[:n]) | ((there == best[:n]) & (other < found[:n]))
                best[:n] = np.where(nearer, there, best[:n])
                found[:n] = np.where(nearer, other, found[:n])
            cluster[own], distance[own] = found, best
        return cluster, distance, computed

    def moved(self, sums: dict[int, list[int]], counts: dict[int, int]) -> "Centroids":
        """The means of non-empty clusters, rounded down; empty clusters keep their centroid."""
        return Centroids([[s // counts[c] for s in sums[c]] if counts.get(c) else row for c, row in enumerate(self.rows)])

    def digest(self, c: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[c])).encode()).hexdigest()


def squares(difference: np.ndarray) -> np.ndarray:
    """Sum of squares of each row."""
    if difference.dtype == object:
        return (difference * difference).sum(axis=1)
    return np.einsum("ij,ij->i", difference, difference)


def _round(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """Rows with their new cluster, then one row for each cluster of a task: its count, inertia and sums."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, x array<bigint>, cluster int, distance bigint, n bigint, inertia decimal(38,0), sums array<decimal(38,0)>"
    whole, k = pa.decimal128(38, 0), len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, inertia, sums, ids = [0] * k, [0] * k, [None] * k, pa.null()
        names = ["vec_id", "x", "cluster", "distance", "n", "inertia", "sums"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column(1)), batch.column(0).type
            cluster, distance, _ = centroids.assign(x, np.asarray(batch.column(2)).astype(np.int64))
            wide = int(np.abs(x).max()) * len(x) >= 1 << 62
            for c in np.unique(cluster).tolist():
                own = cluster == c
                total = (x[own].astype(object) if wide else x[own]).sum(axis=0)
                sums[c] = total.astype(object) if sums[c] is None else sums[c] + total.astype(object)
                counts[c] += int(own.sum())
                inertia[c] += sum(map(int, distance[own].tolist()))
            none = lambda t: pa.nulls(len(x), t)
            near = pa.array([int(d) for d in distance] if distance.dtype == object else distance.astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), near, none(pa.int64()), none(whole), none(pa.list_(whole))], names)
        full = [c for c in range(k) if counts[c]]
        if full:
            rows = [pa.nulls(len(full), ids), pa.nulls(len(full), pa.list_(pa.int64())), pa.array(full, pa.int32()), pa.nulls(len(full), pa.int64()), pa.array([counts[c] for c in full], pa.int64())]
            rows += [pa.array([Decimal(inertia[c]) for c in full], whole), pa.array([[Decimal(int(s)) for s in sums[c]] for c in full], pa.list_(whole))]
            yield pa.RecordBatch.from_arrays(rows, names)

    return bounded_batches(vectors).select("vec_id", "x", "cluster").mapInArrow(run, schema)


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    salt: str = "2",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector kept.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; each
    component becomes the integer floor(scale * x).  Centroids start as the
    ``clusters`` vectors of smallest SHA-256 of ``salt:id``; rows equal in it go by
    their components.  After ``rounds`` rounds vectors are assigned once more.
    Everything is exact: distances and sums are integers, means are rounded down.

    What the driver holds, and what goes to each task, are the centroids and their
    sums (``clusters`` times ``dims`` integers).  A round writes the vectors with their new cluster,
    where the next one starts, and drops the table of the round before.

    Defined results: vectors that are not kept give no row; a component whose integer
    passes 2^53 counts as non-finite, and a distance that no long holds raises; a null id starts and is
    assigned as an empty one; rows that repeat an id or a vector count each; with
    fewer vectors than ``clusters`` each is a centroid; no rows give no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clustering")
    x = whole_vector(vectors[vector_col], scale)
    kept = vectors.select(vectors[id_col].alias("vec_id"), F.when(F.size(vectors[vector_col]) == dims, x).alias("x")).where("x is not null")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids, now, before = Centroids([list(r["x"]) for r in first]), kept.withColumn("cluster", F.lit(0)), None
    for turn in range(rounds + 1):
        now = scratch.keep(_round(now, centroids), f"round-{turn}")
        if before is not None:
            scratch.drop(before)
        before = now
        shares = now.where("n is not null").select("cluster", "n", "inertia", F.posexplode("sums").alias("place", "value"))
        found = shares.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("value").alias("value")).collect()
        now = now.where("n is null")
        if turn < rounds:
            sums: dict[int, list[int]] = {}
            for r in sorted(found, key=lambda r: (r["cluster"], r["place"])):
                sums.setdefault(r["cluster"], []).append(int(r["value"]))
            centroids = centroids.moved(sums, {r["cluster"]: int(r["n"]) for r in found})
    inertia = {r["cluster"]: int(r["inertia"]) for r in found}
    facts = [{"inertia": inertia.get(c, 0), "digest": centroids.digest(c)} for c in range(len(centroids.rows))]
    fact = F.element_at(F.from_json(F.lit(json.dumps(facts)), "array<struct<inertia:bigint,digest:string>>"), F.col("cluster") + 1)
    return now.select("vec_id", "cluster", "distance", fact["inertia"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), fact["digest"].alias("centroid_sha256"))


def op12_cluster(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(clusters: int = 40, rounds: int = 5) -> str:
    """The rounds written out: components one a row, every distance computed."""
    parts = [
        "u as (select vec_id, unnest(range(64)) as place, cast(unnest(embedding) as double) as x from embeddings where len(embedding) = 64)",
        "v as (select vec_id from u group by vec_id having count(*) filter (where x is null or not isfinite(x)) = 0)",
        "e as (select vec_id, place, cast(floor(256 * x) as bigint) as x from u join v using (vec_id))",
        f"s as (select vec_id, row_number() over (order by sha256('2:' || cast(vec_id as varchar))) - 1 as c from v order by c limit {clusters})",
        "c0 as (select s.c, e.place, cast(e.x as hugeint) as x from s join e using (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} as (select vec_id, c, cast(sum((e.x - k.x) * (e.x - k.x)) as bigint) as d from e join c{r} k using (place) group by vec_id, c)")
        parts.append(f"a{r} as (select vec_id, arg_min(c, (d, c)) as c, min(d) as d from d{r} group by vec_id)")
        if r < rounds:
            parts.append(f"m{r} as (select c, place, cast(sum(x) as hugeint) as t, cast(count(*) as hugeint) as n from e join a{r} using (vec_id) group by c, place)")
            parts.append(f"c{r + 1} as (select k.c, k.place, case when n is null then k.x else (t - ((t % n) + n) % n) // n end as x from c{r} k left join m{r} m on m.c = k.c and m.place = k.place)")
    return (
        "with " + ",\n".join(parts) + f",\nh as (select c, sha256(string_agg(cast(x as varchar), ',' order by place)) as h from c{rounds} group by c)\n"
        "select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, h as centroid_sha256\n"
        f"from a{rounds} join h using (c)"
    )


ORACLE_SQL = _sql()
