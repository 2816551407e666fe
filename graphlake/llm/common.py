"""What the operators share: batch slicing, hashed key sets, connected components, vectors of integers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch


#: Bytes of a batch of rows that goes to a Python worker; texts may be long, and a batch is held on both sides.
BATCH_BYTES = 4 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session cuts batches for Python workers by bytes too, not by rows alone; a bound that is set stays."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    unset = str(BATCH_BYTES + 1)
    if conf.get(name, unset) == unset:
        conf.set(name, str(BATCH_BYTES))
    return docs


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts take about ``max_bytes``; one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts(column: pa.Array) -> list[str | None]:
    """The texts of a string column; bytes that are not UTF-8 become the replacement character."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


#: Bits of a hashed set of keys: 1 MB at first, and by the number of keys up to 32 MB.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 28


def filter_bits(keys: int) -> int:
    """Bits for a set of ``keys``: eight for each, a power of two between the bounds."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (8 * keys).bit_length()))


def key_filter(keys: DataFrame, *columns: str, bits: int = FILTER_BITS) -> DataFrame:
    """A hashed set of keys as at most ``bits / 32768`` bitmaps of 4 kB (bucket, bitmap), fit to be broadcast."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits)).cast("long") + 1
    bucketed = keys.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    return bucketed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def marked(df: DataFrame, name: str, filters: DataFrame, *columns: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with boolean ``name``: true for every key in the set, and for others by chance; no exchange.

    Only ever saves work: what it marks is decided exactly later.  Keys beyond
    what the largest set holds are marked by chance more and more, up to all, which then
    are joined in partitions; results stay the same.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits)).cast("long") + 1
    bucket, bit_at, bitmap = (f"{name}_{x}_{uuid.uuid4().hex}" for x in ("bucket", "bit", "bitmap"))
    tested = df.withColumns({bucket: F.bitmap_bucket_number(slot), bit_at: F.bitmap_bit_position(slot)})
    found = F.broadcast(filters.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast({bit_at} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit_at} % 8 as int))")) != 0, F.lit(False))
    return tested.join(found, bucket, "left").withColumn(name, bit).drop(bucket, bit_at, bitmap)


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Rounds of large-star and small-star rewrites, each a partial aggregation and
    one join; the number of rounds grows as the logarithm of a component's size.
    A node joined to very many others is an ordinary group-by key: its smallest
    neighbour is found by a map-side minimum, and the join that hands it back to
    the edges reads a written table, so that the planner may split a hot key.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the smallest node near u
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.keep(large, "large")
        # small star: u and its smaller neighbours are tied to the smallest of them
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        small = scratch.keep(small.where("u > v").distinct(), "small")
        scratch.drop(now, low, large, low2)
        now = small
        # done when each node has one edge and that goes to a node without one
        edges_left, nodes_left = now.agg(F.count("*"), F.count_distinct("u")).first()
        if edges_left == nodes_left and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def whole_vector(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift of every component as longs; null where the vector or a component is null, not finite, or passes 2^53."""
    doubles = vector.cast("array<double>")
    fits = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 53)))
    return F.when(fits, F.transform(doubles, lambda c: F.floor(c * scale) + F.lit(shift).cast("bigint")))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, whose lists have one length and no nulls, as a matrix with a row for each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal, evaluated inside the engine."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
