"""Batches of a writer: pieces that stay together, in order, within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def _running(df: DataFrame, shelf_rows: int, **sums: str) -> DataFrame:
    """``df`` (repo, ord, ...) with, for each name, the sum of a column over the repository's rows before it.

    Sums go over shelves of neighbouring orders first, then inside each shelf, so no task orders all rows of a repository.
    """
    shelved = df.withColumn("shelf", F.floor(F.col("ord") / shelf_rows))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    shelves = shelved.groupBy("repo", "shelf").agg(*[F.sum(c).alias(c) for c in sums.values()])
    shelves = shelves.select("repo", "shelf", *[ahead(c, before(["repo"], "shelf")).alias(f"{name}_lead") for name, c in sums.items()])
    inner = shelved.withColumns({name: ahead(c, before(["repo", "shelf"], "ord")) for name, c in sums.items()})
    joined = inner.join(shelves, ["repo", "shelf"])
    return joined.withColumns({name: F.col(name) + F.col(f"{name}_lead") for name in sums}).drop("shelf", *[f"{name}_lead" for name in sums])


def packed(nodes: DataFrame, edges: DataFrame, bound: int, shelf_rows: int = 1024) -> DataFrame:
    """(repo, kind, id, batch): nodes (repo, node, piece) and edges (repo, edge, src, dst) dealt to batches of at most ``bound`` rows.

    ``piece`` is a whole number by which pieces are ordered: a flow and its steps have one, and are never parted.  An edge goes with
    the later of its ends' pieces, an end that is not written now does not count, and an edge without any is left out; so
    a batch never holds an edge before both its ends.  A piece of more than half of the bound is a batch of its own, the only way in which a
    batch can pass the bound; others fill batches in order, those that begin in one half of the bound together.
    Rows without a repository are left out.
    """
    scratch = Scratch(nodes.sparkSession, "packing")
    at = nodes.select("repo", "node", F.col("piece").cast("bigint").alias("ord"))
    end = lambda column: at.select("repo", F.col("node").alias(column), F.col("ord").alias(f"{column}_ord"))
    placed = edges.join(end("src"), ["repo", "src"], "left").join(end("dst"), ["repo", "dst"], "left").select("repo", F.col("edge").alias("id"), F.greatest("src_ord", "dst_ord").alias("ord")).where("ord is not null")
    rows = scratch.keep(at.select("repo", F.lit("node").alias("kind"), F.col("node").cast("string").alias("id"), "ord").unionByName(placed.select("repo", F.lit("edge").alias("kind"), F.col("id").cast("string").alias("id"), "ord")), "rows")
    pieces = rows.groupBy("repo", "ord").agg(F.count("*").alias("weight"))
    big = F.col("weight") * 2 > bound
    pieces = pieces.select("repo", "ord", "weight", big.cast("int").alias("big"), F.when(big, 0).otherwise(F.col("weight")).alias("small"))
    pieces = scratch.keep(_running(pieces, shelf_rows, segment="big", filled="small"), "pieces")
    # a piece that is a batch of its own parts what stands before it from what stands after it
    begun = pieces.groupBy("repo", "segment").agg(F.min("filled").alias("begun"))
    group = F.when(F.col("big") == 1, F.lit(None)).otherwise(F.floor((F.col("filled") - F.col("begun")) * 2 / bound))
    grouped = pieces.join(begun, ["repo", "segment"]).select("repo", "ord", F.struct("segment", "big", group.alias("part")).alias("key"))
    batches = grouped.select("repo", "key").distinct().select("repo", "key", F.row_number().over(Window.partitionBy("repo").orderBy("key")).alias("batch"))
    return rows.join(grouped.join(batches, ["repo", "key"]).select("repo", "ord", "batch"), ["repo", "ord"]).select("repo", "kind", "id", "batch")
