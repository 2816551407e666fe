"""Orders: interleaving, shares, close calls, sibling chains, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleave(hits: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first of each group in turn, then the second, …; groups in the order of their first hit."""
    first = F.min(order).over(Window.partitionBy(group))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return hits.withColumn("turn", nth).withColumn("_first", first).where(F.col("turn") <= limit).orderBy("turn", "_first", order).limit(limit).drop("_first")


def share(hits: DataFrame, group: str) -> DataFrame:
    """(group, n, share of all, share of the largest): two aggregations and a join with one row."""
    counted = hits.groupBy(group).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return counted.join(F.broadcast(total)).select(group, "n", F.round(F.col("n") / F.col("total"), 6).alias("of_all"), F.round(F.col("n") / F.col("top"), 6).alias("of_top"))


def keep_close(scored: DataFrame, confidence: str, threshold: float = 0.5, close: float = 0.15) -> DataFrame:
    """Choices at the threshold or close behind the best; the best alone if none is; none if the best is nothing."""
    top = scored.agg(F.max(confidence).alias("_top"))
    c, t = F.col(confidence), F.col("_top")
    return scored.join(F.broadcast(top)).where((c > 0) & (t > 0) & ((c >= threshold) | (t - c <= close))).drop("_top")


def sibling_chain(steps: DataFrame) -> DataFrame:
    """(flow, type, src, dst): FIRST_STEP from a parent, SUBSTEP from a step to its first child, NEXT between siblings.

    ``steps`` is (flow, ord, parent, step); a parent of null is the flow itself.
    """
    before = F.lag("step").over(Window.partitionBy("flow", "parent").orderBy("ord"))
    chained = steps.withColumn("before", before)
    kind = F.when(F.col("before").isNotNull(), "NEXT").when(F.col("parent").isNull(), "FIRST_STEP").otherwise("SUBSTEP")
    return chained.select("flow", kind.alias("type"), F.coalesce("before", "parent", "flow").alias("src"), F.col("step").alias("dst"))


def occurrence(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """Rows with the number of the visit of their key."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def within_budget(rows: DataFrame, group: str, order: str, cost: Column, budget: int, least: int = 1) -> DataFrame:
    """Rows of each group in order while their running cost is within the budget; the first ``least`` stay in any case."""
    w = Window.partitionBy(group).orderBy(order)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_spent", running).withColumn("_nth", F.row_number().over(w)).where((F.col("_spent") <= budget) | (F.col("_nth") <= least)).drop("_spent", "_nth")


def cut_to_budget(items: DataFrame, inner: DataFrame, fixed: int, budget: int, first: str = "citations", least: int = 3) -> DataFrame:
    """(answer, what, cut): how many items each list of an answer loses so that the answer takes ``budget`` bytes.

    ``items`` is (answer, list, place, item, bytes): lists of an answer in order of ``place``, items in order of ``item``;
    ``inner`` (item, inner, order, bytes) are lists inside items.  ``fixed`` bytes are in every answer.

    Items go from the ends of lists: first of the list ``first``, down to ``least``; then always of the list
    that takes most, down to one; then of lists inside the items that are left, down to one.
    An answer may stay over its budget.  No loop is needed: a list's size before it loses an item is
    the sum up to that item, so the items of all lists go in falling order of that sum,
    and as many go as must to free what is over.
    """
    own = Window.partitionBy("answer", "list").orderBy("item")
    parts = inner.withColumn("iat", F.row_number().over(Window.partitionBy("item", "inner").orderBy("order")))
    inside = inner.groupBy("item").agg(F.sum("bytes").alias("inside"))
    sized = items.join(inside, "item", "left").withColumn("bytes", F.col("bytes") + F.coalesce("inside", F.lit(0))).drop("inside")
    sized = sized.withColumns({"at": F.row_number().over(own), "upto": F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    over = sized.groupBy("answer").agg((F.sum("bytes") + fixed - budget).alias("over"))
    early = (F.col("list") == first) & (F.col("at") > least)
    rank = lambda stage, *by: F.struct(F.lit(stage).alias("stage"), *[c.cast("bigint").alias(f"r{i}") for i, c in enumerate(by)])
    zero = F.lit(0)
    events = sized.where("at > 1").select("answer", F.col("list").alias("what"), F.when(early, rank(1, -F.col("at"), zero, zero, zero)).otherwise(rank(2, -F.col("upto"), F.col("place"), zero, zero)).alias("rank"), "bytes")
    deep = sized.where("at = 1").select("answer", "list", "place", "item").join(parts, "item").where("iat > 1")
    names = Window.partitionBy("answer", "item").orderBy("inner")
    deep = deep.withColumn("which", F.dense_rank().over(names))
    events = events.unionByName(deep.select("answer", F.concat_ws(".", "list", "inner").alias("what"), rank(3, F.col("place"), F.col("which"), -F.col("iat"), zero).alias("rank"), "bytes"))
    freed = F.coalesce(F.sum("bytes").over(Window.partitionBy("answer").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), zero)
    return events.withColumn("freed", freed).join(over, "answer").where("freed < over").groupBy("answer", "what").agg(F.count("*").alias("cut"))
