"""Two states of a graph: what was added, modified and removed; merges of facts into nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties that change without meaning a change of the fact; fixed values.
VOLATILE = ("ingestion_job", "commit", "first_seen", "last_seen", "extracted_at")


def comparable(props: Column, ignore: tuple[str, ...] = VOLATILE) -> Column:
    """A property map as sorted entries (maps have no equality), without volatile, null and summary properties."""
    kept = F.map_filter(props, lambda k, v: v.isNotNull() & ~k.isin(*ignore) & ~k.startswith("card") & ~k.startswith("summary"))
    return F.array_sort(F.map_entries(kept))


def nulls_for(before: Column, after: Column) -> Column:
    """Properties to clear when ``after`` replaces ``before``."""
    return F.array_sort(F.array_except(F.map_keys(before), F.map_keys(after)))


def diff(before: DataFrame, after: DataFrame, key: str, compare: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """(key, change, before struct, after struct) of rows that differ: one full outer join on the key.

    Both sides have the same columns; ``columns`` are compared (all but the key by
    default).  Keys are unique on each side; a null key never matches.
    """
    columns = columns or [c for c in before.columns if c != key]
    x = before.select(F.col(key).alias("_x"), F.struct(*columns).alias("before"))
    y = after.select(F.col(key).alias("_y"), F.struct(*columns).alias("after"))
    both = x.join(y, F.col("_x") == F.col("_y"), "full_outer")
    change = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "remove").when(~F.col("before").eqNullSafe(F.col("after")), "modify")
    return both.select(F.coalesce("_x", "_y").alias(key), change.alias("change"), "before", "after").where("change is not null")


def owner_kept(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Plan nodes (id, shared, repo) with the owner who wrote a shared node first."""
    old = stored.select("id", F.col("repo").alias("first_repo"))
    return plan.join(old, "id", "left").withColumn("repo", F.when(F.col("shared") & F.col("first_repo").isNotNull(), F.col("first_repo")).otherwise(F.col("repo"))).drop("first_repo")


def stale_labels(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(before, after))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (type, src, dst) of (…, ord, operation, site, async): any async, operations joined, sites as a sorted set, first line."""
    return edges.groupBy("type", "src", "dst").agg(
        F.bool_or("async").alias("async"),
        F.array_join(F.array_sort(F.collect_set("operation")), ", ").alias("operation"),
        F.array_sort(F.collect_set("site")).alias("call_sites"),
        F.min("ord").alias("first"),
    )


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id of (id, label, name, ord): the labels, and of the names the last that is not null."""
    return nodes.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"))


def orphans(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """Shared nodes (id) that no edge (src, dst) touches any more."""
    return shared.join(edges.select(F.col("src").alias("id")), "id", "left_anti").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def trace_changes(before: DataFrame, after: DataFrame, flow: str = "flow", item: str = "item", body: str = "body") -> DataFrame:
    """Per flow: items added, removed and modified (another body), as sorted arrays; flows without a change are left out."""
    x = before.groupBy(flow, item).agg(F.max(body).alias("x"))
    y = after.groupBy(flow, item).agg(F.max(body).alias("y"))
    both = x.join(y, [flow, item], "full_outer")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(item))))
    out = both.groupBy(flow).agg(pick(F.col("x").isNull()).alias("added"), pick(F.col("y").isNull()).alias("removed"), pick(F.col("x") != F.col("y")).alias("modified"))
    return out.where("size(added) + size(removed) + size(modified) > 0")
