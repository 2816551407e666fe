"""Which application is which: name closure, the ladder of names, matching of deployables to known identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Ranks of the slots that a name can come from, and of its witnesses; fixed values.
SLOTS = ("manifest", "build_artifact", "config", "deploy", "directory")
WITNESSES = ("declared", "platform", "code", "inferred")


def closure(names: DataFrame, links: DataFrame, rounds: int = 4) -> DataFrame:
    """(deployable, name): names (deployable, name) and all that links (a, b) tie to them, within some rounds."""
    scratch = Scratch(names.sparkSession, "names")
    both = links.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("name"), F.col("a").alias("other"))).distinct()
    found = scratch.keep(names.select("deployable", "name").distinct(), "names")
    frontier = found
    for _ in range(rounds):
        new = frontier.join(both, "name").select("deployable", F.col("other").alias("name")).distinct().join(found, ["deployable", "name"], "left_anti")
        frontier = scratch.keep(new, "names")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _place(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))]), value), F.lit(9))


def canonical(names: DataFrame) -> DataFrame:
    """(deployable, name): the name of the best slot, then the best witness, then the first in order."""
    rank = F.struct(_place(F.col("slot"), SLOTS).alias("slot"), _place(F.col("witness"), WITNESSES).alias("witness"), "name")
    return names.groupBy("deployable").agg(F.min_by("name", rank).alias("name"))


def match(deployables: DataFrame, known: DataFrame) -> DataFrame:
    """(deployable, id, how): deployables (deployable, location, name) matched to identities (id, location, name, gone).

    By location first; else by a name that is here, else by one that is gone; each
    identity is taken once, and a name that fits several is a conflict.  What
    matches nothing is new.
    """
    by_place = deployables.join(known.where("not gone").select("id", "location"), "location").groupBy("deployable").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    placed = by_place.select("deployable", "id", F.lit("location").alias("how"))
    left = deployables.join(placed, "deployable", "left_anti")
    free = known.join(placed.select("id"), "id", "left_anti")
    named = left.join(free.select("id", "name", "gone"), "name").groupBy("deployable").agg(
        F.count_distinct(F.when(~F.col("gone"), F.col("id"))).alias("here"), F.min(F.when(~F.col("gone"), F.col("id"))).alias("x"),
        F.count_distinct(F.when(F.col("gone"), F.col("id"))).alias("away"), F.min(F.when(F.col("gone"), F.col("id"))).alias("y"),
    )
    how = F.when(F.col("here") == 1, "name").when(F.col("here") > 1, "conflict").when(F.col("away") == 1, "returned").otherwise("conflict")
    matched = named.select("deployable", F.when(how == "name", F.col("x")).when(how == "returned", F.col("y")).alias("id"), how.alias("how"))
    fresh = left.join(matched, "deployable", "left_anti").select("deployable", F.lit(None).cast(known.schema["id"].dataType).alias("id"), F.lit("new").alias("how"))
    return placed.unionByName(matched).unionByName(fresh)


def removed(known: DataFrame, matched: DataFrame) -> DataFrame:
    """Identities that no deployable matched in this run."""
    return known.where("not gone").join(matched.where("id is not null").select("id"), "id", "left_anti")
