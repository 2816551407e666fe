"""Joins with a rule: agreement, uniqueness, templates, prefixes, ranges, subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def agreement(code: DataFrame, claimed: DataFrame, checked: DataFrame) -> DataFrame:
    """(channel, app, role, agreement) of uses by code and by claims, for channels that another witness mentions at all."""
    keys = ["channel", "app", "role"]
    x = code.select(*keys).distinct().withColumn("c", F.lit(True))
    y = claimed.select(*keys).distinct().withColumn("d", F.lit(True))
    state = F.when(F.col("c") & F.col("d"), "confirmed").when(F.col("c"), "code_only").otherwise("declared_only")
    return x.join(y, keys, "full_outer").select(*keys, state.alias("agreement")).join(checked.select("channel").distinct(), "channel", "left_semi")


def one_sided(uses: DataFrame) -> DataFrame:
    """(channel, produced, consumed) where exactly one of the two happens; ``uses`` is (channel, role)."""
    counted = uses.groupBy("channel").agg(F.count_if(F.col("role") == "produces").alias("produced"), F.count_if(F.col("role") == "consumes").alias("consumed"))
    return counted.where((F.col("produced") > 0) != (F.col("consumed") > 0))


def template_join(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls (call, method, path) with each endpoint (endpoint, method, template) that serves them.

    Both sides are dealt by method and number of segments; the segments are compared
    in those buckets alone, so there is no product of all calls and endpoints.
    """
    x = calls.withColumn("_n", F.size(urls.segments(F.col("path"))))
    y = endpoints.withColumn("_n", F.size(urls.segments(F.col("template"))))
    return x.join(y, ["method", "_n"]).where(urls.template_fits(F.col("template"), F.col("path"))).drop("_n")


def unique_best(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call, endpoint): the endpoint of the same shape if there is one, else the only template that fits; else none."""
    fits = template_join(calls, endpoints)
    same = F.regexp_replace(urls.path_shape(F.col("path")), "x", "x") == urls.path_shape(F.col("template"))
    per = fits.groupBy("call").agg(
        F.count_if(same).alias("exact"), F.min(F.when(same, F.col("endpoint"))).alias("e"), F.count("*").alias("n"), F.min("endpoint").alias("any")
    )
    return per.select("call", F.when(F.col("exact") == 1, F.col("e")).when((F.col("exact") == 0) & (F.col("n") == 1), F.col("any")).alias("endpoint")).where("endpoint is not null")


def resolve_name(names: DataFrame, canonical: DataFrame, alias: DataFrame) -> DataFrame:
    """(name, id): the one thing of that canonical name, else the one of that alias, else null; never a guess."""
    only = lambda df, out: df.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias(out)).where("n = 1").drop("n")
    taken = canonical.select("name").distinct().withColumn("taken", F.lit(True))
    out = names.select("name").distinct().join(only(canonical, "x"), "name", "left").join(only(alias, "y"), "name", "left").join(taken, "name", "left")
    return out.select("name", F.when(F.col("taken").isNull(), F.coalesce("x", "y")).otherwise(F.col("x")).alias("id"))


def longest_prefix(items: DataFrame, prefixes: DataFrame, separator: str = "/") -> DataFrame:
    """(item, prefix): for each item path the longest prefix path that holds it.

    An item is exploded into its own prefixes and joined by equality, so the cost
    is the items' depth and not the number of prefixes.
    """
    parts = F.split("item", separator)
    own = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))).alias("prefix"))
    return own.join(prefixes.select("prefix").distinct(), "prefix").groupBy("item").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def innermost_range(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """(file, line, scope): the shortest range (file, scope, first, last) around each point (file, line).

    Ranges are put into buckets of ``width`` lines, so points meet only ranges of their bucket.  Of ranges with the same
    lines only the smallest scope can be the answer, so the others meet no point, however many there are.
    """
    each = ranges.groupBy("file", "first", "last").agg(F.min("scope").alias("scope"))
    r = each.select("file", "scope", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("_b"))
    p = points.select("file", "line", F.floor(F.col("line") / width).alias("_b"))
    inside = p.join(r, ["file", "_b"]).where("line between first and last")
    return inside.groupBy("file", "line").agg(F.min_by("scope", F.struct(F.col("last") - F.col("first"), F.col("scope"))).alias("scope"))


def subset_unique(wanted: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(ref, id, state): nodes that match all given columns of a partial reference (nulls match anything), on the label."""
    w = wanted.select("ref", "label", *[F.col(c).alias(f"_{c}") for c in columns])
    match = F.lit(True)
    for c in columns:
        match = match & (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
    found = w.join(nodes, "label").where(match).groupBy("ref").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    state = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return wanted.select("ref").distinct().join(found, "ref", "left").select("ref", F.when(F.col("n") == 1, F.col("one")).alias("id"), state.alias("state"))


def overlapping(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """Claims (claim, subjects) that name any of the keys (key)."""
    hit = claims.select("claim", F.explode("subjects").alias("key")).join(keys.select("key").distinct(), "key", "left_semi").select("claim").distinct()
    return claims.join(hit, "claim", "left_semi")


def latest(runs: DataFrame, group: str, order: str) -> DataFrame:
    """The row of largest ``order`` of each group."""
    rest = [c for c in runs.columns if c != group]
    return runs.groupBy(group).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(group, *[F.col(f"_r.{c}").alias(c) for c in rest])


def colocated(steps: DataFrame) -> DataFrame:
    """(src, dst, n): pairs of different files whose functions call each other in a flow; ``steps`` is (flow, ord, parent, file)."""
    child = steps.select("flow", F.col("parent").alias("ord"), F.col("file").alias("dst"))
    return steps.select("flow", "ord", F.col("file").alias("src")).join(child, ["flow", "ord"]).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
