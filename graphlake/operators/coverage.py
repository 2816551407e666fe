"""Gaps: items, patterns, their state and rank, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import versions


def items(occurrences: DataFrame) -> DataFrame:
    """One row per (kind, target) of (kind, target, app, repo, sample, open): counts, applications, samples, status."""
    return occurrences.groupBy("kind", "target").agg(
        F.count("*").alias("occurrences"),
        F.count_distinct("repo").alias("repositories"),
        F.count_distinct("app").alias("applications"),
        F.slice(F.array_sort(F.collect_set("sample")), 1, 8).alias("samples"),
        F.when(F.bool_or("open"), "unexplained").otherwise("explained").alias("status"),
    )


def next_state(occurrences, state):
    """open is covered once it no longer occurs; covered is open again once it does; what was decided on purpose stays."""
    settled = state.isin("covered", "ignored", "expected")
    return F.when((occurrences == 0) & ~settled, "covered").when((occurrences > 0) & (state == "covered"), "open").otherwise(state)


def record(patterns: DataFrame, seen: DataFrame) -> DataFrame:
    """Patterns (signal, target, state) after a run that saw (signal, target, repositories, applications, occurrences, evidence)."""
    keys = ["signal", "target"]
    both = patterns.join(seen, keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = [zero(c).cast("bigint").alias(c) for c in ("repositories", "applications", "occurrences", "evidence")]
    out = both.select(*keys, F.coalesce("state", F.lit("open")).alias("state"), *counts)
    rank = versions.score(F.col("signal"), F.col("repositories"), F.col("applications"), F.col("occurrences"), F.col("evidence"))
    return out.select(*keys, next_state(F.col("occurrences"), F.col("state")).alias("state"), "repositories", "applications", "occurrences", rank.alias("score"))


def frameworks(patterns: DataFrame) -> DataFrame:
    """Patterns (fingerprint, owner, score) by owner; those without one stand alone."""
    grouped = patterns.groupBy(F.coalesce("owner", "fingerprint").alias("unit")).agg(F.max("owner").alias("owner"), F.round(F.sum("score"), 2).alias("score"), F.count("*").alias("patterns"))
    return grouped.select("unit", "owner", "score", "patterns")


def completeness(rows: DataFrame, group: str) -> DataFrame:
    """Per group of (group, reachable, explained): counts and shares; null where there is nothing."""
    out = rows.groupBy(group).agg(F.count("*").alias("whole"), F.count_if("reachable").alias("reachable"), F.count_if("explained").alias("explained"))
    return out.select(group, "whole", "reachable", "explained", versions.percent(F.col("reachable"), F.col("whole")).alias("reachable_pct"), versions.percent(F.col("explained"), F.col("reachable")).alias("explained_pct"))


def triage(patterns: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patterns with the state that a later decision (fingerprint, state) gave."""
    d = decisions.select("fingerprint", F.col("state").alias("_decided"))
    return patterns.join(d, "fingerprint", "left").withColumn("state", F.coalesce("_decided", "state")).drop("_decided")
