"""The reconcile run: what code and claims say of channels, which hosts name which applications, stubs; from nothing, or only where a batch touched it.

``Facts`` are the tables that all repositories gave so far.  A run derives from them, per
channel, the agreement of witnesses and one-sided use, per declared name a stub or its application, and per
call the application that its host names.  A batch replaces the facts of some repositories.  What can
change follows from their old and new rows: the channels, names and calls in them, the stubs of
those names, and the calls of other repositories whose host is one of those names or may fit one.
Only those are derived again.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import assembly, joins, routes


@dataclass
class Facts:
    """``uses`` (repo, channel, app, role) by code, ``claims`` (repo, channel, app, role), ``names`` (repo, name, id) of applications, ``declared`` (repo, name), ``calls`` (repo, call, host)."""

    uses: DataFrame
    claims: DataFrame
    names: DataFrame
    declared: DataFrame
    calls: DataFrame

    def replaced(self, batch: "Facts", repos: DataFrame) -> "Facts":
        """These facts with those of ``repos`` (repo) as in ``batch``."""
        new = lambda name: getattr(self, name).join(repos, "repo", "left_anti").unionByName(getattr(batch, name))
        return Facts(*[new(f.name) for f in fields(self)])

    def of(self, repos: DataFrame) -> "Facts":
        return Facts(*[getattr(self, f.name).join(repos, "repo", "left_semi") for f in fields(self)])


@dataclass
class Results:
    """``agreement`` (channel, app, role, agreement), ``one_sided`` (channel, produced, consumed), ``stubs`` (name, id, stub), ``links`` (call, id, certainty)."""

    agreement: DataFrame
    one_sided: DataFrame
    stubs: DataFrame
    links: DataFrame


#: What a row of each result is derived for.
KEYS = {"agreement": "channel", "one_sided": "channel", "stubs": "name", "links": "call"}


def derive(facts: Facts) -> Results:
    """A run from nothing."""
    both = facts.uses.unionByName(facts.claims)
    return Results(
        joins.agreement(facts.uses, facts.claims, facts.claims),
        joins.one_sided(both.select("channel", "role")),
        routes.stubs(facts.declared.where("name is not null"), facts.names.withColumn("id", F.col("id").cast("string"))),
        assembly.service_links(facts.calls.select("call", "host"), facts.names),
    )


@dataclass
class Touched:
    """What a batch can change: ``channels`` (channel), ``names`` (name), ``calls`` (call)."""

    channels: DataFrame
    names: DataFrame
    calls: DataFrame


def touched(before: Facts, after: Facts, repos: DataFrame) -> Touched:
    """From the old and new rows of ``repos`` to all that can change, in every repository."""
    scratch = Scratch(repos.sparkSession, "touched")
    repos = repos.select("repo").distinct()
    old, new = before.of(repos), after.of(repos)
    every = lambda name, *columns: getattr(old, name).select(*columns).unionByName(getattr(new, name).select(*columns)).distinct()
    channels = every("uses", "channel").unionByName(every("claims", "channel")).where("channel is not null").distinct()
    # names that a batch leaves as they were change nothing for others
    changed = every("names", "name", "id").join(_same(old.names, new.names), ["name", "id"], "left_anti").select("name").distinct()
    changed = scratch.keep(changed.where("name is not null"), "names")
    names = changed.unionByName(every("declared", "name").where("name is not null")).distinct()

    hosts = after.calls.select("call", assembly.service_name(F.col("host")).alias("host")).where("host is not null")
    named = hosts.join(changed.withColumnRenamed("name", "host"), "host", "left_semi").select("call")
    fits = assembly.template_fits(hosts.where(F.col("host").contains("{")).select(F.col("host").alias("template")).distinct(), changed.withColumn("id", F.lit(0)))
    may_fit = hosts.join(fits.select(F.col("template").alias("host")).distinct(), "host", "left_semi").select("call")
    calls = every("calls", "call").unionByName(named).unionByName(may_fit).distinct()
    return Touched(scratch.keep(channels, "channels"), scratch.keep(names, "names"), scratch.keep(calls, "calls"))


def _same(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("name", "id").distinct().join(new.select("name", "id").distinct(), ["name", "id"], "left_semi")


def restricted(facts: Facts, what: Touched) -> Facts:
    """The facts that touched results are derived from: of other repositories only rows of touched channels, names and calls, and the names that touched calls may have."""
    semi = lambda df, keys, key: df.join(keys, key, "left_semi")
    calls = semi(facts.calls, what.calls, "call")
    hosts = calls.select(assembly.service_name(F.col("host")).alias("name")).where("name is not null").distinct()
    templates = hosts.where(F.col("name").contains("{")).select(F.col("name").alias("template"))
    fitting = assembly.template_fits(templates, facts.names.select("name", F.lit(0).alias("id"))).select("name").distinct()
    names = semi(facts.names, hosts.unionByName(fitting).unionByName(what.names).distinct(), "name")
    return replace(facts, uses=semi(facts.uses, what.channels, "channel"), claims=semi(facts.claims, what.channels, "channel"), names=names, declared=semi(facts.declared, what.names, "name"), calls=calls)


def update(before: Facts, after: Facts, results: Results, repos: DataFrame) -> Results:
    """The results after a batch that replaced the facts of ``repos`` (repo): those not touched stay, the others are derived again.

    Equal to ``derive(after)``.  Replacing them costs what they are: a caller that keeps results by buckets of
    their key rewrites the buckets of ``touched`` alone.
    """
    what = touched(before, after, repos)
    fresh = derive(restricted(after, what))
    keys = {"channel": what.channels, "name": what.names, "call": what.calls}
    return Results(*[getattr(results, name).join(keys[key], key, "left_anti").unionByName(getattr(fresh, name)) for name, key in KEYS.items()])
