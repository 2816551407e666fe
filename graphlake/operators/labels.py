"""Names that facts are told by: pages of source lines, containers and libraries of symbols, owners of patterns, who may call."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: What stands between a repository and a commit in the address of a file, by a word in the host. Fixed values.
PAGES = {"gitlab": "/-/blob/", "": "/blob/"}
#: First segments of packages that are named after a domain. Fixed values.
DOMAINS = ("com", "org", "io", "net", "dev", "de", "uk", "co", "me", "ch", "fr", "nl", "app")
#: Signals about an application's own code, which belong to nobody else. Fixed values.
OWN_CODE = ("inferred_entry", "no_trigger_application", "unreachable_effect", "unknown_host", "dropped_match", "unparsed", "unread_file", "silent_repository", "one_sided")
#: How the owner of a pattern is read from its target: what is put before it, what it is cut at, and how many pieces stay. Fixed values.
OWNERS = [
    *[{"signal": s, "lead": "", "cut": " ", "pieces": 1} for s in ("library", "version_untested", "version_unknown")],
    *[{"signal": s, "lead": "config:", "cut": ".", "pieces": 2} for s in ("config_unset", "unread_config")],
    *[{"signal": s, "lead": "", "cut": " ", "pieces": 0} for s in OWN_CODE],
    {"signal": "external_call", "library": True},
]
#: Whom a call in an access rule lets in, and whether it is read inside an expression too. Fixed values.
GRANTS = {
    "permitAll": ("public", True),
    "denyAll": ("denied", False),
    "anonymous": ("anonymous", False),
    "authenticated": ("authenticated", False),
    "fullyAuthenticated": ("authenticated", False),
    "isAuthenticated": ("authenticated", True),
}
#: Calls that name roles. Fixed values.
ROLES = ("hasRole", "hasAnyRole", "hasAuthority", "hasAnyAuthority")


def source_url(clone: Column, commit: Column, path: Column, line: Column) -> Column:
    """The page of a file's line at a commit; null where one of them is missing or the host is not reached by https."""
    given = lambda c: F.nullif(c, F.lit(""))
    repository = given(F.regexp_extract(clone, r"^(https://.*?)(?:\.git)?$", 1))
    between = F.coalesce(*[F.when(repository.contains(word), mark) for word, mark in PAGES.items()])
    return F.concat(repository, between, given(commit), F.lit("/"), given(path), F.coalesce(F.concat(F.lit("#L"), F.when(line > 0, line).cast("string")), F.lit("")))


def container(symbol: Column) -> Column:
    """What holds a symbol: what stands before its mark or its last dot, or itself."""
    return F.regexp_extract(symbol, r"^([^#]*(?=#)|.+(?=\.[^.]*$)|.*)", 1)


def library_of(symbol: Column, domains: Iterable[str] = DOMAINS) -> Column:
    """The library of a class: three segments of a package that begins with a domain, else two; a bare class is its own; null for no name."""
    segment = r"(?:[^.#\p{Lu}][^.#]*)"
    package = F.regexp_extract(symbol, rf"^((?:(?:{'|'.join(domains)})(?:\.{segment}){{0,2}}|{segment}(?:\.{segment})?)(?=[.#]|$))", 1)
    return F.coalesce(F.nullif(package, F.lit("")), F.nullif(F.substring_index(symbol, "#", 1), F.lit("")))


def owners(patterns: DataFrame) -> DataFrame:
    """``patterns`` (signal, target, library) with ``owner``: whom they belong to, as the table OWNERS says for their signal.

    A signal that is not in the table belongs to the package of its target; own code to nobody.
    """
    rules = patterns.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(OWNERS)), "array<struct<signal string, lead string, cut string, pieces int, library boolean>>")))
    ruled = patterns.join(F.broadcast(rules.withColumnRenamed("library", "by_library")), "signal", "left")
    head = F.expr("array_join(slice(split(target, concat('[', cut, ']')), 1, pieces), cut)")
    owner = F.when(F.col("pieces") > 0, F.concat("lead", head)).when(F.col("pieces").isNull(), F.coalesce(F.when(F.col("by_library"), F.col("library")), text.package_root(F.col("target"))))
    return ruled.select(*patterns.columns, owner.alias("owner"))


def access_text(rule: Column, value: Column) -> Column:
    """Who a rule lets in: ``role:`` and names, ``public``, ``authenticated``, ``denied``, ``anonymous``, or the expression itself; null for other rules.

    A rule and its value are read as the call that they stand for, an expression as the calls
    in it.  Each call is looked up; roles come before all else, then the order in GRANTS.
    """
    free = rule == "expression"
    code = F.when(free, value).otherwise(F.concat(rule, F.lit("("), F.coalesce(value, F.lit("")), F.lit(")")))
    pattern = F.lit(r"([A-Za-z]+)(?:\(([^)]*)\))?")
    calls = F.arrays_zip(F.regexp_extract_all(code, pattern, 1).alias("name"), F.regexp_extract_all(code, pattern, 2).alias("given"))
    calls = F.when(free, calls).otherwise(F.slice(calls, 1, 1))
    names = lambda given: F.array_join(F.filter(F.transform(F.split(given, ","), lambda n: F.regexp_replace(n, r"^[\s'\"]+|[\s'\"]+$", "")), lambda n: n != ""), ",")

    def read(call: Column) -> Column:
        said = names(call["given"])
        role = F.when(said != "", F.concat(F.lit("role:"), said)).when(~free, F.lit("role"))
        out = F.when(call["name"].isin(*ROLES) & role.isNotNull(), F.struct(F.lit(0).alias("rank"), role.alias("who")))
        for rank, (name, (who, inside)) in enumerate(GRANTS.items(), 1):
            out = out.when((call["name"] == name) & (F.lit(inside) | ~free), F.struct(F.lit(rank).alias("rank"), F.lit(who).alias("who")))
        return out

    found = F.filter(F.transform(calls, read), lambda c: c.isNotNull())
    # the first call of the best rank; ranks of later calls do not decide between roles
    best = F.array_min(F.transform(found, lambda c, i: F.struct(c["rank"].alias("rank"), i.alias("place"), c["who"].alias("who"))))["who"]
    return F.coalesce(best, F.when(free, F.concat(F.lit("expression:"), F.regexp_replace(value, '^"+|"+$', ""))))
