"""Gateways and the links between applications that calls make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..scratch import Scratch
from . import assembly


def through_gateway(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, route, inside): the path that the target of a gateway's route sees.

    ``requests`` is (request, gateway, method, path), ``routes`` (route, gateway,
    pattern, methods, strip, rewrite, prefix): methods are comma-separated, none means
    all; strip cuts leading segments; rewrite is ``regex, replacement`` with ``${name}``
    for named groups; prefix is put on last.  Joined by gateway; the pattern is tested before anything is cut.
    """
    methods = F.filter(F.transform(F.split(F.coalesce("methods", F.lit("")), ","), lambda m: F.upper(F.trim(m))), lambda m: m != "")
    known = routes.select("route", "gateway", "pattern", urls.pattern_regex(F.col("pattern")).alias("_regex"), methods.alias("_methods"), "strip", "rewrite", "prefix")
    both = requests.join(known, "gateway").where(F.rlike("path", F.col("_regex")))
    both = both.where((F.size("_methods") == 0) | F.col("method").isNull() | F.array_contains("_methods", F.upper("method")))
    return both.select("request", "route", urls.inside_path(F.col("path"), F.coalesce("strip", F.lit(0)), F.col("prefix"), F.col("rewrite")).alias("inside"))


def outside_paths(endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """(endpoint, route, outside): the path of each endpoint (endpoint, application, path) through each route to its application.

    Routes have an ``application`` besides the columns of ``through_gateway``.  A rewrite can't be
    reversed, nor a cut of segments that are no literals, and a path that the route would not take is none.
    """
    known = routes.where("rewrite is null or rewrite = ''").select("route", "application", "pattern", urls.pattern_regex(F.col("pattern")).alias("_regex"), F.coalesce("strip", F.lit(0)).alias("_strip"), "prefix")
    segments = F.filter(F.split("pattern", "/"), lambda s: s != "")
    lead = F.when(F.size(segments) >= F.col("_strip"), F.array_join(F.filter(segments, lambda _, i: i < F.col("_strip")), "/")).otherwise("*")
    both = endpoints.join(known.withColumn("_lead", lead), "application")
    return both.select("endpoint", "route", "_regex", urls.outside_path(F.col("path"), F.col("_lead"), F.col("prefix")).alias("outside")).where(F.col("outside").isNotNull() & F.rlike("outside", F.col("_regex"))).drop("_regex")


def endpoint_of(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call, endpoint): of the called application's endpoints of that method the one of exactly that shape, else the only one whose template serves it.

    ``calls`` is (call, application, method, path), ``endpoints`` (endpoint, application, method, path).
    Pairs are keyed by application, method and number of segments.
    """
    a = calls.select("call", "application", F.upper("method").alias("method"), urls.path_shape(F.col("path")).alias("shape")).withColumn("size", F.size(urls.segments(F.col("shape"))))
    b = endpoints.select("endpoint", "application", "method", urls.path_shape(F.col("path")).alias("template")).withColumn("size", F.size(urls.segments(F.col("template"))))
    both = a.join(b, ["application", "method", "size"])
    same = F.col("shape") == F.col("template")
    fits = both.where(same | urls.template_fits(F.col("template"), F.col("shape")))
    one = fits.groupBy("call").agg(F.count_if(same).alias("exact"), F.min(F.when(same, F.col("endpoint"))).alias("of_exact"), F.count("*").alias("n"), F.min("endpoint").alias("of_all"))
    return one.select("call", F.when(F.col("exact") == 1, F.col("of_exact")).when(F.col("n") == 1, F.col("of_all")).alias("endpoint")).where("endpoint is not null")


def link_plan(calls: DataFrame, names: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call, system, application, certainty, endpoint): calls (call, system, method, url) whose host names an application.

    ``endpoint`` is null where that application serves no such path, so that the system can
    say which service it was for.
    """
    # written, since hosts and paths are read by both joins
    split = Scratch(calls.sparkSession, "links").keep(calls.select("call", "system", "method", F.inline(F.array(urls.host_and_path(F.col("url"))))), "calls")
    named = assembly.service_links(split.where("host is not null").select("call", "host"), names)
    target = split.join(named, "call").select("call", "system", "method", "path", F.col("id").alias("application"), "certainty")
    return target.select("call", "system", "application", "certainty").join(endpoint_of(target, endpoints), "call", "left")


def replaced(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``stored`` whose key ``fresh`` does not have, and all rows of ``fresh``: a key's rows are replaced whole."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def stubs(declared: DataFrame, applications: DataFrame) -> DataFrame:
    """(name, id, stub): a declared name's application, or a stub of its own where no application has the name."""
    found = declared.select("name").distinct().join(applications.groupBy("name").agg(F.min("id").alias("id")), "name", "left")
    return found.select("name", F.coalesce("id", F.concat(F.lit("stub:"), F.lower("name"))).alias("id"), F.col("id").isNull().alias("stub"))


def dead_stubs(stub_nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Stubs (id, name) to remove: no edge (src, dst) touches them, or an application has their name by now."""
    touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    idle = stub_nodes.join(touched, "id", "left_anti").select("id", F.lit("no edges").alias("reason"))
    resolved = stub_nodes.join(names.select("name").distinct(), "name", "left_semi").select("id", F.lit("resolved").alias("reason"))
    return resolved.unionByName(idle).groupBy("id").agg(F.max("reason").alias("reason"))


def literal(text: Column) -> Column:
    """The text as a regular expression that matches it alone."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_/])", r"\\$1")
