"""Natural keys of nodes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.lit(":"), F.coalesce(p.cast("string"), F.lit("")))])


def organization(n: Column) -> Column:
    return _key("org", n)


def space(n: Column) -> Column:
    return _key("space", n)


def application(name: Column) -> Column:
    return _key("app", name)


def repository(name: Column) -> Column:
    return _key("repo", name)


def flow(app: Column, trigger: Column) -> Column:
    return _key("flow", app, trigger)


def endpoint(app: Column, method: Column, path: Column) -> Column:
    return _key("endpoint", app, F.upper(method), path)


def channel(label: Column, name: Column) -> Column:
    return F.concat(F.lower(label), F.lit(":"), name)


def table(store: Column, schema: Column, name: Column) -> Column:
    return _key("table", store, schema, name)


def module(repo: Column, path: Column) -> Column:
    return _key("module", repo, path)


def datastore(vendor: Column, host: Column, database: Column) -> Column:
    return _key("datastore", vendor, host, database)


def step(flow_id: Column, symbol: Column, bound_to: Column, occurrence: Column) -> Column:
    """The function a step runs, the subclass it is bound to, and the number of a second or later visit."""
    return F.concat(_key("step", flow_id, symbol), F.coalesce(F.concat(F.lit("@"), bound_to), F.lit("")), F.when(occurrence > 1, F.concat(F.lit("#"), occurrence.cast("string"))).otherwise(F.lit("")))
