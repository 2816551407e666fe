"""Libraries that build files declare: Gradle scripts, version catalogs and Maven projects, with their versions resolved.

A file becomes rows of what stands in it, (section, entry, field, value): a library
is an entry with fields, a variable an entry with a value.  Versions are found by joins of these rows.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import is_test_file

_NAME = r"[A-Za-z0-9_.\-]+"
#: Notations of a Gradle script; each gives a name and, perhaps, a version. Groups: g and a, or p; v.
_NOTATIONS = [
    re.compile(rf"(?P<q>['\"])(?P<g>{_NAME}):(?P<a>{_NAME})(?::(?P<v>\$\{{[^}}]*\}}|[^'\":@]+))?(?:@\w+)?(?P=q)"),
    re.compile(rf"\bgroup\s*[:=]\s*['\"](?P<g>{_NAME})['\"]\s*,\s*name\s*[:=]\s*['\"](?P<a>{_NAME})['\"](?:\s*,\s*version\s*[:=]\s*['\"](?P<v>[^'\"]+)['\"])?"),
    re.compile(rf"\bid\b\s*\(?\s*['\"](?P<p>{_NAME})['\"]\s*\)?\s*\bversion\b\s*\(?\s*['\"](?P<v>[^'\"]+)['\"]"),
]
#: Where a script gives a variable a literal value.
_ASSIGNED = [
    re.compile(r"(?:^|[\s,(\[{])(?P<k>[A-Za-z_][\w.]*)\s*[=:]\s*['\"](?P<v>[^'\"$]+)['\"]", re.MULTILINE),
    re.compile(r"(?:\bset\s*\(\s*|\bextra\s*\[\s*)['\"](?P<k>[\w.]+)['\"]\s*(?:,|\]\s*=)\s*['\"](?P<v>[^'\"]+)['\"]"),
]
#: A version that is a variable: ``$x``, ``${x}``, ``${project.x}``, ``${property('x')}``.
_REFERENCE = r"^\$\{?(?:project\.)?(?:(?:findProperty|property)\(\s*['\"])?([\w.\-]+)(?:['\"]\s*\))?\}?$"

Leaf = tuple[str, str, str, str]


def _script(text: str) -> Iterator[Leaf]:
    libraries = (m for notation in _NOTATIONS for m in notation.finditer(text))
    for n, m in enumerate(libraries):
        found = m.groupdict()
        yield "libraries", str(n), "module", found["p"] if found.get("p") else f"{found['g']}:{found['a']}"
        if found["v"]:
            yield "libraries", str(n), "version", found["v"]
    for assigned in _ASSIGNED:
        for m in assigned.finditer(text):
            yield "variables", m["k"].removeprefix("project.").removeprefix("ext."), "", m["v"]


def _settings(text: str) -> Iterator[Leaf]:
    for line in text.splitlines():
        key, given, value = line.partition("=")
        if given and not key.lstrip().startswith("#"):
            yield "variables", key.strip(), "", value.strip()


def _nested(value: dict, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    for k, v in value.items():
        if isinstance(v, dict):
            yield from _nested(v, (*at, k))
        elif isinstance(v, str):
            yield (*at, k), v


def _catalog(text: str) -> Iterator[Leaf]:
    for (section, *where), value in _nested(tomllib.loads(text)):
        if where:
            yield section, where[0], ".".join(where[1:]), value


def _project(text: str) -> Iterator[Leaf]:
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    for n, e in enumerate(ElementTree.fromstring(text).iter()):
        for c in e:
            value = (c.text or "").strip()
            if tag(e) == "properties" and value:
                yield "variables", tag(c), "", value
            elif tag(e) in ("dependency", "plugin", "parent") and value:
                yield tag(e), str(n), tag(c), value


#: How the files of a name are read.
_READERS = [(".gradle", _script), (".gradle.kts", _script), ("gradle.properties", _settings), (".versions.toml", _catalog), ("pom.xml", _project)]


def declared(found: DataFrame) -> DataFrame:
    """(repo, path, file, section, entry, field, value): what stands in build files (repo, path, file, content) outside tests; a file that cannot be read has no rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["repo", "path", "file", "section", "entry", "field", "value"]
        for batch in batches:
            rows = []
            for repo, path, file, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                reader = next((r for end, r in _READERS if file.endswith(end)), None)
                try:
                    rows += [dict(zip(names, (repo, path, file, *leaf))) for leaf in (reader((content or b"").decode("utf-8", "replace")) if reader else ())]
                except (ElementTree.ParseError, tomllib.TOMLDecodeError):
                    continue
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string()) for n in names]))

    build = found.where(~is_test_file(F.col("path"))).select(F.col("repo").cast("string"), "path", "file", "content")
    return build.mapInArrow(parse, "repo string, path string, file string, section string, entry string, field string, value string")


def dependencies(found: DataFrame) -> DataFrame:
    """(repo, path, name, version): libraries with their versions; null where none is known.

    A version that names a variable has its value: in a Maven project of the same file, in a Gradle script of
    any script or settings of the repository, the first by path, then by value; a name with dots is also looked up by its last part.  A catalog's version
    is one of its own table, or what it says strictly or requires.
    """
    leaves = declared(found)
    field = lambda *names: F.coalesce(*[F.max(F.when(F.col("field") == n, F.col("value"))) for n in names])
    entries = leaves.where(F.col("section").isin("libraries", "plugins", "dependency", "plugin", "parent")).groupBy("repo", "path", "file", "section", "entry").agg(
        field("").alias("line"), field("module", "id").alias("module"), field("group", "groupId").alias("group"), field("name", "artifactId").alias("artifact"), field("version").alias("said"), field("version.ref").alias("ref"), field("version.strictly", "version.require").alias("rich")
    )
    # an entry may be one text: the last of three pieces, or of two of a plugin, is its version
    words = F.split("line", ":")
    size = F.when(F.col("section") == "plugins", 1).otherwise(2)
    maven = F.col("section").isin("dependency", "plugin", "parent")
    group = F.coalesce("group", F.when(F.col("section") == "plugin", "org.apache.maven.plugins"))
    name = F.coalesce("module", F.when(F.col("artifact").isNotNull() & (group.isNotNull() | ~maven), F.concat_ws(":", group, "artifact")), F.array_join(F.slice(words, F.lit(1), size), ":"))
    libraries = entries.select("repo", "path", "file", maven.alias("maven"), name.alias("name"), F.coalesce("said", F.nullif(F.get(words, size), F.lit(""))).alias("said"), "ref", "rich").where("name is not null")

    catalog = leaves.where("section = 'versions' and field = ''").select("repo", "path", F.col("entry").alias("ref"), F.col("value").alias("listed"))
    own_file = F.col("file") == "pom.xml"
    variables = leaves.where("section = 'variables'").groupBy("repo", F.when(own_file, F.col("path")).alias("scope"), F.col("entry").alias("key")).agg(F.min_by("value", F.struct("path", "value")).alias("value")).withColumn("scope", F.coalesce("scope", F.lit("")))
    whole = F.nullif(F.when(F.col("maven"), F.regexp_extract("said", r"^\$\{(.+)\}$", 1)).otherwise(F.regexp_extract(F.trim("said"), _REFERENCE, 1)), F.lit(""))
    asked = libraries.withColumns({"scope": F.when(F.col("maven"), F.col("path")).otherwise(""), "whole": whole, "last": F.when(~F.col("maven"), F.substring_index(whole, ".", -1))})
    by = lambda key, value: variables.select("repo", "scope", F.col("key").alias(key), F.col("value").alias(value))
    joined = asked.join(by("whole", "of_whole"), ["repo", "scope", "whole"], "left").join(by("last", "of_last"), ["repo", "scope", "last"], "left").join(catalog, ["repo", "path", "ref"], "left")
    literal = F.when(~F.col("said").contains("$"), F.col("said"))
    value = F.coalesce("listed", "rich", literal, "of_whole", "of_last")
    return joined.select("repo", "path", "name", F.when(~value.contains("$"), value).alias("version")).distinct()
