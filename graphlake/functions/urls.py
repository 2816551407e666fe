"""URL and path functions as column expressions; templates such as ``/users/{id}`` are not valid URLs, so no URL parser is used."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A host inside a cluster names its service even where parts of it are set per environment.
_CLUSTER = r"^[^/:]+(\.svc(\.cluster\.local)?)(:[0-9]+)?$"


#: A URL's authority after a scheme, a configured base in place of one, or a bare authority; then the rest.
_URL = r"(?s)^(?:.*?://([^/]*)|\$?\{[^}]*\}?|([^/{$][^/]*|\$[^{/][^/]*|))(.*)$"


def host_and_path(url: Column) -> Column:
    """Struct (host, path): the host is null if unknown; templates and configured bases have none."""
    part = lambda n: F.regexp_extract(url, _URL, n)
    host = F.regexp_replace(F.concat(part(1), part(2)), "^.*@", "")
    based = url.rlike(r"^\$?\{") & ~url.contains("://")
    slash = F.when(part(3).startswith("/") | (based & (part(3) == "")), "").otherwise("/")
    # a cluster's host names its service, whatever else of it is set elsewhere
    known = (host != "") & (~host.contains("{") | F.regexp_replace(host, r"\$?\{[^{}]*\}", "#").rlike(_CLUSTER))
    return F.struct(F.when(known, host).alias("host"), F.coalesce(F.concat(slash, part(3)), F.lit("")).alias("path"))


def config_keys(text: Column) -> Column:
    """Sorted names inside ``${name}`` and ``${name:default}``."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([^}:]+)(?::[^}]*)?\}"), 1)))


def path_shape(path: Column) -> Column:
    """The path without query and final slash, parameters blanked."""
    shape = F.rtrim(F.regexp_replace(F.substring_index(path, "?", 1), r"\$?\{[^}]*\}", "{}"), F.lit("/"))
    return F.when(shape.startswith("/"), shape).otherwise(F.concat(F.lit("/"), shape))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.substring_index(path, "?", 1), "/"), lambda s: s != "")


def resource(path: Column) -> Column:
    """The first two segments that are not parameters: the router a route belongs to."""
    head = F.filter(F.slice(segments(path), 1, 2), lambda s: ~s.startswith("{"))
    return F.concat(F.lit("/"), F.array_join(head, "/"))


def template_fits(template: Column, path: Column) -> Column:
    """Whether a template of as many segments serves a path, segment by segment."""
    a, b = segments(path_shape(template)), segments(path_shape(path))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == "{}") | (x == y)), lambda ok: ok)


def gateway_regex(pattern: str) -> str:
    """Java regular expression of a gateway pattern: ``**`` anything, ``*`` and ``{x}`` one segment; a final ``/**`` also matches nothing."""
    out = ""
    for piece in re.findall(r"\*\*|\*|\{[^/}]+\}|[^*{]+|\{", pattern):
        out += ".*" if piece == "**" else "[^/]+" if piece == "*" or piece.endswith("}") and piece.startswith("{") else re.escape(piece)
    if out.endswith("/.*"):
        out = out[:-3] + "(?:/.*)?"
    return f"^{out}$"


def pattern_regex(pattern: Column) -> Column:
    """``gateway_regex`` for a column of patterns: wildcards become marks first, what is left is quoted, marks become expressions."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\*\*", "\x01"), r"\*", "\x02"), r"\{[^/}]+\}", "\x02")
    quoted = F.regexp_replace(marked, r"([^A-Za-z0-9_/\x01\x02])", r"\\$1")
    open_end = F.when(quoted.endswith("/\x01"), F.concat(quoted.substr(F.lit(1), F.length(quoted) - 2), F.lit("(?:/.*)?"))).otherwise(quoted)
    return F.concat(F.lit("^"), F.replace(F.replace(open_end, F.lit("\x01"), F.lit(".*")), F.lit("\x02"), F.lit("[^/]+")), F.lit("$"))


def inside_path(path: Column, strip: Column, prefix: Column, rewrite: Column | None = None) -> Column:
    """The path behind a gateway: leading segments cut, then rewritten (``regex, replacement``), then a prefix put on."""
    kept = F.when(strip > 0, F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.trim(path, F.lit("/")), "/"), lambda _, i: i >= strip), "/"))).otherwise(path)
    if rewrite is not None:
        rule = F.split(rewrite, ",", 2)
        kept = F.when(rewrite.isNotNull() & (rewrite != ""), F.regexp_replace(kept, F.trim(rule[0]), F.trim(F.coalesce(F.get(rule, F.lit(1)), F.lit(""))))).otherwise(kept)
    lead = F.concat(F.lit("/"), F.trim(prefix, F.lit("/")))
    out = F.when(prefix.isNull() | (prefix == ""), kept).otherwise(F.concat(lead, F.when(kept == "/", "").otherwise(kept)))
    return F.when(out == "", "/").otherwise(out)


def outside_path(inside: Column, lead: Column, prefix: Column) -> Column:
    """The reverse: ``prefix`` taken off (null if it is not there), literal ``lead`` put on; null if ``lead`` is no literal."""
    p = F.concat(F.lit("/"), F.trim(prefix, F.lit("/")))
    none = prefix.isNull() | (prefix == "")
    bare = F.when(none, inside).when((inside == p) | inside.startswith(F.concat(p, F.lit("/"))), inside.substr(F.length(p) + 1, F.length(inside)))
    bare = F.when(bare == "", "/").otherwise(bare)
    return F.when(lead.rlike(r"[*{]"), F.lit(None).cast("string")).otherwise(F.when(lead == "", bare).otherwise(F.concat(F.lit("/"), lead, F.when(bare == "/", "").otherwise(bare))))


#: Connection URLs: a pattern with groups for vendor, host and database, the first that fits counts. Fixed formats.
CONNECTIONS = (
    r"^(oracle):(?:[^@]*@)?/*([^/]*)/(.*)$",
    r"^(oracle):(?:[^@]*@)?/*(.*):([^:]*)$",
    r"^(sqlserver)://([^;]*)(?=.*;(?:databaseName|database)=([^;]*)|)",
    r"^(h2):()(?:.*:)?([^:;]*)(?:;.*)?$",
    r"^(?:[^/]*:)?([^:/+]*)(?:\+[^:/]*)?://(?:[^/?]*@)?([^/?]*)(?:/([^/?]*))?",
)


def database_of(url: Column) -> Column:
    """Struct (vendor, host, database) of a connection URL without its credentials; null for other text.  A database inside the process has the host ``embedded``."""
    text = F.regexp_replace(F.trim(url), "^jdbc:", "")
    read = lambda pattern: F.struct(*[F.regexp_extract(text, pattern, n).alias(name) for n, name in enumerate(("vendor", "host", "database"), 1)])
    first = F.coalesce(*[F.when(text.rlike(pattern), read(pattern)) for pattern in CONNECTIONS])
    return F.when(first["vendor"] == "h2", first.withField("host", F.lit("embedded"))).otherwise(first)


def join_path(base: Column, path: Column) -> Column:
    """Two parts of a path with one slash between them."""
    joined = F.concat(F.rtrim(F.coalesce(base, F.lit("")), F.lit("/")), F.lit("/"), F.ltrim(F.coalesce(path, F.lit("")), F.lit("/")))
    shorter = F.rtrim(joined, F.lit("/"))
    return F.when(shorter == "", "/").otherwise(shorter)


def host_of(text: Column) -> Column:
    """The authority of a URL or of ``host:port``, with its user; null if there is none."""
    rest = F.when(text.contains("://"), F.split(text, "://", 2)[1]).otherwise(text)
    return F.nullif(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
