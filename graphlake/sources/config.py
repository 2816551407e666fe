"""Configuration files as tables: listing, flat keys with line numbers, record trees, declarative rules."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # optional
    yaml = None

#: Folders that hold no source of the repository itself; fixed values.
SKIPPED = ("node_modules", "target", "build", "dist", ".git", ".venv", "venv", "__pycache__", ".gradle", ".idea")
#: Keys whose values are never kept.
SECRET_KEY = r"(?i)(password|passwd|secret|token|credential|api[._-]?key|private[._-]?key)"


def files(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, file, content): files below ``root`` in order of path, without dependency and build folders.

    Listing and reading are the engine's, so any store that it reads will do.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    skip = "|".join(re.escape(s) for s in SKIPPED)
    found = found.where(~F.col("path").rlike(f"/({skip})/"))
    if suffixes:
        found = found.where(F.col("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    return found.select("path", F.substring_index("path", "/", -1).alias("file"), "content")


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__|spec)/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*(_test|Test|Tests|IT|\.spec|\.test))\.[A-Za-z]+$")


def glob_matches(path: Column, pattern: str) -> Column:
    """Shell pattern on the whole relative path or on the name alone."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return path.rlike(f"^{out}$") | F.substring_index(path, "/", -1).rlike(f"^{out}$")


def flatten(value, prefix: str = "") -> Iterator[tuple[str, str]]:
    """Dotted keys of a nested value: lists of scalars joined by commas, lists of objects indexed, nulls left out."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        if any(isinstance(v, (dict, list)) for v in value):
            for i, v in enumerate(value):
                yield from flatten(v, f"{prefix}[{i}]")
        elif value:
            yield prefix, ",".join(map(_text, value))
    elif value is not None:
        yield prefix, _text(value)


def _text(value) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _element(e: ElementTree.Element):
    """An XML element as attributes and children; a repeated tag is a list, a bare one its text."""
    name = lambda tag: tag.rsplit("}", 1)[-1]
    out: dict = {name(k): v for k, v in e.attrib.items()}
    for child in e:
        tag, value = name(child.tag), _element(child)
        if tag in out:
            out[tag] = [*(out[tag] if isinstance(out[tag], list) else [out[tag]]), value]
        else:
            out[tag] = value
    text = (e.text or "").strip()
    return text if not out else (out | {"text": text} if text else out)


def parsed(name: str, text: str) -> tuple[list, str | None]:
    """The documents of one file by its kind, and why it could not be read; kinds that are no configuration have neither."""
    try:
        if name.endswith((".yml", ".yaml")):
            if yaml is None:
                return [], "no YAML library"
            return [d for d in yaml.safe_load_all(text) if d is not None], None
        if name.endswith(".json"):
            return [json.loads(text)], None
        if name.endswith(".xml"):
            root = ElementTree.fromstring(text)
            return [{root.tag.rsplit("}", 1)[-1]: _element(root)}], None
    except (ValueError, ElementTree.ParseError, RecursionError, *([yaml.YAMLError] if yaml else [])) as error:
        return [], f"{type(error).__name__}: {error}".splitlines()[0][:200]
    if name.endswith((".properties", ".env")) or name == ".env":
        out = {}
        for line in re.sub(r"\\\r?\n\s*", "", text).splitlines():
            line = line.strip()
            m = re.match(r"(?:export\s+)?([^#!=:\s][^=:\s]*)\s*[=:]\s*(.*)", line)
            if m and not line.startswith(("#", "!")):
                out[m[1]] = m[2].strip().strip("\"'")
        return [out], None
    return [], None


def documents(name: str, text: str) -> list:
    """The documents of one file; one that cannot be read has none here and a row in ``unparsed``."""
    return parsed(name, text)[0]


def unparsed(found: DataFrame) -> DataFrame:
    """(path, error) of files (path, file, content) that could not be read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                error = parsed(name, (content or b"").decode("utf-8", "replace"))[1]
                if error:
                    rows.append({"path": path, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("error", pa.string())]))

    return found.select("path", "file", "content").mapInArrow(parse, "path string, error string")


#: A word of a line that is a key or a tag: it follows a space, bracket, quote or dot, and a sign or space follows it.
_KEY_IN_LINE = re.compile(r"""(?:^|(?<=[\s<"'.]))([^\s<>"'.:=]+)(?=["']?\s*[:=]|[\s>])""")


class Lines:
    """The first line of each key of a text; one pass over the text, whatever the number of keys."""

    def __init__(self, text: str):
        self.first: dict[str, int] = {}
        for n, line in enumerate(text.splitlines(), 1):
            for word in _KEY_IN_LINE.findall(line):
                self.first.setdefault(word, n)

    def of(self, key: str) -> int:
        """The line of a dotted key's last part; 0 if none has it."""
        return self.first.get(re.sub(r"\[\d+\]", "", key).rsplit(".", 1)[-1], 0)


def read(found: DataFrame) -> DataFrame:
    """(path, key, value, line): flat keys of configuration files; values of secret keys are blanked."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = (content or b"").decode("utf-8", "replace")
                lines = Lines(text)
                for doc in documents(name, text):
                    rows += [(path, k, None if re.search(SECRET_KEY, k) else v, lines.of(k)) for k, v in flatten(doc)]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "key", "value", "line"), r)) for r in rows], pa.schema([("path", pa.string()), ("key", pa.string()), ("value", pa.string()), ("line", pa.int32())]))

    return found.select("path", "file", "content").mapInArrow(parse, "path string, key string, value string, line int")


def key_pattern(pattern: str) -> tuple[str, list[str]]:
    """Java regular expression of a key pattern and the names it captures: ``{NAME}`` and ``*`` one segment, ``**`` any number."""
    names, out = [], ""
    for piece in re.findall(r"\*\*|\*|\{\w+\}|[^*{]+", pattern):
        if piece == "**":
            out += ".*"
        elif piece == "*":
            out += "[^.]+"
        elif piece[0] == "{":
            names.append(piece[1:-1])
            out += "([^.]+)"
        else:
            out += re.escape(piece)
    return f"^{out}$", names


def matching(config: DataFrame, pattern: str) -> DataFrame:
    """Rows whose key fits, with a column per captured name."""
    regex, names = key_pattern(pattern)
    return config.where(F.col("key").rlike(regex)).withColumns({n: F.regexp_extract("key", regex, i + 1) for i, n in enumerate(names)})


def walk(value, path: str) -> Iterator:
    """Values at a path such as ``spec.rules[*].name``; ``*`` goes over the values of an object, ``@key`` gives its keys."""
    todo = [value]
    for step in re.findall(r"[^.\[\]]+|\[\*\]", path):
        nxt = []
        for v in todo:
            if step == "[*]" or step == "*":
                nxt += list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
            elif step == "@key":
                nxt += list(v) if isinstance(v, dict) else []
            elif isinstance(v, dict) and step in v:
                nxt.append(v[step])
        todo = nxt
    yield from todo


def records(found: DataFrame, path: str) -> DataFrame:
    """(path, record): JSON text of what stands at a path in each document."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"path": p, "record": json.dumps(v, sort_keys=True, default=str)}
                for p, name, content in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for doc in documents(name, (content or b"").decode("utf-8", "replace"))
                for v in walk(doc, path)
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("record", pa.string())]))

    return found.select("path", "file", "content").mapInArrow(parse, "path string, record string")


def _field(name: str) -> Column:
    return F.get_json_object("record", "$." + name)


def apply_rule(rows: DataFrame, rule: dict) -> DataFrame:
    """(kind, fields map) facts of a rule over records.

    ``rule`` has ``when``, a field to a test (a value, or one of ``in``, ``not_in``,
    ``contains``, ``matches``, ``exists``), and ``emit``, a kind with fields whose
    ``{name}`` parts are filled from the record.  Records that lack a filled
    part are left out.
    """
    keep = F.lit(True)
    for name, test in rule.get("when", {}).items():
        v = _field(name)
        if not isinstance(test, dict):
            keep = keep & (v == F.lit(_text(test)))
            continue
        for op, want in test.items():
            keep = keep & {
                "in": lambda: v.isin([_text(x) for x in want]),  # noqa: B023
                "not_in": lambda: ~F.coalesce(v.isin([_text(x) for x in want]), F.lit(False)),  # noqa: B023
                "contains": lambda: F.contains(v, F.lit(_text(want))),  # noqa: B023
                "matches": lambda: v.rlike(want),  # noqa: B023
                "exists": lambda: v.isNotNull() == F.lit(bool(want)),  # noqa: B023
            }[op]()
    fields = []
    for name, template in rule["emit"]["fields"].items():
        parts = [_field(p[1:-1]) if p.startswith("{") else F.lit(p) for p in re.findall(r"\{[^}]+\}|[^{]+", template)]
        fields += [F.lit(name), F.concat(*parts)]
    out = rows.where(keep).select("path", F.lit(rule["emit"]["kind"]).alias("kind"), F.create_map(*fields).alias("fields"))
    return out.where(F.forall(F.map_values("fields"), lambda v: v.isNotNull()))


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")
