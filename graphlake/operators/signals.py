"""Coverage signals: each a table of (signal, target, app, evidence) rows of what is not explained yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, versions


def _rows(df: DataFrame, signal: str, target: Column, app: Column | None = None, evidence: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(signal).alias("signal"), target.cast("string").alias("target"), (app if app is not None else F.lit(None)).cast("string").alias("app"),
        (evidence if evidence is not None else F.array()).cast("array<string>").alias("evidence"),
    )


def silent_repository(repositories: DataFrame, applications: DataFrame, claims: DataFrame, modules: DataFrame) -> DataFrame:
    """Repositories (repo) with no application, claim or library module (repo)."""
    quiet = repositories
    for said in (applications, claims, modules):
        quiet = quiet.join(said.select("repo"), "repo", "left_anti")
    return _rows(quiet, "silent_repository", F.col("repo"))


def silent_witness(packs: DataFrame, facts: DataFrame) -> DataFrame:
    """Enabled packs (pack) from which no fact (pack) came."""
    return _rows(packs.join(facts.select("pack"), "pack", "left_anti"), "silent_witness", F.col("pack"))


def one_sided(sided: DataFrame) -> DataFrame:
    return _rows(sided, "one_sided", F.col("channel"))


def unknown_hook(hooks: DataFrame, declared: DataFrame, work: str = r"(?i)(handler|listener|consumer|job|task|worker|scheduler|interceptor|filter)") -> DataFrame:
    """Framework hooks (type, app) that no rule (type) declares; one whose name says so can start work."""
    return _rows(hooks.join(declared.select("type"), "type", "left_anti"), "unknown_hook", F.col("type"), F.col("app"), F.when(F.col("type").rlike(work), F.array(F.lit("can_start_work"))).otherwise(F.array()))


def external_call(calls: DataFrame) -> DataFrame:
    """Library calls (library, app, verdict, explained) that can do I/O and that nothing explains."""
    return _rows(calls.where("verdict = 'io' and not explained"), "external_call", F.col("library"), F.col("app"))


def library(imports: DataFrame, covered: DataFrame) -> DataFrame:
    """Imported libraries (library, app) that no pack (library) covers."""
    return _rows(imports.join(covered.select("library"), "library", "left_anti"), "library", F.col("library"), F.col("app"))


def internal_library(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imported libraries (library, app) that a module (library, app) of another application of the organization builds."""
    built = modules.select("library", F.col("app").alias("builder"))
    return _rows(imports.join(built, "library").where("app <> builder").select("library", "app").distinct(), "internal_library", F.col("library"), F.col("app"))


def external_library(imports: DataFrame, modules: DataFrame, covered: DataFrame) -> DataFrame:
    """Imported libraries (library, app) that no module (library) builds and no pack (library) covers."""
    left = imports.join(modules.select("library"), "library", "left_anti").join(covered.select("library"), "library", "left_anti")
    return _rows(left, "external_library", F.col("library"), F.col("app"))


def file_call(calls: DataFrame) -> DataFrame:
    """Library calls (library, app, verdict, explained) that can touch files and that nothing explains."""
    return _rows(calls.where("verdict = 'file' and not explained"), "file_call", F.col("library"), F.col("app"))


def evidenced(items: DataFrame, referenced: DataFrame, names: DataFrame, modules: DataFrame) -> DataFrame:
    """Items (signal, target, app, evidence) with evidence added: a flow refers to the target (target), its last part is a known name (name), its application is a library module (app)."""
    last = F.element_at(F.split("target", r"[.#/]"), -1)
    mark = lambda df, key, word: df.select(F.col(key).alias(f"_{word}"), F.lit(word).alias(word)).distinct()
    out = items.withColumn("_last", last)
    for df, key, word, on in ((referenced, "target", "referenced", "target"), (names, "name", "name_known", "_last"), (modules, "app", "in_library_module", "app")):
        known = mark(df, key, word)
        out = out.join(known, out[on] == known[f"_{word}"], "left").drop(f"_{word}")
    added = F.array_compact(F.array("referenced", "name_known", "in_library_module"))
    return out.select("signal", "target", "app", F.array_distinct(F.concat("evidence", added)).alias("evidence"))


def disagreement(agreed: DataFrame) -> DataFrame:
    return _rows(agreed.where("agreement <> 'confirmed'"), "disagreement", F.concat_ws("|", "agreement", "app", "role", "channel"), F.col("app"))


def unmatched_name(names: DataFrame) -> DataFrame:
    """Names (name, id) that resolve to no application."""
    return _rows(names.where("id is null"), "unmatched_name", F.col("name"))


def inferred_entry(functions: DataFrame, calls: DataFrame, implicit: DataFrame) -> DataFrame:
    """Functions with effects (symbol, app) that nothing calls (callee) and nothing runs implicitly (symbol), by owner class."""
    roots = functions.join(calls.select(F.col("callee").alias("symbol")), "symbol", "left_anti").join(implicit.select("symbol"), "symbol", "left_anti")
    return _rows(roots, "inferred_entry", F.substring_index("symbol", "#", 1), F.col("app"))


def no_trigger_application(applications: DataFrame) -> DataFrame:
    return _rows(applications.where("kind is null"), "no_trigger_application", F.col("app"), F.col("app"))


def unreachable_effect(effects: DataFrame, reached: DataFrame) -> DataFrame:
    """Functions with effects (symbol, app) that no flow reaches (node)."""
    return _rows(effects.join(reached.select(F.col("node").alias("symbol")), "symbol", "left_anti"), "unreachable_effect", F.col("symbol"), F.col("app"))


def unknown_host(calls: DataFrame) -> DataFrame:
    """HTTP calls (symbol, app, host) whose host is only known at run time, by calling class."""
    return _rows(calls.where("host is null"), "unknown_host", F.substring_index("symbol", "#", 1), F.col("app"))


def config_unset(needed: DataFrame, config: DataFrame) -> DataFrame:
    """Keys inside ``${…}`` of texts (text, app) that no configuration (key) sets."""
    from ..functions import urls

    keys = needed.select("app", F.explode(urls.config_keys(F.col("text"))).alias("key"))
    return _rows(keys.join(config.select("key"), "key", "left_anti"), "config_unset", F.col("key"), F.col("app"))


def dropped_match(dropped: DataFrame, expected: list[str]) -> DataFrame:
    """Matches (rule, reason, app) that a rule could not complete, but for expected reasons."""
    return _rows(dropped.where(~F.col("reason").isin(expected)), "dropped_match", F.concat_ws(": ", "rule", "reason"), F.col("app"))


def version_signals(declared: DataFrame, tested: list[tuple[str, str]]) -> DataFrame:
    """Libraries (library, version, app) outside the range that rules were tested with, or without a version."""
    out = None
    for name, spec in tested:
        one = declared.where(F.col("library") == name)
        rows = _rows(one.where(F.col("version").isNull()), "version_unknown", F.col("library"), F.col("app")).unionByName(
            _rows(one.where(~versions.in_range(F.col("version"), spec)), "version_untested", F.concat_ws(" ", "library", "version"), F.col("app"))
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def unread_file(files: DataFrame, read: DataFrame) -> DataFrame:
    """Files (path, app) that no rule read (path), grouped by ending and folder convention."""
    left = files.join(read.select("path"), "path", "left_anti")
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"src/(?:main/)?(.*)/[^/]*$", 1), F.lit("")), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    return _rows(left, "unread_file", F.concat(F.regexp_extract("path", r"(\.[^./]*)$", 1), F.lit("@"), folder), F.col("app"))


def unread_config(config: DataFrame, used: DataFrame) -> DataFrame:
    """Configuration keys (key, app) that no rule used (key), by prefix."""
    return _rows(config.join(used.select("key"), "key", "left_anti"), "unread_config", text.config_prefix(F.col("key")), F.col("app"))


def gathered(*signals: DataFrame) -> DataFrame:
    """Items of all signals: occurrences, applications and evidence per target, with the rank of each."""
    everything = signals[0]
    for s in signals[1:]:
        everything = everything.unionByName(s)
    per = everything.groupBy("signal", "target").agg(
        F.count("*").alias("occurrences"), F.count_distinct("app").alias("applications"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence")
    )
    return per.withColumn("score", versions.score(F.col("signal"), F.lit(1), F.col("applications"), F.col("occurrences"), F.size("evidence")))


def quiet(items: DataFrame, signal: str, least_applications: int) -> DataFrame:
    """Marks items of a signal that many applications share: a habit of the house, not a gap of one."""
    return items.withColumn("quiet", (F.col("signal") == signal) & (F.col("applications") >= least_applications))
