"""Parts of answers: grouped sources, ranks, counts by name, what matched, what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# ------------------------------------------------------------ sources


def unique_citations(citations: DataFrame) -> DataFrame:
    """One row per (claim, file, lines)."""
    return citations.dropDuplicates(["claim", "file", "lines"])


def source_groups(citations: DataFrame, most_folders: int = 8, most_reasons: int = 3) -> DataFrame:
    """(repo, commits, folders, more, reasons) of citations (repo, commit, file, claim, ord).

    Folders are those that no other folder of the repository holds, in order, the first
    ``most_folders`` and how many more; reasons are the first distinct claims.  Folders meet
    only the folders above them, so no repository is gathered whole.
    """
    cited = citations.where("repo is not null and repo <> ''")
    commits = cited.groupBy("repo").agg(F.array_sort(F.collect_set("commit")).alias("commits"))
    folder = F.when(F.col("file").contains("/"), F.concat(F.regexp_replace("file", "/[^/]*$", ""), F.lit("/"))).otherwise(F.col("file"))
    folders = cited.where("file is not null and file <> ''").select("repo", folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select("repo", "folder", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: n < F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))).alias("upper"))
    held = above.join(folders.select("repo", F.col("folder").alias("upper")), ["repo", "upper"], "left_semi").select("repo", "folder").distinct()
    top = folders.join(held, ["repo", "folder"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("folder")))
    shown = top.groupBy("repo").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most_folders, F.col("folder")))).alias("folders"), F.greatest(F.count("*") - most_folders, F.lit(0)).alias("more"))
    claims = cited.where("claim is not null").groupBy("repo", "claim").agg(F.min("ord").alias("ord"))
    first = claims.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("ord", "claim"))).where(F.col("n") <= most_reasons)
    reasons = first.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "claim"))), lambda x: x["claim"]).alias("reasons"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return commits.join(shown, "repo", "left").join(reasons, "repo", "left").select("repo", "commits", empty("folders"), F.coalesce("more", F.lit(0)).alias("more"), empty("reasons"))


def functions_by_file(entries: DataFrame) -> DataFrame:
    """(file, ord, symbol, lines): every function of a trace (file, symbol, start, end, ord) once, the first time it occurs, by line within its file."""
    first = entries.groupBy("file", "symbol").agg(F.min_by(F.struct("start", "end"), "ord").alias("at"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("at.start", "at.end", "symbol"))
    return first.select("file", order.alias("ord"), "symbol", F.concat_ws("-", "at.start", "at.end").alias("lines"))


# ------------------------------------------------------------ counts and ranks


def names_counted(items: DataFrame, group: str, name: str) -> DataFrame:
    """(group, counts): for each group a map from name to count."""
    counted = items.groupBy(group, name).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), "n")))).alias("counts"))


def version_usage(dependencies: DataFrame) -> DataFrame:
    """(library, applications, versions): how many applications use a library, and each version with its number of applications."""
    each = dependencies.groupBy("library", "version").agg(F.count_distinct("app").alias("n"))
    total = dependencies.groupBy("library").agg(F.count_distinct("app").alias("applications"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.coalesce("version", F.lit("unknown")).alias("version")))), lambda x: F.concat(x["version"], F.lit(" ("), (-x["less"]).cast("string"), F.lit(")")))
    return total.join(each.groupBy("library").agg(shown.alias("versions")), "library")


def keyword_rank(hits: DataFrame, query: str = "query", score: str = "score", id_col: str = "id") -> DataFrame:
    """Hits with their rank in their query, from 0, and the signal 1 / (1 + rank)."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), id_col)) - 1
    return hits.withColumn("rank", rank).withColumn("signal", F.lit(1.0) / (F.col("rank") + 1))


def scope_first(hits: DataFrame, extra: int = 3) -> DataFrame:
    """(query, id, place): hits (query, id, scoped, score) of the named scope by score, then the best ``extra`` outside it."""
    side = F.row_number().over(Window.partitionBy("query", "scoped").orderBy(F.desc("score"), "id"))
    kept = hits.withColumn("n", side).where(F.col("scoped") | (F.col("n") <= extra))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("scoped"), "n"))
    return kept.select("query", "id", place.alias("place"))


def call_order(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, depth, line, site) in call order: nearest first, then by line, then by the site's number; rows of no number last."""
    number = F.regexp_extract("site", "^([0-9]+)", 1).try_cast("bigint")
    order = F.row_number().over(Window.partitionBy(group).orderBy("depth", F.asc_nulls_last("line"), F.asc_nulls_last(number), "site"))
    return rows.withColumn("place", order)


def queue_heads(jobs: DataFrame) -> DataFrame:
    """The next job of each repository: the oldest queued of (id, repo, queued_at, status), unless one of the repository is running."""
    running = jobs.where("status = 'running'").select("repo").distinct()
    waiting = jobs.where("status = 'queued'").join(running, "repo", "left_anti")
    return waiting.groupBy("repo").agg(F.min_by("id", F.struct("queued_at", "id")).alias("id"))


def combinations(facts: DataFrame, *lists: str) -> DataFrame:
    """One fact for every combination of the values of list-valued columns; an empty list gives none."""
    out = facts
    for name in lists:
        out = out.withColumn(name, F.explode(name))
    return out


# ------------------------------------------------------------ search


def abbreviations(vocabulary: DataFrame, words: list[str], most: int = text.ABBREVIATIONS_PER_WORD) -> DataFrame:
    """(word, part, n): the parts of names (part) that abbreviate each query word, closest first, ``most`` at most."""
    tested = vocabulary.select("part", F.explode(F.filter(F.array(*[F.when(text.is_abbreviation(F.col("part"), F.lit(w)), F.lit(w)) for w in words]), lambda w: w.isNotNull())).alias("word")).distinct()
    n = F.row_number().over(Window.partitionBy("word").orderBy(F.desc(F.length("part")), "part"))
    return tested.withColumn("n", n).where(F.col("n") <= most).select("word", "part", "n")


def why_matched(digests: DataFrame, words: list[str], most: int = 3) -> DataFrame:
    """(id, matched): the items of a digest, separated by semicolons, that hold a query word or its stem; the first ``most``."""
    stems = [w for word in words for w in {word, _stem(word)}]
    holds = lambda item: F.exists(F.array(*map(F.lit, sorted(stems))), lambda w: F.contains(F.lower(item), w))
    items = F.filter(F.transform(F.split("digest", ";"), lambda item: F.trim(item)), lambda item: (item != "") & holds(item))
    return digests.select("id", F.slice(items, 1, most).alias("matched")).where(F.size("matched") > 0)


def _stem(word: str) -> str:
    from .search import _stem as stem

    return stem(word)


def entity_cards(entities: DataFrame, *related: tuple[str, DataFrame], most: int = 4) -> DataFrame:
    """Entities (id) with, for each (name, rows (id, value)), the first ``most`` distinct values; none is an empty list."""
    out = entities
    for name, rows in related:
        ranked = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("value"))).where(F.col("n") <= most)
        out = out.join(ranked.groupBy("id").agg(F.array_sort(F.collect_list("value")).alias(name)), "id", "left")
    return out.select(*entities.columns, *[F.coalesce(name, F.array().cast("array<string>")).alias(name) for name, _ in related])


# ------------------------------------------------------------ what is still to do


def to_generate(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, hash) of inputs (id, input) that no stored text (id, hash) was made from."""
    return inputs.select("id", F.sha2("input", 256).alias("hash")).join(cache.select("id", "hash"), ["id", "hash"], "left_anti")


def stale_embeddings(digests: DataFrame, marks: DataFrame, model: str) -> DataFrame:
    """(id, mark): digests (id, digest) whose stored mark (id, mark) is not that of this model and text, or is missing."""
    now = digests.select("id", F.sha2(F.concat(F.lit(model), F.coalesce("digest", F.lit(""))), 256).alias("mark"))
    return now.join(marks.select("id", F.col("mark").alias("stored")), "id", "left").where(~F.col("mark").eqNullSafe(F.col("stored"))).select("id", "mark")


def refreshed(proposed: DataFrame, requests: DataFrame) -> DataFrame:
    """Patterns (pattern, request) proposed in a change request (request, state): merged ones are covered, closed ones ignored, others stay proposed."""
    state = F.when(F.col("state") == "merged", "covered").when(F.col("state") == "closed", "ignored").otherwise("proposed")
    return proposed.join(requests.select("request", "state"), "request", "left").select("pattern", state.alias("state"))


def occurrences(places: DataFrame, patterns: DataFrame, most: int = 50) -> DataFrame:
    """(pattern, n, file, line): the places (pattern, file, line) of each of ``patterns`` (pattern), the first ``most``."""
    n = F.row_number().over(Window.partitionBy("pattern").orderBy("file", "line"))
    return places.join(patterns.select("pattern").distinct(), "pattern", "left_semi").withColumn("n", n).where(F.col("n") <= most).select("pattern", "n", "file", "line")


def trace_entry(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Entries (flow, path, …) that references (ref) such as ``trace:flow#path`` name."""
    at = refs.select(F.regexp_extract("ref", "^trace:(.*)#", 1).alias("flow"), F.regexp_extract("ref", "#([^#]*)$", 1).alias("path")).where("flow <> ''")
    return entries.join(at, ["flow", "path"], "left_semi")


def disagreements(agreements: DataFrame, applications: DataFrame) -> DataFrame:
    """Channel uses (app, …, agreement) of the applications (app) that witnesses do not agree on."""
    return agreements.where("agreement <> 'confirmed'").join(applications.select("app").distinct(), "app", "left_semi")


def witnesses(edges: DataFrame) -> DataFrame:
    """(app, channel, agreement, kind, file): reconciled edges with a row per witness in their JSON ``sources``."""
    found = F.from_json("sources", "array<struct<kind:string,file:string>>")
    return edges.select("app", "channel", "agreement", F.explode_outer(found).alias("s")).select("app", "channel", "agreement", "s.kind", "s.file")


def due_repositories(repositories: DataFrame, active: DataFrame) -> DataFrame:
    """(repo, state): busy if a job (repo) is active, failed without a head, unchanged if the head is the ingested commit, else due."""
    busy = active.select("repo", F.lit(True).alias("busy")).distinct()
    state = F.when(F.col("busy"), "busy").when(F.col("head").isNull(), "failed").when(F.col("head") == F.col("ingested"), "unchanged").otherwise("due")
    return repositories.join(busy, "repo", "left").select("repo", state.alias("state"))


# ------------------------------------------------------------ assembly of applications


#: What a trigger makes of its application. Fixed values.
KIND_OF = {"http": "Service", "grpc": "Service", "topic": "Consumer", "queue": "Consumer", "channel": "Consumer"}


def application_kinds(triggers: DataFrame, gateways: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(app, kinds): kinds by the triggers (app, trigger) of an application's flows, and Gateway where its own configuration routes (app).

    An application without a known trigger is left out: it gets no kind by default.
    """
    by = F.create_map(*[F.lit(x) for kv in (kinds or KIND_OF).items() for x in kv])
    known = triggers.select("app", F.try_element_at(by, "trigger").alias("kind")).where("kind is not null")
    return known.unionByName(gateways.select("app", F.lit("Gateway").alias("kind"))).groupBy("app").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def flows_assembled(entries: DataFrame, steps: DataFrame, inferred: DataFrame) -> DataFrame:
    """(flow, trigger, steps, effects, incomplete, inferred): one flow per entry point (flow, trigger), and per inferred root (flow).

    ``steps`` is (flow, type, gap): a step has an effect if it has a type, and a gap is a
    call that could not be followed.  A flow without steps is one of an entry that calls nothing.
    """
    roots = entries.select("flow", "trigger", F.lit(False).alias("inferred")).unionByName(
        inferred.join(entries.select("flow"), "flow", "left_anti").select("flow", F.lit("unknown").alias("trigger"), F.lit(True).alias("inferred"))
    )
    done = steps.groupBy("flow").agg(F.count("*").alias("steps"), F.count("type").alias("effects"), F.bool_or("gap").alias("incomplete"))
    return roots.join(done, "flow", "left").select("flow", "trigger", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("effects", F.lit(0)).alias("effects"), F.coalesce("incomplete", F.lit(False)).alias("incomplete"), "inferred")


def resource_view(flows: DataFrame, touches: DataFrame, parts: int | None = None) -> DataFrame:
    """(app, resource, flows, reads, writes): an application's flows (flow, app, resource) by resource, with what they touch (flow, type, target).

    Flows and targets are made distinct as rows of one table and then counted.  With ``parts``, rows are dealt into so many parts.
    """
    dealt = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    touched = dealt(touches.where("type in ('READS_FROM', 'WRITES_TO') and target is not null"), "flow")
    used = flows.join(touched, "flow").select("app", "resource", "type", "target", F.lit(None).alias("flow"))
    own = flows.select("app", "resource", F.lit(None).cast("string").alias("type"), F.lit(None).alias("target"), "flow")
    each = dealt(own.unionByName(used), "app", "resource", "type", "target", "flow").distinct()
    of = lambda kind: F.count_if(F.col("type") == kind)
    return each.groupBy("app", "resource").agg(F.count("flow").alias("flows"), of("READS_FROM").alias("reads"), of("WRITES_TO").alias("writes"))


def file_nodes(functions: DataFrame) -> DataFrame:
    """(file, functions, significant, module): files of functions (symbol, file, significant), in the module of their first two folders."""
    module = F.array_join(F.slice(F.split("file", "/"), 1, 2), "/")
    return functions.groupBy("file").agg(F.count_distinct("symbol").alias("functions"), F.count_if("significant").alias("significant")).withColumn("module", module)


def unknown_hooks(hooks: DataFrame, most: int = 4) -> DataFrame:
    """(app, text): hooks (app, target, name) of each application grouped by target, rarest first, each with its first names."""
    name = F.row_number().over(Window.partitionBy("app", "target").orderBy("name"))
    ranked = hooks.distinct().withColumn("n", name)
    per = ranked.groupBy("app", "target").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.col("name")))).alias("names"))
    shown = F.concat("target", F.lit(": "), F.array_join("names", ", "), F.when(F.col("n") > most, F.concat(F.lit(" (+"), (F.col("n") - most).cast("string"), F.lit(" more)"))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("n", "target", shown.alias("shown"))))
    return per.groupBy("app").agg(F.array_join(F.transform(listed, lambda x: x["shown"]), "; ").alias("text"))


def display_names(names: DataFrame, witness_order: list[str]) -> DataFrame:
    """(app, name): of an application's names (app, name, witness) the one of the first witness in order, then in the alphabet."""
    rank = F.array_position(F.array(*map(F.lit, witness_order)), F.col("witness"))
    return names.groupBy("app").agg(F.min_by("name", F.struct(F.when(rank > 0, rank).otherwise(len(witness_order) + 1), F.col("name"))).alias("name"))


def removal_plan(stored: DataFrame, planned: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, action): what to do with stored nodes (id, shared, repo) of the repositories in ``planned`` (id, repo) that are not planned again.

    A node of one repository is removed; a shared one is kept while an edge (src, dst, repo) of another
    repository touches it, and removed else.
    """
    repos = planned.select("repo").distinct()
    gone = stored.join(repos, "repo", "left_semi").join(planned.select("id"), "id", "left_anti")
    others = edges.join(repos, "repo", "left_anti")
    held = others.select(F.col("src").alias("id")).unionByName(others.select(F.col("dst").alias("id"))).distinct().withColumn("held", F.lit(True))
    return gone.join(held, "id", "left").select("id", F.when(F.col("shared") & F.coalesce("held", F.lit(False)), "keep").otherwise("remove").alias("action"))


def batches(rows: DataFrame, size_col: str, most: int, *order: str, group: str) -> DataFrame:
    """Rows with the number of the batch that they are written in: running sizes of a group, cut at multiples of ``most``."""
    before = F.coalesce(F.sum(size_col).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("batch", F.floor(before / most))


def alias_history(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(app, name, state): names stored (app, name) and seen (app, name): current, new, or kept as an alias."""
    both = stored.select("app", "name", F.lit(True).alias("was")).join(seen.select("app", "name", F.lit(True).alias("now")), ["app", "name"], "full_outer")
    return both.select("app", "name", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "alias").otherwise("current").alias("state"))


def expected_missing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected facts (kind, key, props map) without an actual fact of that kind and key that has all their properties.

    Actual facts are cut to each set of names that some expected fact of their kind has, and meet by equal values:
    the work grows with the facts, not with the pairs of one key.  A property that is absent counts as null.
    """
    held = lambda props: F.transform("names", lambda k: F.try_element_at(props, k)).alias("values")
    asked = expected.withColumn("names", F.array_sort(F.map_keys("props"))).select("kind", "key", "names", held(F.col("props"))).distinct()
    have = actual.join(asked.select("kind", "names").distinct(), "kind").select("kind", "key", "names", held(F.col("props"))).distinct()
    met = asked.join(have, ["kind", "key", "names", "values"]).select("kind", "key").distinct()
    return expected.join(met, ["kind", "key"], "left_anti").select("kind", "key")


def completeness(flows: DataFrame) -> DataFrame:
    """(app, flows, incomplete, inferred, share): what an answer can't vouch for, by application, of (app, incomplete, inferred)."""
    out = flows.groupBy("app").agg(F.count("*").alias("flows"), F.count_if("incomplete").alias("incomplete"), F.count_if("inferred").alias("inferred"))
    return out.withColumn("share", F.round(F.lit(100.0) * (F.col("flows") - F.col("incomplete")) / F.col("flows"), 1))


def invocations(calls: DataFrame, owners: DataFrame) -> DataFrame:
    """(caller, callee, place): calls (caller, type, name, line, col) bound to the owner (type, name, owner) of what their receiver inherits, by line and column."""
    bound = calls.join(owners, ["type", "name"], "left")
    callee = F.concat(F.coalesce("owner", "type"), F.lit("#"), "name")
    place = F.row_number().over(Window.partitionBy("caller").orderBy("line", "col", "name", "type"))
    return bound.select("caller", callee.alias("callee"), place.alias("place"))


# ------------------------------------------------------------ small functions
