"""Tables that query texts name: entities and their relations by alias, tables of native texts, and what finds no table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Words after a name that are no alias of it. Fixed values.
NO_ALIAS = ("select", "where", "on", "set", "join", "left", "inner", "order", "group", "as")
_WORD = r"[A-Za-z_]\w*"
#: A source in a query text: keyword, dotted name, alias. No word that goes on with the text is taken for an alias.
_SOURCE = rf"(?i)\b(from|update|into|join(?:\s+fetch)?)\s+({_WORD}(?:\.{_WORD})*)(?:\s+(?:as\s+)?(?!(?:{'|'.join(NO_ALIAS)})\b)({_WORD}))?"


def sources(queries: DataFrame) -> DataFrame:
    """(symbol, native, verb, at, opens, head, rest, last, alias): the sources of each text (symbol, query, native), in order.

    ``head`` is what stands before a name's first dot, ``rest`` all after it, ``last`` what stands after its last; ``opens`` tells of
    a keyword that can name what is written.
    """
    found = F.arrays_zip(*[F.regexp_extract_all("query", F.lit(_SOURCE), n).alias(name) for n, name in enumerate(("keyword", "name", "alias"), 1)])
    verb = F.lower(F.regexp_extract(F.ltrim("query"), r"^(\S+)", 1))
    rows = queries.select("symbol", "native", verb.alias("verb"), F.posexplode(found).alias("at", "s")).select("symbol", "native", "verb", "at", "s.*")
    alias = F.nullif("alias", F.lit(""))
    head = F.when(F.col("name").contains("."), F.substring_index("name", ".", 1))
    rest = F.when(F.col("name").contains("."), F.regexp_extract("name", r"^[^.]*\.(.*)$", 1))
    return rows.select("symbol", "native", "verb", "at", F.lower("keyword").isin("update", "into", "from").alias("opens"), head.alias("head"), rest.alias("rest"), F.substring_index("name", ".", -1).alias("last"), alias.alias("alias"))


def entities_of(found: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(symbol, at, entity): the entity of each source of texts that name entities; null if it has none.

    ``entities`` is (entity), ``relations`` (entity, field, target).  A name whose head is an alias is a relation of
    what the alias stands for: the last source before it of that alias that has an entity, so that a nested select's
    alias hides an outer one.  Any other name is an entity by its last part.  A round decides
    the sources whose aliases are decided; there are as many rounds as aliases lean on each other.  Sources are joined with
    each other by sorting: a side that shuffles to few bytes holds millions of rows, and a broadcast would send them through the driver.
    """
    scratch = Scratch(found.sparkSession, "entities")
    simple = entities.select("entity", F.substring_index("entity", ".", -1).alias("last")).groupBy("last").agg(F.max("entity").alias("by_name"))
    related = relations.select(F.col("entity").alias("of"), F.col("field").alias("rest"), F.col("target").alias("by_relation")).groupBy("of", "rest").agg(F.min("by_relation").alias("by_relation"))
    rows = scratch.keep(found.where("not native").select("symbol", "at", "head", "rest", "last", "alias").join(simple, "last", "left"), "sources")
    # what may stand before a name: sources of its alias, nearest first
    leans = rows.where("head is not null").select("symbol", "at", "head").hint("merge").join(rows.where("alias is not null").select("symbol", F.col("alias").alias("head"), F.col("at").alias("before")), ["symbol", "head"]).where("before < at")
    leans = scratch.keep(leans.select("symbol", "at", "before"), "leans")
    open_rows = leans.select("symbol", "at").distinct().hint("merge")
    decided = scratch.keep(rows.join(open_rows, ["symbol", "at"], "left_anti").select("symbol", "at", F.col("by_name").alias("entity")), "decided")
    waiting, n = scratch.keep_counted(rows.join(open_rows, ["symbol", "at"], "left_semi"), "waiting")
    while n:
        state = leans.join(waiting.select("symbol", "at").hint("merge"), ["symbol", "at"], "left_semi").join(decided.select("symbol", F.col("at").alias("before"), F.col("entity").alias("of"), F.lit(True).alias("known")).hint("merge"), ["symbol", "before"], "left")
        # the nearest that is not known to have no entity
        nearest = state.groupBy("symbol", "at").agg(F.max(F.when(F.col("known").isNull() | F.col("of").isNotNull(), F.struct("before", F.coalesce("known", F.lit(False)).alias("known"), "of"))).alias("n"))
        ready = waiting.join(nearest.where("n is null or n.known").select("symbol", "at", F.col("n.of").alias("of")).hint("merge"), ["symbol", "at"]).join(related, ["of", "rest"], "left")
        new = scratch.keep(ready.select("symbol", "at", F.when(F.col("of").isNull(), F.col("by_name")).otherwise(F.col("by_relation")).alias("entity")), "decided")
        decided = decided.unionByName(new)
        waiting, n = scratch.keep_counted(waiting.join(new.select("symbol", "at").hint("merge"), ["symbol", "at"], "left_anti"), "waiting")
    return decided


def tables(queries: DataFrame, mapped: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables that query texts touch, (symbol, table, type, operation), and sources without one, (symbol, at, name, reason).

    ``queries`` is (symbol, query, native), ``mapped`` (entity, table), ``relations`` (entity, field, target).  Native texts name tables.
    A table counts once, where it stands first; the first table of a text that updates, deletes or inserts is written
    if a keyword that can name what is written stands before it, all others are read.
    """
    scratch = Scratch(queries.sparkSession, "tables")
    found = scratch.keep(sources(queries.where("query is not null").select("symbol", "query", F.coalesce("native", F.lit(False)).alias("native"))), "sources")
    of = entities_of(found, mapped.select("entity"), relations).join(mapped.groupBy("entity").agg(F.min("table").alias("table")), "entity", "left")
    named = found.where("native").select("symbol", "at", F.lit(None).cast("string").alias("entity"), F.col("last").alias("table")).unionByName(of.select("symbol", "at", "entity", "table"))
    both = scratch.keep(found.join(named.hint("merge"), ["symbol", "at"]), "named")
    first = both.where("table is not null").groupBy("symbol", "table").agg(F.min(F.struct("at", "opens", "verb")).alias("f")).select("symbol", "table", "f.*")
    lead = F.row_number().over(Window.partitionBy("symbol").orderBy("at")) == 1
    written = lead & F.col("opens") & F.col("verb").isin("update", "delete", "insert")
    touched = first.withColumn("written", written).select("symbol", "table", F.when(F.col("written"), "WRITES_TO").otherwise("READS_FROM").alias("type"), F.when(F.col("written"), F.col("verb")).otherwise("select").alias("operation"))
    reason = F.when(F.col("entity").isNull(), "no entity").otherwise("not a mapped entity")
    lost = both.where("table is null").select("symbol", "at", F.concat_ws(".", "head", F.coalesce("rest", "last")).alias("name"), reason.alias("reason"))
    return touched, lost


def table_of(edges: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (edge, entity) with the table that their entity maps to, (edge, entity, table), and those without one, (edge, entity, reason)."""
    joined = edges.join(mapped.groupBy("entity").agg(F.min("table").alias("table")), "entity", "left")
    return joined.where("table is not null"), joined.where("table is null").drop("table").withColumn("reason", F.lit("table_of: not a mapped entity"))
