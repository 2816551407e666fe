"""From raw documents to token ids, in five stages, each an operator of this subpackage.

A stage gets the rows that its predecessor kept, written as Parquet and read
again, and all but the last return the columns of ``documents``.  Columns that a stage
works with have names that no table has.  In every stage a row is a document of its own:
ids may be null or repeat, texts may be null, empty or very long, and no rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, langid, mixing
from .common import Scratch, filter_bits, key_filter, marked

#: No SQL: language prediction, similarity components and byte-pair encoding are beyond it.
ORACLE_SQL = None


def _name(what: str) -> str:
    """A column name that no table has."""
    return f"_{what}_{uuid.uuid4().hex}"


def _split(docs: DataFrame, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame, str]:
    """Rows whose (doc_id, hash ``key``) is surely not in ``keys`` (id, hash), and the rest; the name of the hash."""
    some, hashed = _name("some"), _name("hash")
    bits = filter_bits(keys.count())
    filters = key_filter(keys.select(F.col("id").alias("doc_id"), F.col("hash").alias(hashed)), "doc_id", hashed, bits=bits)
    split = marked(docs.withColumn(hashed, key), some, filters, "doc_id", hashed, bits=bits)
    return split.where(~F.col(some)).select(*docs.columns), split.where(some).drop(some), hashed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, that is null or without a letter, go; a missing label is filled in.

    Learns from the rows with a label that are not held out; without any, all rows go.
    """
    judged = langid.identify(docs, docs.where(~langid.held_out(docs["doc_id"])), keep=docs.columns)
    pred = _name("pred")
    kept = judged.toDF(_name("id"), pred, _name("score"), *docs.columns).where(F.col(pred) != langid.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text stays, that of the smallest id; rows whose texts differ all stay, whatever their ids.

    Verdicts are kept by id and hash of the text, null ids among them.  Rows that
    repeat both are told apart by no verdict: one of them is taken by a map-side aggregate.
    """
    scratch = Scratch(spark, "pipeline-exact")
    columns = docs.columns
    norm = exact_dedup.normalised(docs["text"])
    verdicts = exact_dedup.exact_dedup(docs, carry={"hash": F.xxhash64(norm), "sha": F.sha2(norm, 256)}).where("group_size > 1")
    verdicts = verdicts.groupBy(F.col("doc_id").alias("id"), "hash", "sha").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    verdicts = scratch.keep(verdicts.where("not kept or n > 1"), "verdicts")
    rest, some, hashed = _split(docs, verdicts, F.xxhash64(norm))
    sha, row = _name("sha"), _name("row")
    some = some.drop(hashed).withColumn(sha, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    same = some["doc_id"].eqNullSafe(verdicts["id"]) & (some[sha] == verdicts["sha"])
    single = some.join(verdicts, same, "left_anti").select(*columns)
    kept = verdicts.where("kept")
    same = some["doc_id"].eqNullSafe(kept["id"]) & (some[sha] == kept["sha"])
    repeated = some.join(kept, same, "left_semi").groupBy("doc_id", sha).agg(F.first(F.struct(*columns)).alias(row)).select(*[F.col(row)[c].alias(c) for c in columns])
    return rest.unionByName(single).unionByName(repeated)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id, of those the smallest hash of the text.

    Rows without words link with nothing and stay.
    """
    scratch = Scratch(spark, "pipeline-near")
    found = jaccard_join.jaccard_components(docs, carry={"hash": F.xxhash64("text")}, label="component").where("component is not null")
    found = scratch.keep(found.select(F.col("doc_id").alias("id"), "hash", "component"), "components")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("stays")
    groups = found.groupBy("component").agg(least, F.count("*").alias("n")).where("n > 1").select("component", "stays.id", "stays.hash")
    stays = found.join(groups.select("component", F.col("id").alias("stays_id"), F.col("hash").alias("stays_hash")), "component")
    dropped = scratch.keep(stays.where(~(F.col("id").eqNullSafe(F.col("stays_id")) & F.col("hash").eqNullSafe(F.col("stays_hash")))).select("id", "hash").distinct(), "dropped")
    rest, some, hashed = _split(docs, dropped, F.xxhash64("text"))
    gone = some["doc_id"].eqNullSafe(dropped["id"]) & (some[hashed] == dropped["hash"])
    return rest.unionByName(some.join(dropped, gone, "left_anti").select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: by file, and by row inside a file."""
    mixed = mixing.mix(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "slot").sortWithinPartitions("slot", "place").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, part, row, ids, n_tokens, ids_sha256, decoded_sha256) of every document.

    ``part`` and ``row`` are the document's place in the mixture: the number of the
    file that it was read from, and its row there; null for tables that are no files.
    """
    path, pattern = bpe._vocabulary()
    part, row = _name("part"), _name("row")
    try:
        placed = docs.withColumns({part: F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("bigint"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        placed = docs.withColumns({part: F.lit(None).cast("bigint"), row: F.lit(None).cast("bigint")})
    encoded = bpe.encode(placed, path, pattern, decoded=True, keep=[part, row])
    return encoded.select("doc_id", F.col(part).alias("part"), F.col(row).alias("row"), "ids", *bpe.digest_columns())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.keep(out, name) if n + 1 < len(STAGES) else out
    return docs
