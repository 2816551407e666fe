"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

All steps are DataFrame functions.  Texts never cross an exchange: what is
dealt out are lengths and hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, key_filter, marked
from .common import filter_bits as bits_for


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
    prefix_chars: int = 64,
    filter_bits: int | None = None,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, *carry): one row for every row of ``docs``.

    1. One scan gives (id, length, hash of the first ``prefix_chars`` characters);
       groups by length, then by length and prefix hash, lose all groups of one.
    2. What survives is counted while it is written and marked in a bitmap of eight bits a group (``filter_bits`` if
       given; 1 MB at least, 32 MB at most), broadcast to a second scan, which computes
       the full SHA-256 of marked rows only.  A row marked by chance costs one
       hash and changes nothing; past some tens of millions of surviving groups the
       filter lets more and more rows through, and the result is the same.
    3. Rows with a full hash are grouped by it: map-side minimum and count.  Groups
       of two or more are written, then joined back, so that the planner may split
       the rows of a very large group.

    Defined results: null text counts as empty; of rows equal in text and id each
    gets the same verdict; a null id stays only if its whole group has null ids;
    no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    carry = carry or {}
    text = normalised(docs[text_col])
    n, p = F.length(text), F.xxhash64(F.substring(text, 1, prefix_chars))

    by_length = scratch.keep(docs.select(n.alias("n"), p.alias("p")).groupBy("n", "p").agg(F.count("*").alias("rows")), "prefixes")
    lengths = by_length.groupBy("n").agg(F.sum("rows").alias("of_length")).where("of_length > 1")
    survive, groups_left = scratch.keep_counted(by_length.where("rows > 1").join(lengths, "n", "left_semi").select("n", "p"), "survive")
    bits = filter_bits or bits_for(groups_left)
    filters = key_filter(survive, "n", "p", bits=bits)

    scanned = docs.select(docs[id_col].alias("doc_id"), text.alias("_text"), n.alias("n"), p.alias("p"), *[c.alias(k) for k, c in carry.items()])
    tested = marked(scanned, "_some", filters, "n", "p", bits=bits)
    hashed = tested.select("doc_id", F.when(F.col("_some"), F.sha2("_text", 256)).alias("full"), *carry)
    hashed = scratch.keep(hashed, "hashed")

    groups = hashed.where("full is not null").groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = scratch.keep(groups, "groups")
    joined = hashed.where("full is not null").join(groups, "full", "left").select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), *carry)
    alone = hashed.where("full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *carry)
    out = alone.unionByName(joined)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(normalised(docs["text"]), 256)})


ORACLE_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""
